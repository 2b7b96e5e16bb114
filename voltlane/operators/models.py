"""Tree models on Spark ML: fitting, scoring, importances, search, storage."""

from __future__ import annotations

import json
import math
import random
from functools import partial
from threading import Lock

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.operators.attributions import tree_cuts
from voltlane.operators.cells import Cells, binned, cells, counted, inside, with_cuts
from voltlane.operators.metrics import (
    adjusted_metrics, evaluation, point_adjustment, score_binary, threshold_all_scores, threshold_grid,
)
from voltlane.operators.profiles import class_weights
from voltlane.operators.sampling import sequential_split
from voltlane.plans.ordering import chunked, plain, shuffled, with_index
from voltlane.session import materialise
from voltlane.session import side_by_side as run_side_by_side

LABEL, SCORE = "label", "score"


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector; rows with a missing feature are kept as invalid values by the trees."""
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)


def with_class_weight(df: DataFrame, label: str = LABEL, weights: dict[int, float] | None = None) -> DataFrame:
    """Weight per row: the given one per class, by default the balanced one."""
    if weights is None:
        weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}  # one row per class
    column = F.lit(1.0)
    for value, weight in weights.items():
        column = F.when(F.col(label) == value, F.lit(float(weight))).otherwise(column)
    return df.withColumn("_weight", column)


def fit_random_forest(
    train: DataFrame, features: list[str], label: str = LABEL, weights: dict[int, float] | None = None, seed: int = 42, **params
) -> RandomForestClassificationModel:
    """Forest with balanced class weights unless others are given; ``params`` are those of the Spark classifier.

    Where many rows lie between the same cuts it is fitted on ``cells``: trees of the same bootstrap of rows, from far fewer of them.
    """
    settings = {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt", **params}
    weighted = with_class_weight(train, label, weights)
    table = _as_cells(weighted, features, label, settings, {"numTrees", "featureSubsetStrategy", "impurity"})
    if table is not None:
        return _forest_of_cells(table, seed, settings)
    return RandomForestClassifier(
        featuresCol="_features", labelCol=label, weightCol="_weight", seed=seed, **settings
    ).fit(assemble(weighted, features))


#: settings that mean the same for cells as for rows; others, as numbers of rows in a node, keep a fit on rows
SAME_FOR_CELLS = {"maxDepth", "maxBins", "minInfoGain", "minWeightFractionPerNode"}
FITS_SIDE_BY_SIDE = 8


def _as_cells(weighted: DataFrame, features: list[str], label: str, settings: dict, also: set[str]) -> Cells | None:
    return cells(weighted, features, label, settings.get("maxBins", 32)) if set(settings) <= SAME_FOR_CELLS | also else None


def _forest_of_cells(table: Cells, seed: int, settings: dict) -> RandomForestClassificationModel:
    """One tree per bootstrap, side by side, put together as a forest."""
    spark, settings = table.rows.sparkSession, dict(settings)
    n = settings.pop("numTrees")
    if n > 1 and settings["featureSubsetStrategy"] == "auto":
        settings["featureSubsetStrategy"] = "sqrt"
    drawn = table.drawn(n, seed)
    forest = RandomForestClassifier(featuresCol="_features", labelCol=table.label, weightCol="_w", **{**settings, "maxBins": table.max_bins})

    def fit(tree: int) -> RandomForestClassificationModel:
        taken = F.col(f"_draw_{tree}")
        rows = drawn.where(taken > 0).select("_features", table.label, (F.col("_weight") * taken).alias("_w"))
        return forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.seed: seed + tree}).fit(rows)

    found = run_side_by_side(spark, fit, range(n), FITS_SIDE_BY_SIDE)
    sc = spark.sparkContext
    jvm = sc._jvm.org.apache.spark.ml.classification
    trees = sc._gateway.new_array(jvm.DecisionTreeClassificationModel, n)
    for i, model in enumerate(found):
        trees[i] = model._java_obj.trees()[0]
    whole = RandomForestClassificationModel(jvm.RandomForestClassificationModel(found[0].uid, trees, found[0].numFeatures, found[0].numClasses))
    whole = whole._resetUid(found[0].uid)._set(featuresCol="_features", labelCol=table.label, weightCol="_weight", numTrees=n, seed=seed, **settings)
    return with_cuts(whole, table.cuts)


BOOSTING = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8}
FIRST_ROUNDS, PATIENCE = 64, 30


def stopped(losses: list[float], patience: int) -> tuple[int, int | None]:
    """Best round so far (from 0), and the round at which ``patience`` rounds have passed without a better one, if there is one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, i
    return best, None


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees."""
    return _ensemble(list(model._java_obj.trees())[:n], [float(w) for w in model.treeWeights[:n]], model.numFeatures, model)


def _ensemble(trees: list, weights: list[float], n_features: int, like: GBTClassifier | GBTClassificationModel) -> GBTClassificationModel:
    """The model of some fitted trees, with the settings of ``like``."""
    sc = SparkSession.active().sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    every, shares = new(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees)), new(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        every[i], shares[i] = tree, weight
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(like.uid, every, shares, n_features, 2))
    cut = cut._resetUid(like.uid)._set(**{p.name: like.getOrDefault(p) for p in like.params if like.isSet(p) and cut.hasParam(p.name)})
    cut._transfer_params_to_java()
    return cut


class BoostingTable:
    """Training and validation rows of boosted fits, written once: as counted cells where these are far fewer, else as rows.

    On rows a fit is Spark's, which can't be taken up again. On cells a round is a regression tree for the gradients of the log loss at
    the model so far, of a sample of the rows, so a fit goes on where another one ended. Margins are written every few rounds, so that a
    round evaluates the trees since then, however many there are. ``finished`` gives the model for features.
    """

    DRAWS = 64  # rounds whose samples are drawn at once
    MARGINS = 8  # rounds after which margins are written

    def __init__(self, weighted: DataFrame, features: list[str], validation: DataFrame | None, label: str, seed: int, settings: list[dict]):
        self.features, self.label, self.seed, self.samples, self.lock = features, label, seed, {}, Lock()
        fits = {k: v for s in settings for k, v in s.items()}
        alike = len({s.get("maxBins", 32) for s in settings}) == 1
        self.cells = _as_cells(weighted, features, label, fits, {"maxIter", "stepSize", "subsamplingRate"}) if alike else None
        if self.cells is None:
            self.rows = materialise(assemble(weighted, features).select("_features", "_weight", label), "train")
        if validation is not None:
            held = validation.withColumn("_weight", F.lit(1.0))
            if self.cells is not None:
                held = counted(held, self.cells.cuts, label).withColumn("_weight", F.col("_n").cast("double"))
                held = VectorAssembler(inputCols=[f"_bin_{i}" for i in range(len(features))], outputCol="_features").transform(held)
            else:
                held = assemble(held, features)
            self.held = materialise(held.select("_features", label, "_weight"), "validation")

    @property
    def goes_on(self) -> bool:
        return self.cells is not None

    def fit(self, rounds: int, settings: dict, start: GBTClassificationModel | None = None) -> GBTClassificationModel:
        """A model of so many rounds, which goes on from ``start`` if it can."""
        booster = GBTClassifier(featuresCol="_features", labelCol=self.label, weightCol="_weight", seed=self.seed, **{**settings, "maxIter": rounds})
        if self.cells is None:
            return booster.fit(self.rows)
        own = {k: v for k, v in settings.items() if k in SAME_FOR_CELLS}
        tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_target", weightCol="_w", **{**own, "maxBins": self.cells.max_bins})
        sign = 2.0 * F.col(self.label).cast("double") - 1.0
        trees, weights = ([], []) if start is None else (list(start._java_obj.trees()), list(start.treeWeights))
        fitted, known, written = [], None, 0

        def with_margin(rows: DataFrame, first: int) -> DataFrame:
            """The trees from ``first`` on added to ``_margin``."""
            if first == len(trees):
                return rows
            scored = _ensemble(trees[first:], weights[first:], len(self.features), booster).transform(rows)
            return scored.withColumn("_margin", F.col("_margin") + vector_to_array("rawPrediction")[1]).select(rows.columns)

        for m in range(len(trees), rounds):
            block, at = divmod(m, self.DRAWS)
            taken = F.col(f"_draw_{at}")
            if known is None or at == 0:
                known, written = self._drawn(block, float(settings["subsamplingRate"])).withColumn("_margin", F.lit(0.0)), 0
                due = m > 0
            else:
                due = m - written >= self.MARGINS
            if due:
                later = [f"_draw_{i}" for i in range(at, self.DRAWS)]
                known = materialise(with_margin(known, written).select("_features", self.label, "_weight", "_margin", *later), "margins")
                written = m
            rows, target = with_margin(known, written).where(taken > 0), sign
            if trees:
                target = 4.0 * sign / (1.0 + F.exp(2.0 * sign * F.col("_margin")))
            # a fit reads its rows three times
            rows = rows.select("_features", target.alias("_target"), (F.col("_weight") * taken).alias("_w")).persist()
            fitted.append(tree.copy({tree.seed: self.seed + m}).fit(rows))  # Spark lets go of a tree when its model ends
            rows.unpersist()
            trees.append(fitted[-1]._java_obj)
            weights.append(float(settings["stepSize"]) if m else 1.0)
        return _ensemble(trees, weights, len(self.features), booster)

    def _drawn(self, block: int, rate: float) -> DataFrame:
        with self.lock:
            if (block, rate) not in self.samples:
                self.samples[block, rate] = self.cells.drawn(self.DRAWS, self.seed + block, rate)
            return self.samples[block, rate]

    def losses(self, model: GBTClassificationModel) -> list[float]:
        """Validation loss after each round, from one pass."""
        return list(model.evaluateEachIteration(self.held))

    def finished(self, model: GBTClassificationModel) -> GBTClassificationModel:
        return model if self.cells is None else with_cuts(model, self.cells.cuts)


def boost_with_patience(
    train: DataFrame, features: list[str], validation: DataFrame, label: str = LABEL, positive_weight: float = 1.0, seed: int = 42,
    patience: int = PATIENCE, **params,
) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees up to the round with the least validation loss, and the loss after each round that was looked at.

    Boosting goes on until ``patience`` rounds bring no better loss or ``maxIter`` rounds are done. On cells it is taken up every
    few rounds. A fit of Spark's cannot be, but its rounds do not depend on how many follow, so it is repeated with twice the rounds
    until it has gone far enough: less than twice the work of the last fit. One pass over the validation rows gives the losses of
    all rounds.
    """
    settings = {**BOOSTING, **params}
    most = settings.pop("maxIter")
    weighted = with_class_weight(train, label, {0: 1.0, 1: positive_weight})
    table = BoostingTable(weighted, features, validation, label, seed, [settings])
    rounds, model = min(most, max(FIRST_ROUNDS, patience + 1) if not table.goes_on else patience + 1), None
    while True:
        model = table.fit(rounds, settings, model)
        losses = table.losses(model)
        best, end = stopped(losses, patience)
        if end is not None or rounds == most:
            return table.finished(first_trees(model, best + 1)), losses[: (len(losses) if end is None else end + 1)]
        # on cells to where patience may end next
        rounds = min(most, best + patience + 1 if table.goes_on else 2 * rounds)


def fit_boosted_trees(
    train: DataFrame, features: list[str], validation: DataFrame | None = None, label: str = LABEL,
    positive_weight: float = 1.0, seed: int = 42, patience: int = PATIENCE, **params,
) -> GBTClassificationModel:
    """Boosted trees with a weight on positives, up to 300 rounds; with validation rows they end at the best round, see ``boost_with_patience``."""
    if validation is not None:
        return boost_with_patience(train, features, validation, label, positive_weight, seed, patience, **params)[0]
    settings = {**BOOSTING, **params}
    table = BoostingTable(with_class_weight(train, label, {0: 1.0, 1: positive_weight}), features, None, label, seed, [settings])
    return table.finished(table.fit(settings["maxIter"], settings))


def fit_linear(train: DataFrame, features: list[str], label: str = LABEL, **params) -> dict[str, float]:
    """Coefficients of a logistic regression, for ``linear_attributions``."""
    rows = assemble(with_class_weight(train, label), features)
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", **params).fit(rows)
    return dict(zip(features, (float(c) for c in model.coefficients)))


def predict(model: Model, df: DataFrame, features: list[str], score: str = SCORE) -> DataFrame:
    """Probability of class 1."""
    out = model.transform(assemble(df, features))
    return out.withColumn(score, vector_to_array("probability")[1]).select(*df.columns, score)


def feature_importance(model: Model, features: list[str], spark: SparkSession, top: int | None = None, used_only: bool = False) -> DataFrame:
    """``feature, importance``, highest first."""
    rows = list(zip(features, (float(v) for v in model.featureImportances.toArray())))
    rows = sorted((r for r in rows if r[1] > 0 or not used_only), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double")


def forest_importance(model: RandomForestClassificationModel, features: list[str], spark: SparkSession, top: int = 10) -> DataFrame:
    """Impurity importance, best ``top``."""
    return feature_importance(model, features, spark, top)


def booster_importance(model: GBTClassificationModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Gain importance; unused features are absent."""
    return feature_importance(model, features, spark, used_only=True)


def permutation_importance(
    model: Model, df: DataFrame, features: list[str], key: list[str], label: str = LABEL, repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Accuracy minus the mean accuracy after shuffling one feature, over several shuffles.

    Rows are numbered once. A shuffle sends every number to another one by a keyed permutation, so all rounds are one equi join of
    the numbered rows with themselves. All features share the pairs of a round, and each is swapped in its own copy of the row.
    Rows are compared by the bins between the cuts of the trees; copies in the same bins are counted and predicted once.
    """
    cuts = tree_cuts(model, df.sparkSession, features)
    bins = [f"_bin_{i}" for i in range(len(features))]
    slim = binned(df.select(*key, label, *features), cuts).select(*key, label, *[F.col(b).cast("int").alias(b) for b in bins])
    base = materialise(plain(with_index(chunked(slim, [], key), [], "_at")), "rows")
    of_bins = lambda counts: model.transform(assemble(counts.select("*", *inside(cuts)), features))
    hits = F.sum(F.when(F.col("prediction") == F.col(label), F.col("_n")).otherwise(0)) / F.sum("_n")
    baseline = of_bins(base.groupBy(label, *bins).agg(F.count(F.lit(1)).alias("_n"))).agg(hits.alias("baseline"))
    donors = base.select(F.col("_at").alias("_from"), *[F.col(b).alias(f"_d{b}") for b in bins])
    numbered = base.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    numbered = numbered.withColumn("_from", shuffled(F.col("_at"), max(base.count(), 1), F.col("_repeat") + seed))
    # written first, as the join would compute the permutation once more to look for nulls
    numbered = materialise(numbered.select("_from", "_repeat", label, *bins), "pairs")
    rounds = numbered.join(donors, "_from")
    copies = rounds.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = copies.select(
        label, "feature", "_repeat",
        *[F.when(F.col("feature") == f, F.col(f"_d{b}")).otherwise(F.col(b)).alias(b) for f, b in zip(features, bins)],
    )
    counts = swapped.groupBy("feature", "_repeat", label, *bins).agg(F.count(F.lit(1)).alias("_n"))
    scored = of_bins(counts).groupBy("feature", "_repeat").agg(hits.alias("_accuracy"))
    means = scored.groupBy("feature").agg(F.avg("_accuracy").alias("_mean"), F.stddev_pop("_accuracy").alias("std"))
    joined = means.crossJoin(F.broadcast(baseline))
    return joined.select("feature", (F.col("baseline") - F.col("_mean")).alias("importance"), "std").orderBy(F.col("importance").desc())


def draw(space: dict[str, tuple], rng: random.Random) -> dict:
    """One draw: ``("int", a, b)``, ``("float", a, b)``, ``("log", a, b)`` or ``("choice", [..])`` per parameter."""
    out = {}
    for name, (kind, *args) in space.items():
        if kind == "int":
            out[name] = rng.randint(*args)
        elif kind == "float":
            out[name] = rng.uniform(*args)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))
        else:
            out[name] = rng.choice(args[0])
    return out


def _threshold(scored: DataFrame, method: str, metric: str) -> float:
    best = threshold_grid(scored, metric) if method == "grid" else threshold_all_scores(scored, metric)
    return float(best.first()["threshold"])


def _both_metrics(scored: DataFrame, threshold: float, order: list[str]) -> dict[str, float]:
    """Raw metrics by name and segment-adjusted ones with the prefix ``adj_``."""
    raw = evaluation(scored, threshold).first().asDict()
    adjusted = adjusted_metrics(point_adjustment(score_binary(scored, threshold), order)).first().asDict()
    return {**raw, **{f"adj_{k}": v for k, v in adjusted.items()}}


def search_parameters(
    train: DataFrame, validation: DataFrame, features: list[str], order: list[str], space: dict[str, tuple], trials: int,
    kind: str = "forest", metric: str = "adj_f1", threshold_method: str = "all", seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Random search: one Spark fit per trial, threshold and metrics on the validation rows, best parameters.

    Returns the trials table (one row per trial, parameters as JSON) and the best parameters.
    """
    spark, rng = train.sparkSession, random.Random(seed)
    train, validation = materialise(train, "train"), materialise(validation, "validation")
    rows, best = [], (None, {})
    for number in range(trials):
        params = draw(space, rng)
        if kind == "forest":
            model = fit_random_forest(train, features, seed=seed, **params)
        else:
            model = fit_boosted_trees(train, features, validation, seed=seed, **params)
        scored = materialise(predict(model, validation, features), "scored")
        threshold = _threshold(scored, threshold_method, "f1")
        found = _both_metrics(scored, threshold, order)
        value = float(found[metric])
        rows.append(
            (number, json.dumps(params, sort_keys=True), value, threshold, float(found["f1"]), float(found["adj_f1"]),
             float(found["average_precision"]), float(found["auroc"]))
        )
        if best[0] is None or value > best[0]:
            best = (value, params)
    schema = "trial int, params string, value double, threshold double, f1 double, adj_f1 double, average_precision double, auroc double"
    return spark.createDataFrame(rows, schema), best[1]


def search_by_halving(
    train: DataFrame, validation: DataFrame, features: list[str], space: dict[str, tuple], trials: int, rounds: int = BOOSTING["maxIter"],
    factor: int = 3, label: str = LABEL, positive_weight: float = 1.0, side_by_side: int = 4, seed: int = 42,
) -> tuple[DataFrame, dict, GBTClassificationModel]:
    """Successive halving over boosted trees: trials start with few rounds, and the better ones go on with ``factor`` times as many.

    A trial is judged by the least validation loss of its rounds; of each rung the best ``1 / factor`` go on (ties: the earlier trial),
    the last one has ``rounds``. On cells a trial that goes on is taken up; a fit of Spark's cannot be and is done anew, which adds at most
    ``1 / (factor - 1)`` of its last fit. Fits of a rung run side by side, as Spark jobs of several threads.

    Returns a row per fit (``rung, trial, params, rounds, best_round, loss, goes_on``), the best parameters, and their model cut
    to its best round.
    """
    if trials < 1 or factor < 2:
        raise ValueError("at least one trial, and a factor of two or more")
    spark, rng = train.sparkSession, random.Random(seed)
    drawn = [draw(space, rng) for _ in range(trials)]
    weighted = with_class_weight(train, label, {0: 1.0, 1: positive_weight})
    table = BoostingTable(weighted, features, validation, label, seed, [{**BOOSTING, **d} for d in drawn])
    sizes = [trials]
    while sizes[-1] > 1:
        sizes.append(max(1, sizes[-1] // factor))

    def fit(trial: int, most: int) -> tuple[float, int, int, GBTClassificationModel]:
        models[trial] = model = table.fit(most, {**BOOSTING, **drawn[trial]}, models.get(trial))
        losses = table.losses(model)
        best = losses.index(min(losses))
        return losses[best], trial, best + 1, model

    out, alive, found, models = [], list(range(trials)), [], {}
    for rung in range(len(sizes)):
        most = max(1, rounds // factor ** (len(sizes) - 1 - rung))
        found = sorted(run_side_by_side(spark, partial(fit, most=most), alive, side_by_side), key=lambda r: r[:2])
        alive = [r[1] for r in found[: sizes[min(rung + 1, len(sizes) - 1)]]]
        out += [(rung, t, json.dumps(drawn[t], sort_keys=True), most, n, float(loss), t in alive) for loss, t, n, _ in found]
    _, trial, best_round, model = found[0]
    schema = "rung int, trial int, params string, rounds int, best_round int, loss double, goes_on boolean"
    return spark.createDataFrame(out, schema), drawn[trial], table.finished(first_trees(model, best_round))


def save_model(model: Model, path: str, features: list[str], threshold: float, params: dict, spark: SparkSession) -> str:
    """Model, threshold, feature names and parameters below one path."""
    model.write().overwrite().save(f"{path}/model")
    meta = [(type(model).__name__, float(threshold), list(features), json.dumps(params, sort_keys=True))]
    schema = "kind string, threshold double, features array<string>, params string"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


def load_model(path: str, spark: SparkSession) -> tuple[Model, dict]:
    meta = spark.read.schema("kind string, threshold double, features array<string>, params string").json(f"{path}/meta").first()
    kinds = {c.__name__: c for c in (RandomForestClassificationModel, GBTClassificationModel)}
    return kinds[meta["kind"]].load(f"{path}/model"), {**meta.asDict(), "params": json.loads(meta["params"])}


def evaluate_saved_model(path: str, df: DataFrame, order: list[str], label: str = LABEL) -> DataFrame:
    """Load a model, rebuild the time-ordered split, score the test part: raw and adjusted metrics in one row."""
    spark = df.sparkSession
    model, meta = load_model(path, spark)
    test = sequential_split(df, order).where("split = 'test'")
    scored = materialise(predict(model, test, meta["features"]).withColumnRenamed(label, LABEL), "scored")
    found = _both_metrics(scored, meta["threshold"], order)
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found))


def save_predictions(scored: DataFrame, threshold: float, order: list[str], path: str, label: str = LABEL) -> DataFrame:
    """``idx, true_label, predicted_label, predicted_probability`` in row order, written and read back."""
    # written first, as the order would predict once more to find its bounds
    flagged = materialise(score_binary(scored, threshold), "scored")
    indexed = plain(with_index(chunked(flagged, [], order), [], "idx"))
    out = indexed.select(
        "idx", F.col(label).alias("true_label"), F.col("predicted").alias("predicted_label"), F.col(SCORE).alias("predicted_probability")
    )
    out.write.mode("overwrite").parquet(path)
    return scored.sparkSession.read.parquet(path)
