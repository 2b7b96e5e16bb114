"""Queries of the model operators, on a label with a planted rule.

The label follows a rule of two features but for one row in ten, so a fit that learns nothing fails: SQL states the rule,
and queries return how far predictions follow it, which features come out first, and rounded metrics. The flipped rows
keep the trees from becoming pure, so fits take the work of their full settings.
"""

from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlane.operators import attributions, sampling
from voltlane.operators import models as op
from voltlane.plans.joins import scalar_join
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query
from voltlane.session import materialise, shared_path

FOREST = {"numTrees": 100, "maxDepth": 10}
BOOST = {"maxIter": 300, "maxDepth": 6}
PLANTED = ("l_discount", "l_tax")

_RULE = "l_discount > 0.045 AND l_tax < 0.045"
_FLIPPED = "(l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey) % 10 = 0"
_LABEL = f"CAST(({_RULE}) <> ({_FLIPPED}) AS INTEGER)"
_SPLIT = f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx, count(*) OVER () AS n
    FROM feature_rows), test AS (SELECT CAST(idx AS BIGINT) AS idx, CAST({_RULE} AS INTEGER) AS rule, {_LABEL} AS label
    FROM placed WHERE idx >= floor(n * 0.85::DOUBLE))"""
_FEATURES = "SELECT unnest([" + ", ".join(f"'{f}'" for f in fx.FEATURES) + "]) AS feature"
_PLANTED = "feature IN (" + ", ".join(f"'{f}'" for f in PLANTED) + ")"


def _rows(spark, d):
    return fx.features(spark, d).withColumns({"rule": F.expr(f"CAST({_RULE} AS INT)"), "label": F.expr(_LABEL.replace("INTEGER", "INT"))})


def _split(spark, d):
    return materialise(sampling.sequential_split(_rows(spark, d), fx.SORT, keep=[*fx.FEATURES, "label", "rule"]), "split")


def _part(rows, name):
    return rows.where(F.col("split") == name)


def _forest(rows):
    return op.fit_random_forest(_part(rows, "train"), fx.FEATURES, **FOREST)


def _booster(rows):
    return op.fit_boosted_trees(_part(rows, "train"), fx.FEATURES, _part(rows, "val"), positive_weight=2.0, **BOOST)


def _followed(scored):
    """Rows and positives, the share of rows whose prediction is the rule's, to one place, and whether the score ranks labels well.

    A constant model follows seven rows in ten and has an AUROC of one half; the rule itself one of 0.87.
    """
    found = op.evaluation(scored.select("label", "score"), 0.5).select((F.col("auroc") > 0.8).alias("ranks_labels"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"),
        F.round(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("rule")).cast("double")), 1).alias("follows_rule"),
    )
    return scalar_join(sums, found)


_FOLLOWED = _SPLIT + " SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, 1.0::DOUBLE AS follows_rule, TRUE AS ranks_labels FROM test"


@query("fit_random_forest", _FOLLOWED)
def fit_random_forest(spark, d):
    rows = _split(spark, d)
    return _followed(materialise(op.predict(_forest(rows), _part(rows, "test"), fx.FEATURES), "scored"))


@query("fit_boosted_trees", _FOLLOWED)
def fit_boosted_trees(spark, d):
    rows = _split(spark, d)
    return _followed(materialise(op.predict(_booster(rows), _part(rows, "test"), fx.FEATURES), "scored"))


@query("boosting_rounds", "SELECT TRUE AS best_is_least, TRUE AS stopped_in_time, TRUE AS below_prior")
def boosting_rounds(spark, d):
    """The curve of validation losses: the kept trees end at its least value, and it goes on for as long as patience lasts."""
    rows = _split(spark, d)
    model, losses = op.boost_with_patience(_part(rows, "train"), fx.FEATURES, _part(rows, "val"), positive_weight=2.0, **BOOST)
    curve = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "round int, loss double")
    found = curve.agg(F.min_by("round", F.struct("loss", "round")).alias("best"), F.max("round").alias("last"), F.min("loss").alias("least"))
    return found.select(
        (F.col("best") == model.getNumTrees).alias("best_is_least"),
        ((F.col("last") == F.col("best") + op.PATIENCE) | (F.col("last") == BOOST["maxIter"])).alias("stopped_in_time"),
        (F.col("least") < 1.1).alias("below_prior"),  # the share of positives alone has a loss of 1.28
    )


@query("tree_attributions", _SPLIT + " SELECT idx, TRUE AS adds_up FROM test")
def tree_attributions(spark, d):
    """Contributions and base against the model's own margin."""
    rows = _split(spark, d)
    model, test = _booster(rows), _part(rows, "test").select("idx", *fx.FEATURES)
    found = attributions.tree_attributions(model, test, fx.FEATURES)
    both = model.transform(op.assemble(found, fx.FEATURES)).withColumn("_margin", vector_to_array("rawPrediction")[1])
    total = reduce(lambda a, b: a + b, [F.col(f"{f}_contribution") for f in fx.FEATURES]) + F.col("base")
    return both.select("idx", (F.abs(total - F.col("_margin")) < 1e-6).alias("adds_up"))


@query("tree_attribution_importance", f"SELECT feature, {_PLANTED} AS planted FROM ({_FEATURES})")
def tree_attribution_importance(spark, d):
    """Mean absolute contributions put the two features of the rule first."""
    rows = _split(spark, d)
    found = attributions.tree_attributions(_booster(rows), _part(rows, "test").select("idx", *fx.FEATURES), fx.FEATURES)
    sizes = found.agg(*[F.avg(F.abs(f"{f}_contribution")).alias(f) for f in fx.FEATURES])
    return _first_two(sizes.select(F.expr("stack(" + str(len(fx.FEATURES)) + ", " + ", ".join(f"'{f}', {f}" for f in fx.FEATURES) + ") AS (feature, importance)")))


def _first_two(importance):
    """Which two features come first; one row per feature."""
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return importance.select("feature", (place <= len(PLANTED)).alias("planted"))


def _shares(importance):
    """The two features that come first, and whether the importances are shares that add up to 1."""
    total = F.sum("importance").over(Window.partitionBy())  # one row per feature
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    complete = F.col("importance").between(0, 1) & (F.abs(total - 1) < 1e-6)
    return importance.select("feature", (place <= len(PLANTED)).alias("planted"), complete.alias("complete"))


@query("forest_importance", f"SELECT feature, {_PLANTED} AS planted, TRUE AS complete FROM ({_FEATURES})")
def forest_importance(spark, d):
    return _shares(op.forest_importance(_forest(_split(spark, d)), fx.FEATURES, spark))


@query("booster_importance", f"SELECT feature, {_PLANTED} AS planted, TRUE AS complete FROM ({_FEATURES})")
def booster_importance(spark, d):
    return _shares(op.booster_importance(_booster(_split(spark, d)), fx.FEATURES, spark))


@query("permutation_importance", f"SELECT feature, {_PLANTED} AS planted, {_PLANTED} AS matters FROM ({_FEATURES})")
def permutation_importance(spark, d):
    """Shuffling a feature of the rule costs more than a tenth of the accuracy, shuffling another one next to none."""
    rows = _split(spark, d)
    found = op.permutation_importance(_forest(rows), _part(rows, "test"), fx.FEATURES, ["idx"])
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))  # one row per feature
    return found.select("feature", (place <= len(PLANTED)).alias("planted"), (F.col("importance") > 0.1).alias("matters"))


@query("search_parameters", "SELECT CAST(trial AS INTEGER) AS trial, TRUE AS valid, TRUE AS finds_positives FROM range(2) t(trial)")
def search_parameters(spark, d):
    rows = _split(spark, d)
    space = {"numTrees": ("int", 50, 150), "maxDepth": ("int", 3, 10), "featureSubsetStrategy": ("choice", ["sqrt", "all"])}
    trials = op.search_parameters(_part(rows, "train"), _part(rows, "val"), fx.FEATURES, ["idx"], space, 2)[0]
    shares = [F.col(c).between(0, 1) for c in ("value", "threshold", "f1", "adj_f1", "average_precision", "auroc")]
    # the rule itself has an F1 of 0.84, calling every row positive one of 0.5
    return trials.select("trial", (reduce(and_, shares) & (F.col("adj_f1") >= F.col("f1") - 1e-9)).alias("valid"), (F.col("f1") > 0.75).alias("finds_positives"))


@query("search_by_halving", """SELECT rung, n_trials, rounds, n_go_on, TRUE AS best_go_on, TRUE AS ranks_labels
    FROM (VALUES (0, 9, 3, 3), (1, 3, 9, 1), (2, 1, 27, 1)) t(rung, n_trials, rounds, n_go_on)""")
def search_by_halving(spark, d):
    """A row per rung: its fits, whether the ones with the least losses go on, and whether the last model ranks the test rows."""
    rows = _split(spark, d)
    space = {"maxDepth": ("int", 2, 6), "stepSize": ("log", 0.05, 0.5), "subsamplingRate": ("float", 0.6, 1.0)}
    fits, _, model = op.search_by_halving(_part(rows, "train"), _part(rows, "val"), fx.FEATURES, space, 9, rounds=27)
    scored = op.predict(model, _part(rows, "test"), fx.FEATURES)
    found = op.evaluation(scored.select("label", "score"), 0.5).select((F.col("auroc") > 0.8).alias("ranks_labels"))
    rungs = fits.groupBy("rung").agg(
        F.count(F.lit(1)).cast("int").alias("n_trials"), F.first("rounds").alias("rounds"), F.sum(F.col("goes_on").cast("int")).cast("int").alias("n_go_on"),
        (F.max(F.when(F.col("goes_on"), F.col("loss"))) <= F.coalesce(F.min(F.when(~F.col("goes_on"), F.col("loss"))), F.lit(float("inf")))).alias("best_go_on"),
    )
    return scalar_join(rungs, found)


@query("evaluate_saved_model", "SELECT TRUE AS valid, TRUE AS ranks_labels, TRUE AS finds_positives")
def evaluate_saved_model(spark, d):
    rows = _split(spark, d)
    path = op.save_model(_forest(rows), shared_path(spark, "model"), fx.FEATURES, 0.5, FOREST, spark)
    found = op.evaluate_saved_model(path, _rows(spark, d), fx.SORT)
    return found.select((F.col("adj_f1") >= F.col("f1") - 1e-9).alias("valid"), (F.col("auroc") > 0.8).alias("ranks_labels"), (F.col("f1") > 0.75).alias("finds_positives"))


@query("save_load_model", _SPLIT + " SELECT idx, TRUE AS equal, 0.4::DOUBLE AS threshold FROM test")
def save_load_model(spark, d):
    rows = _split(spark, d)
    fitted, test = _booster(rows), _part(rows, "test")
    path = op.save_model(fitted, shared_path(spark, "model"), fx.FEATURES, 0.4, BOOST, spark)
    model, meta = op.load_model(path, spark)
    both = op.predict(fitted, op.predict(model, test, meta["features"]), fx.FEATURES, "before")
    return both.select("idx", (F.col("score") == F.col("before")).alias("equal"), F.lit(float(meta["threshold"])).alias("threshold"))


@query(
    "save_predictions",
    _SPLIT + " SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS idx, label AS true_label, TRUE AS valid, 0.9::DOUBLE AS accuracy FROM test",
)
def save_predictions(spark, d):
    rows = _split(spark, d)
    scored = op.predict(_forest(rows), _part(rows, "test"), fx.FEATURES)
    saved = op.save_predictions(scored, 0.5, ["idx"], shared_path(spark, "predictions"))
    p = F.col("predicted_probability")
    accuracy = saved.agg(F.round(F.avg((F.col("predicted_label") == F.col("true_label")).cast("double")), 1).alias("accuracy"))
    return scalar_join(saved, accuracy).select("idx", "true_label", (p.between(0, 1) & (F.col("predicted_label") == (p >= 0.5).cast("int"))).alias("valid"), "accuracy")
