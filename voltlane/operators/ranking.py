"""Feature ranking, principal components, attributions and class separation."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions.columns import digamma
from voltlane.operators.cleaning import standardise
from voltlane.operators.profiles import long_format
from voltlane.operators.series import blocks_with_halo
from voltlane.plans.joins import scalar_join
from voltlane.plans.ordering import chunked, plain, quantiles, settled, with_index, with_running

LABEL = "label"


def mutual_information(df: DataFrame, features: list[str], label: str = LABEL, bins: int = 10) -> DataFrame:
    """Feature-label mutual information in nats over quantile bins, with its rank.

    ``mutual_information_nearest`` needs no bins.
    """
    rows = long_format(df, features, (label,)).where(F.col("value").isNotNull())
    shares = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = quantiles(rows, ["column"], "value", shares)
    wide = edges.agg(*[F.max(F.when(F.col("column") == c, F.col(e))).alias(f"{e}_{c}") for c in features for e in shares])
    placed = scalar_join(df.select(label, *features), wide)
    # plain comparisons, which compile, where a function over an array of edges would be interpreted
    bin_of = {c: reduce(add, [(F.col(c) > F.col(f"{e}_{c}")).cast("int") for e in shares]) for c in features}
    binned = placed.select(label, *[F.when(F.col(c).isNotNull(), b).alias(c) for c, b in bin_of.items()])
    cells = binned.unpivot([label], features, "feature", "_bin").where("_bin is not null")
    counts = cells.groupBy("feature", "_bin", label).agg(F.count(F.lit(1)).alias("_n"))
    # from here on at most features x bins x classes rows
    whole, by_bin, by_class = Window.partitionBy("feature"), Window.partitionBy("feature", "_bin"), Window.partitionBy("feature", label)
    p = F.col("_n") / F.sum("_n").over(whole)
    ratio = F.col("_n") * F.sum("_n").over(whole) / (F.sum("_n").over(by_bin) * F.sum("_n").over(by_class).cast("double"))
    terms = counts.select("feature", (p * F.log(ratio)).alias("_t"))
    scores = terms.groupBy("feature").agg(F.sum("_t").alias("mutual_info"))
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.col("mutual_info").desc())))  # one row per feature


def _class_neighbours(counts: DataFrame, label: str, k: int, block_rows: int) -> DataFrame:
    """``far``: the value of the k-th nearest other row of the class, for counted ``column, label, value, n, class_n``.

    Values are put in order once; blocks of the order see ``k`` more values on either side, each of which stands for a row at least.
    """
    part = ["column", label]
    placed = plain(with_index(chunked(counts, part, ["value"]), part))
    line = Window.partitionBy(*part, "_block").orderBy("idx")
    spread = blocks_with_halo(placed, "idx", block_rows, k, k)
    at = lambda shift, i: F.struct(F.abs(shift("value", i).over(line) - F.col("value")).alias("d"), shift("value", i).over(line).alias("v"), shift("n", i).over(line).alias("n"))
    near = F.array_sort(F.filter(F.array(*[at(shift, i) for shift in (F.lag, F.lead) for i in range(1, k + 1)]), lambda x: x["v"].isNotNull()))
    wanted = F.least(F.lit(k), F.col("class_n") - 1) - (F.col("n") - 1)
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.col("value").alias("far"))
    step = lambda s, x: F.when(s["rows"] >= F.col("_wanted"), s).otherwise(F.struct((s["rows"] + x["n"]).alias("rows"), x["v"].alias("far")))
    found = spread.withColumns({"_near": near, "_wanted": wanted}).where(F.floor(F.col("idx") / block_rows) == F.col("_block"))
    return found.withColumn("far", F.aggregate("_near", start, step)["far"]).drop("_near", "_wanted", "_block", "idx")


def _rows_within(counts: DataFrame, near: DataFrame, label: str) -> DataFrame:
    """``m``: rows of any class nearer than ``far``, the row itself included; where copies of the value reach that far, those.

    Two ranks of bounds among all values, from one running sum over values and bounds in order: a bound before equal values
    counts those below it, one after them those up to it.
    """
    value, far = F.col("value"), F.col("far")
    below, values, upto = 0, 1, 2
    same = far == value
    low = F.when(same | (far < value), far).otherwise(value - (far - value))
    high = F.when(same | (far > value), far).otherwise(value + (value - far))
    bound = lambda at, side, sign: F.struct(at.alias("at"), side.alias("side"), F.lit(sign).alias("sign"))
    bounds = F.array(bound(low, F.when(same, below).otherwise(upto), -1), bound(high, F.when(same, upto).otherwise(below), 1))
    asked = near.select("column", label, "value", "n", "class_n", F.inline(bounds)).withColumn("w", F.lit(0).cast("long"))
    all_values = counts.groupBy("column", F.col("value").alias("at")).agg(F.sum("n").alias("w")).withColumn("side", F.lit(values))
    events = asked.unionByName(all_values, allowMissingColumns=True)
    run = with_running(chunked(events, ["column"], ["at", "side"]), ["column"], {"_upto": ("sum", "w")}).where("sign IS NOT NULL")
    return run.groupBy("column", label, "value").agg(F.sum(F.col("sign") * F.col("_upto")).alias("m"), F.max("n").alias("n"), F.max("class_n").alias("class_n"))


def mutual_information_nearest(df: DataFrame, features: list[str], label: str = LABEL, k: int = 3, block_rows: int = 4096) -> DataFrame:
    """Feature-label mutual information in nats by nearest neighbours in one dimension, with its rank.

    For every row, the distance to its ``k``-th nearest row of the same class, and how many rows of all classes lie nearer. Missing
    and infinite values and classes of one row are left out, as is the noise that other estimates add to break ties. Equal values are
    counted first, and everything then follows from two orders: of the values in a class, and of all values.
    """
    rows = long_format(df, features, (label,)).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & F.col(label).isNotNull())
    counts = settled(rows.groupBy("column", label, F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    classes = settled(counts.groupBy("column", label).agg(F.sum("n").alias("class_n")).where("class_n > 1"))
    counts = counts.join(classes, ["column", label])
    # written first, as the order of all values would compute it once more to find its bounds
    near = settled(_class_neighbours(counts, label, k, block_rows))
    within = _rows_within(counts, near, label)
    neighbours = F.least(F.lit(k), F.col("class_n") - 1)
    mean = lambda x: F.sum(F.col("n") * digamma(x)) / F.sum("n")
    score = digamma(F.sum("n")) + mean(neighbours) - mean(F.col("class_n")) - mean(F.col("m"))
    scores = within.groupBy(F.col("column").alias("feature")).agg(F.greatest(score, F.lit(0.0)).alias("mutual_info"))
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.col("mutual_info").desc())))  # one row per feature


def rank_and_mean_rank(scores: DataFrame, methods: list[str]) -> DataFrame:
    """``method, feature, score`` to one row per feature: score and rank per method, and the mean rank.

    Ranks are descending with ties sharing the average; a missing score has no rank.
    """
    known = scores.where(F.col("score").isNotNull())
    ties = known.groupBy("method", "score").agg(F.count(F.lit(1)).alias("_n"))
    run = with_running(chunked(ties, ["method"], [F.col("score").desc()]), ["method"], {"_upto": ("sum", "_n")})
    places = settled(run.select("method", "score", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank")))
    ranked = known.join(places, ["method", "score"])
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    columns = [x for m in methods for x in (pick(m, "score").alias(m), pick(m, "rank").alias(f"{m}_rank"))]
    return ranked.groupBy("feature").agg(*columns, F.avg("rank").alias("mean_rank")).orderBy("mean_rank", "feature")


def normalised_importance(summary: DataFrame, methods: list[str], top: int = 15) -> DataFrame:
    """Score over the best score of its method, among the features with the best mean rank."""
    best = summary.orderBy("mean_rank", "feature").limit(top)
    long = best.unpivot(["feature"], methods, "method", "importance").where("importance is not null")
    peak = F.max("importance").over(Window.partitionBy("method"))  # at most ``top`` rows per method
    return long.withColumn("normalised", F.when(peak > 0, F.col("importance") / peak))


def finite(df: DataFrame, features: list[str], missing: str = "mean") -> DataFrame:
    """Every row, with missing and non-finite features replaced by the mean of the others (``mean``) or by 0 (``zero``)."""
    known = {f: F.when(~F.isnan(f) & (F.abs(f) != F.lit(float("inf"))), F.col(f).cast("double")) for f in features}
    if missing == "zero":
        return df.withColumns({f: F.coalesce(v, F.lit(0.0)) for f, v in known.items()})
    means = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"_mean_{f}") for f, v in known.items()])
    filled = scalar_join(df, means).withColumns({f: F.coalesce(v, F.col(f"_mean_{f}")) for f, v in known.items()})
    return filled.select(*df.columns)


def fit_pca(df: DataFrame, features: list[str], k: int | None = None, missing: str = "mean"):
    """Principal components of standardised features: the fitted model and the table, with all its rows and the input vector."""
    ready = standardise(finite(df, features, missing), features)
    vectors = VectorAssembler(inputCols=features, outputCol="_vector").transform(ready)
    return PCA(k=k or len(features), inputCol="_vector", outputCol="_pc").fit(vectors), vectors


def standardised_pca_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """Explained share and running total per component."""
    ratios = fit_pca(df, features)[0].explainedVariance.toArray()
    rows = [(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(ratios, np.cumsum(ratios)))]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def pca_component_count(variance: DataFrame, share: float = 0.95, at_least: int = 4) -> DataFrame:
    """Smallest number of components that reaches the share, at least four (or all there are)."""
    reached = F.min(F.when(F.col("cumulative") >= share - 1e-12, F.col("component")))
    every = F.max("component")
    return variance.agg(F.least(F.greatest(F.coalesce(reached, every), F.lit(at_least)), every).alias("components"))


def pca_loadings(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, component, loading``; the sign of a component is arbitrary."""
    model = fit_pca(df, features)[0]
    n = df.count()
    variance = model.explainedVariance.toArray() * len(features) * n / max(n - 1, 1)
    loadings = model.pc.toArray() * np.sqrt(variance)
    rows = [(f, j + 1, float(loadings[i, j])) for i, f in enumerate(features) for j in range(loadings.shape[1])]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


def pca_importance(loadings: DataFrame, components: int = 5) -> DataFrame:
    """Mean absolute loading over the first components, ranked."""
    scores = loadings.where(F.col("component") <= components).groupBy("feature").agg(F.avg(F.abs("loading")).alias("importance"))
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.col("importance").desc())))  # one row per feature


def pca_scores(df: DataFrame, features: list[str], k: int, keep: list[str]) -> DataFrame:
    """Columns ``PC1 .. PCk`` next to the kept columns."""
    model, vectors = fit_pca(df, features, k)
    out = model.transform(vectors).withColumn("_a", vector_to_array("_pc"))
    return out.select(*keep, *[F.col("_a")[i].alias(f"PC{i + 1}") for i in range(k)])


def linear_attributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """``coef * (x - mean)`` per feature, as columns ``<feature>_contribution``: exact for a linear model."""
    means = df.agg(*[F.avg(f).alias(f"_mean_{f}") for f in coefficients])
    joined = scalar_join(df, means)
    return joined.select(
        *df.columns,
        *[(F.lit(float(w)) * (F.col(f) - F.col(f"_mean_{f}"))).alias(f"{f}_contribution") for f, w in coefficients.items()],
    )


def attribution_importance(attributions: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, ranked."""
    rows = long_format(attributions, [f"{f}_contribution" for f in features])
    scores = rows.groupBy(F.regexp_replace("column", "_contribution$", "").alias("feature")).agg(F.avg(F.abs("value")).alias("importance"))
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.col("importance").desc())))  # one row per feature


def attribution_extremes(
    attributions: DataFrame, features: list[str], key: list[str], base_value: float = 0.0, n: int = 1
) -> DataFrame:
    """Rows with the highest and the lowest summed contribution plus base value."""
    total = sum((F.col(f"{f}_contribution") for f in features), F.lit(float(base_value)))
    rows = attributions.withColumn("output", total)
    high = rows.orderBy(F.col("output").desc(), *key).limit(n).withColumn("side", F.lit("highest"))
    low = rows.orderBy("output", *key).limit(n).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)


def _silhouettes(sums: DataFrame) -> DataFrame:
    """``_key, label, other, total, n`` (self left out) to ``label, worth`` per row; rows without another class are left out."""
    own = F.col("label") == F.col("other")
    per_row = sums.groupBy("_key", "label").agg(
        F.max(F.when(own, F.try_divide("total", "n"))).alias("a"),
        F.min(F.when(~own, F.try_divide("total", "n"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("_own"),
    )
    worth = F.when(F.col("_own") == 0, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_row.where("b is not null").select("label", worth.alias("worth"))


def _mean_silhouette(sums: DataFrame) -> DataFrame:
    return _silhouettes(sums).agg(F.avg("worth").alias("silhouette"), F.count(F.lit(1)).alias("rows"))


#: vectors of one side that a task of distances holds, and tasks for each core
TASK_BYTES, TASKS_A_CORE = 32 << 20, 4


def _grid(some: int, rows: int, most: int, block_rows: int, tasks: int) -> tuple[int, int]:
    """Into how many groups both sides are cut: of ``most`` rows at most, for so many pairs of groups if they have ``block_rows`` rows.

    A row travels once for each group of the other side, so groups are as large as tasks can hold, and the larger ones are cut first.
    """
    sizes = (some, rows)
    cut, finest = ([max(1, -(-n // size)) for n in sizes] for size in (most, block_rows))
    while cut[0] * cut[1] < tasks and cut != finest:
        side = max((s for s in (0, 1) if cut[s] < finest[s]), key=lambda s: sizes[s] / cut[s])
        cut[side] += 1
    return cut[0], cut[1]


def _distance_sums(some: DataFrame, rows: DataFrame, block_rows: int) -> DataFrame:
    """Sums of distances from each of ``some`` rows to every class: every pair of row groups is a task of small matrix products."""
    spark = rows.sparkSession
    width = F.greatest(F.coalesce(F.max(F.size("_x")), F.lit(1)), F.approx_count_distinct("label"), F.lit(1))
    found = rows.agg(F.count(F.lit(1)).alias("n"), width.alias("width")).first()
    most = max(block_rows, TASK_BYTES // (8 * found["width"]))
    groups = dict(zip(("_i", "_j"), _grid(some.count(), found["n"], most, block_rows, TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
    placed = lambda df, side: df.withColumn(side, F.pmod(F.xxhash64("_key"), F.lit(groups[side])))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[side] - 1).cast("long")))
    # pairs of groups are few bytes but much work, so that partitions are not put together and few of them get two
    dealt = lambda df: df.repartition(4 * groups["_i"] * groups["_j"], "_i", "_j").groupBy("_i", "_j")
    left = dealt(placed(some, "_i").withColumn("_j", every("_j")))
    right = dealt(placed(rows, "_j").withColumn("_i", every("_i")))
    label_type = dict(rows.dtypes)["label"]
    schema = f"_key {dict(rows.dtypes)['_key']}, label {label_type}, other {label_type}, total double, n long"

    def group_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_key": a["_key"][:0], "label": a["label"][:0], "other": b["label"][:0], "total": [], "n": []})
        b = b[b["label"].notna()].sort_values("label")
        others, first = np.unique(b["label"].to_numpy(), return_index=True)
        classes = np.repeat(np.arange(len(others)), np.diff(np.append(first, len(b))))
        keys = pd.factorize(pd.concat([a["_key"], b["_key"]]))[0]
        mine, theirs = keys[: len(a)], keys[len(a) :]
        x, y = (np.stack(df["_x"].to_numpy()).astype(float) if len(df) else np.zeros((0, 1)) for df in (a, b))
        total, n = np.zeros((len(a), len(others))), np.zeros((len(a), len(others)), np.int64)
        for p in range(0, len(a), block_rows):
            at = slice(p, p + block_rows)
            for q in range(0, len(b), block_rows):
                to = slice(q, q + block_rows)
                distance = x[at] @ y[to].T
                distance *= -2
                distance += (x[at] * x[at]).sum(1)[:, None]
                distance += (y[to] * y[to]).sum(1)[None, :]
                np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
                own = np.nonzero(mine[at, None] == theirs[None, to])
                distance[own] = 0.0
                starts = np.flatnonzero(np.diff(classes[to], prepend=-1))
                total[at, classes[to][starts]] += np.add.reduceat(distance, starts, axis=1)
                n[at] += np.bincount(classes[to], minlength=len(others))
                np.subtract.at(n[at], (own[0], classes[to][own[1]]), 1)
        each = lambda c: np.repeat(a[c].to_numpy(), len(others))
        return pd.DataFrame({"_key": each("_key"), "label": each("label"), "other": np.tile(others, len(a)), "total": total.ravel(), "n": n.ravel()})

    pieces = left.cogroup(right).applyInPandas(group_sums, schema)
    return pieces.groupBy("_key", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _points(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``_key, label, _x``; floats stay floats, which are half as many bytes on the way."""
    x = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    return df.select(F.col(key).alias("_key"), F.col(label).alias("label"), x.alias("_x"))


def silhouette_by_label(df: DataFrame, key: str, vector: str, label: str = LABEL, block_rows: int = 2048) -> DataFrame:
    """Mean Euclidean silhouette of the given classes; null with one class.

    The mean of distances has no shortcut, so the work is quadratic, in groups of rows of which only sums per row and class are left. Use it
    on a sample as the embedding reports do, and ``silhouette_sampled`` or ``silhouette_squared`` on whole tables.
    """
    rows = _points(df, key, vector, label)
    return _mean_silhouette(_distance_sums(rows, rows, block_rows))


def silhouette_sampled(
    df: DataFrame, key: str, vector: str, label: str = LABEL, per_class: int = 1000, deviations: float = 3.29, block_rows: int = 2048, seed: int = 42
) -> DataFrame:
    """``silhouette, low, high, sampled, rows``: the mean Euclidean silhouette from about ``per_class`` rows of each class.

    A drawn row has its exact silhouette, by its distances to all rows, so the work is linear. Classes count by their sizes; the
    interval is ``deviations`` standard errors of such a stratified mean on either side (3.29: 99.9 %), and has no width where all rows are
    drawn. Draws are hashes of the key.
    """
    rows = _points(df, key, vector, label)
    sizes = settled(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")))
    drawn = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.lit(per_class) / F.col("_n")
    some = settled(rows.join(sizes, "label").where(drawn).select("_key", "label", "_x"))
    worth = _silhouettes(_distance_sums(some, rows, block_rows))
    classes = worth.groupBy("label").agg(F.count(F.lit(1)).alias("_m"), F.avg("worth").alias("_mean"), F.coalesce(F.var_samp("worth"), F.lit(0.0)).alias("_var"))
    whole = F.sum("_n").over(Window.partitionBy())  # one row per class
    shares = classes.join(sizes, "label").withColumn("_w", F.col("_n") / whole)
    error = F.sqrt(F.sum(F.col("_w") * F.col("_w") * F.col("_var") / F.col("_m") * (1 - F.col("_m") / F.col("_n"))))
    found = shares.agg(F.sum(F.col("_w") * F.col("_mean")).alias("silhouette"), error.alias("_e"), F.sum("_m").alias("sampled"), F.sum("_n").alias("rows"))
    off = F.lit(deviations) * F.col("_e")
    return found.select("silhouette", (F.col("silhouette") - off).alias("low"), (F.col("silhouette") + off).alias("high"), "sampled", "rows")


def silhouette_squared(df: DataFrame, key: str, vector: str, label: str = LABEL) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact in linear time from class sums."""
    rows = df.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_x"))
    norm = F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("_sq", norm)
    per_place = rows.select("label", F.posexplode("_x").alias("_p", "_v")).groupBy("label", "_p").agg(F.sum("_v").alias("_s"))
    vectors = per_place.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("_p", "_s"))).alias("_a"))  # one entry per dimension
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.sum("_sq").alias("_total"))
    stats = classes.join(vectors, "label").select(
        F.col("label").alias("other"), "_n", "_total", F.transform("_a", lambda p: p["_s"]).alias("_sum")
    )
    table = settled(stats).agg(F.collect_list(F.struct("other", "_n", "_total", "_sum")).alias("_classes"))  # one entry per class
    spread = scalar_join(rows, table).select("_key", "label", "_x", "_sq", F.inline("_classes"))
    dot = F.aggregate(F.zip_with("_x", "_sum", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    total = F.col("_n") * F.col("_sq") + F.col("_total") - 2 * dot
    own = (F.col("label") == F.col("other")).cast("long")
    sums = spread.select("_key", "label", "other", F.greatest(total, F.lit(0.0)).alias("total"), (F.col("_n") - own).alias("n"))
    return _mean_silhouette(sums)
