"""Counts, distributions, column profiles, daily and weekly profiles, correlations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.functions.columns import numeric_columns, unpivoted
from voltlane.operators.cleaning import time_features
from voltlane.plans.joins import scalar_join
from voltlane.plans.ordering import chunked, null_safe_join, plain, quantiles, settled, with_count, with_index

LABEL = "anomaly_label"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def _class_columns(label: str) -> list[Column]:
    total, hit = F.count(F.lit(1)), F.count_if(F.col(label) == 1)
    return [
        total.alias("total"),
        hit.alias("anomalies"),
        (total - hit).alias("normals"),
        _ratio(hit, total).alias("anomaly_share"),
        _ratio(total - hit, total).alias("normal_share"),
        _ratio(total - hit, hit).alias("normals_per_anomaly"),
    ]


def class_ratio(df: DataFrame, label: str = LABEL, by: tuple[str, ...] = ()) -> DataFrame:
    """Anomaly and normal counts and shares, normals per anomaly; optionally per group."""
    return df.groupBy(*by).agg(*_class_columns(label))


def class_ratio_by_split(df: DataFrame, label: str = LABEL, split: str = "split") -> DataFrame:
    """The same for each split and in total."""
    return df.rollup(split).agg(*_class_columns(label)).withColumn(split, F.coalesce(split, F.lit("total")))


def label_statistics(df: DataFrame, label: str = LABEL, ts: str = "ts", station: str = "station") -> DataFrame:
    """Per station: rows, anomalies, percent, first and last time, span in days."""
    total, hit = F.count(F.lit(1)), F.count_if(F.col(label) == 1)
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86_400_000_000.0)
    return df.groupBy(station).agg(
        total.alias("total"),
        hit.alias("anomalies"),
        (hit / total * 100).alias("anomaly_percent"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        span.alias("span_days"),
    )


def data_info(df: DataFrame, features: list[str], label: str = "label", split: str = "split") -> DataFrame:
    """Per split: size, number of features, label mean and class counts."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("size"),
        F.lit(len(features)).alias("n_features"),
        F.avg(label).alias("label_mean"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns)


def describe_downtime(df: DataFrame, seconds: str) -> DataFrame:
    """Minutes: count, nulls, mean, sample deviation, minimum, quartiles, maximum."""
    minutes = df.select((F.col(seconds) / 60).alias("_m"))
    base = minutes.agg(
        F.count("_m").alias("count"),
        F.count_if(F.col("_m").isNull()).alias("nulls"),
        F.avg("_m").alias("mean"),
        F.stddev_samp("_m").alias("std"),
        F.min("_m").alias("min"),
        F.max("_m").alias("max"),
    )
    return scalar_join(base, quantiles(minutes, [], "_m", QUARTILES))


def duration_stats(df: DataFrame, value: str, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Count, mean, population deviation, minimum, quartiles, maximum per group."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return null_safe_join(base, quantiles(df, list(by), value, QUARTILES), list(by), "left")


# fixed values: lower edges of the duration bins, in minutes
DURATION_EDGES = (0, 5, 10, 15, 30, 60, 120, 240, 480)


def duration_distribution(df: DataFrame, value: str, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Events per right-closed duration bin, empty bins included, with the events outside every bin.

    Edges above the longest duration are left out and the last bin is open; equal durations make a single bin.
    """
    edges = F.array(*[F.lit(float(e)) for e in DURATION_EDGES])
    rows = df.where(F.col(value).isNotNull())
    limits = rows.groupBy(*by).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    limits = limits.withColumns(
        {"_single": F.col("_min") == F.col("_max"), "_edges": F.filter(edges, lambda e: (e <= F.col("_max")) | (e == 0))}
    )
    # edges below the value, counted without the per-group maximum: a value cannot exceed it
    below = reduce(add, [(F.col(value) > float(e)).cast("int") for e in DURATION_EDGES])
    counts = rows.groupBy(*by, below.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_bin") == 0, F.col("n"))), F.lit(0)).alias("outside")
    )
    limits = null_safe_join(limits, totals, list(by), "inner")
    bins = limits.select(*by, "_single", "_max", "_all", "outside", "_edges", F.posexplode("_edges").alias("_pos", "_low"))
    bins = bins.where(~F.col("_single") | (F.col("_pos") == 0)).withColumn("_bin", F.col("_pos") + 1)
    whole = lambda c: c.cast("int").cast("string")
    following = F.get(F.col("_edges"), F.col("_bin"))
    name = (
        F.when(F.col("_single"), F.col("_max").cast("string"))
        .when(following.isNull(), F.concat(whole(F.col("_low")), F.lit("+")))
        .otherwise(F.concat(whole(F.col("_low")), F.lit("-"), whole(following)))
    )
    joined = null_safe_join(bins, counts, [*by, "_bin"], "left")
    events = F.when(F.col("_single"), F.col("_all")).otherwise(F.coalesce("n", F.lit(0)))
    outside = F.when(F.col("_single"), 0).otherwise(F.col("outside"))
    return joined.select(*by, F.col("_pos").alias("position"), name.alias("bin"), events.alias("events"), outside.alias("outside"))


def duration_ecdf(df: DataFrame, value: str, key: list[str], by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Sorted values with the shares ``i / n`` (from 1) and ``i / (n - 1)`` (from 0)."""
    cdf = chunked(df.select(*by, value, *[k for k in key if k not in by]), list(by), [value, *key])
    rows = plain(with_count(with_index(cdf, list(by)), list(by), "_n"))
    return rows.withColumns(
        {"share": (F.col("idx") + 1) / F.col("_n"), "share_from_zero": _ratio(F.col("idx"), F.col("_n") - 1)}
    ).drop("_n")


def fixed_width_histogram(
    df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Equal bins from ``low`` to ``high`` (both included; by default the range of the values), counts and density."""
    rows = df.select(value).where(F.col(value).isNotNull())
    bounds = rows.agg(
        (F.min(value) if low is None else F.lit(float(low))).alias("_low"),
        (F.max(value) if high is None else F.lit(float(high))).alias("_high"),
    )
    # a single value gets bins of total width 1 around it
    flat = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    bounds = bounds.select((F.col("_low") - flat).alias("_low"), (F.col("_high") + flat).alias("_high"))
    inside = scalar_join(rows, bounds).where(F.col(value).between(F.col("_low"), F.col("_high")))
    slot = F.floor((F.col(value) - F.col("_low")) * bins / (F.col("_high") - F.col("_low")))
    counts = inside.groupBy(F.least(slot, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    grid = scalar_join(scalar_join(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), bounds), total)
    width = (F.col("_high") - F.col("_low")) / bins
    joined = grid.join(counts, "bin", "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(
        "bin",
        (F.col("_low") + F.col("bin") * width).alias("left_edge"),
        (F.col("_low") + (F.col("bin") + 1) * width).alias("right_edge"),
        n.alias("n"),
        (n / F.col("_total") / width).alias("density"),
    )


def box_stats(df: DataFrame, value: str, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Quartiles, whiskers at 1.5 times their distance, and outliers beyond them."""
    quart = quantiles(df, list(by), value, QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = quart.withColumns({"_lo": F.col("q1") - reach, "_hi": F.col("q3") + reach})
    joined = null_safe_join(df.select(*by, value), settled(fenced), list(by), "inner")
    v = F.col(value)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("outliers"),
    )


def long_format(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep, column, value`` rows of the numeric columns as doubles, in one scan."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), columns, "column", "value")


def column_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: rows, missing, zeros, their percent, distinct values, and whether it varies."""
    rows = long_format(df, columns or numeric_columns(df))
    per_value = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    total, v, n = F.sum("_n"), F.col("value"), F.col("_n")
    missing = F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0))
    zeros = F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0))
    return per_value.groupBy("column").agg(
        total.alias("total"),
        missing.alias("missing"),
        (missing / total * 100).alias("missing_percent"),
        zeros.alias("zeros"),
        (zeros / total * 100).alias("zero_percent"),
        F.count("value").alias("distinct"),
        (F.count("value") > 1).alias("has_variance"),
    )


def column_stats(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Mean, median, sample deviation, minimum, maximum and quartiles per column and station."""
    rows = long_format(df, columns, by)
    groups = [*by, "column"]
    base = rows.groupBy(*groups).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return null_safe_join(base, quantiles(rows, groups, "value", QUARTILES), groups, "left")


def structure_profile(df: DataFrame, order: list[str]) -> DataFrame:
    """Per column: type, nulls, distinct values, duplicates (``n - distinct``), and the first three values as text."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    per_value = text.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    base = per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.sum("_n").alias("_total"),
    )
    first = df.orderBy(*order).limit(3)
    samples = first.select(*[F.col(c).cast("string").alias(c) for c in df.columns], F.struct(*order).alias("_o"))
    samples = samples.unpivot(["_o"], df.columns, "column", "value").groupBy("column")
    gathered = samples.agg(F.sort_array(F.collect_list(F.struct("_o", "value"))).alias("_s"))  # three entries per column
    joined = base.join(gathered, "column")
    return joined.select(
        "column", F.element_at(kinds, F.col("column")).alias("dtype"), "nulls", "distinct",
        (F.col("_total") - F.col("distinct")).alias("duplicates"),
        F.array_join(F.transform("_s", lambda s: s.getField("value")), ", ").alias("samples"),
    )


def duplicate_profile(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows that occur in full-row duplicates and in duplicates of the key, every copy counted."""
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    keyed = whole.groupBy(*key).agg(
        F.sum("_n").alias("_k"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_w")
    )
    return keyed.agg(
        F.sum("_k").alias("total"),
        F.sum("_w").alias("full_row_duplicates"),
        F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k"))), F.lit(0)).alias("key_duplicates"),
    )


def distinct_text_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct non-null values of the text columns."""
    text = df.select(*columns).unpivot([], columns, "column", "value")
    return text.where(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def time_range(df: DataFrame, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), F.count(F.lit(1)).alias("rows"))


def _profile(df: DataFrame, slot: str, target: str) -> DataFrame:
    rows = time_features(df).select(slot, target)
    base = rows.groupBy(slot).agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    return base.join(quantiles(rows, [slot], target, {"median": 0.5}), slot, "left")


def profile_by_hour(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample deviation and median per hour."""
    return _profile(df, "hour", target)


def profile_by_weekday(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample deviation and median per weekday (0 = Monday)."""
    return _profile(df, "day_of_week", target)


def profile_by_week_hour(df: DataFrame, target: str) -> DataFrame:
    """Mean per hour of the week."""
    return time_features(df).groupBy("hour_of_week").agg(F.avg(target).alias("mean"))


def heatmap_day_hour(df: DataFrame, target: str) -> DataFrame:
    """Weekday by hour matrix of means, columns ``h0`` to ``h23``."""
    pivoted = time_features(df).groupBy("day_of_week").pivot("hour", list(range(24))).avg(target)
    return pivoted.select("day_of_week", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(24)])


def workday_weekend_profile(df: DataFrame, target: str) -> DataFrame:
    return time_features(df).groupBy("is_weekend", "hour").agg(F.avg(target).alias("mean"))


def variation_by_hour(df: DataFrame, target: str) -> DataFrame:
    """Sample deviation over mean, per hour."""
    return time_features(df).groupBy("hour").agg(F.try_divide(F.stddev_samp(target), F.avg(target)).alias("variation"))


def periodicity_summary(df: DataFrame, target: str) -> DataFrame:
    """Overall statistics, peak and low hour and day, workday and weekend means, in one row."""
    t = F.col(target)
    base = df.agg(
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"),
        F.try_divide(F.stddev_samp(t), F.avg(t)).alias("variation"),
    )
    week = time_features(df).groupBy("day_of_week", "hour").agg(F.sum(t).alias("_s"), F.count(t).alias("_n"))
    mean = F.try_divide(F.sum("_s"), F.sum("_n"))
    hours = week.groupBy("hour").agg(mean.alias("_m")).agg(
        F.max_by("hour", "_m").alias("peak_hour"), F.min_by("hour", "_m").alias("low_hour"),
        (F.max("_m") - F.min("_m")).alias("hour_spread"),
    )
    days = week.groupBy("day_of_week").agg(mean.alias("_m")).agg(
        F.max_by("day_of_week", "_m").alias("peak_day"), F.min_by("day_of_week", "_m").alias("low_day")
    )
    weekend = F.col("day_of_week") >= 5
    mean_where = lambda c: F.try_divide(F.sum(F.when(c, F.col("_s"))), F.sum(F.when(c, F.col("_n"))))
    halves = week.agg(mean_where(~weekend).alias("workday_mean"), mean_where(weekend).alias("weekend_mean"))
    halves = halves.withColumn("workday_weekend_ratio", F.try_divide("workday_mean", "weekend_mean"))
    return scalar_join(scalar_join(scalar_join(base, hours), days), halves)


def _cross_sums(features: list[str]):
    """Sums over the rows of a batch for every pair of features, each pair over the rows that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = len(features), None
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i).cast(pa.float64()).fill_null(np.nan)) for i in range(p)], 1) if p else np.zeros((0, 0))
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            for i in range(p):  # one row per feature: a task's result has a fixed size
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([row.tolist()], pa.list_(pa.float64())) for row in total[:, i]]], ["i", "n", "sa", "sb", "qa", "qb", "ab"])

    return run


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson matrix as ``a, b, r`` rows, from two passes over the data however many features there are.

    Each pair uses the rows that have both features. Features are centred on their means first, so sums of products
    stay exact enough; tasks add up matrix products and send one row per feature.
    """
    means = df.agg(*[F.avg(f).cast("double").alias(f"_mean_{i}") for i, f in enumerate(features)])
    centred = scalar_join(df.select(*features), means).select(*[(F.col(f).cast("double") - F.col(f"_mean_{i}")).alias(f) for i, f in enumerate(features)])
    names = ["n", "sa", "sb", "qa", "qb", "ab"]
    parts = centred.mapInArrow(_cross_sums(features), "i int, " + ", ".join(f"{c} array<double>" for c in names))
    cells = parts.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "z")).groupBy("i", "j").agg(*[F.sum(f"z.{c}").alias(c) for c in names])
    n = F.col("n")
    cross = F.col("ab") - F.col("sa") * F.col("sb") / n
    spread = (F.col("qa") - F.col("sa") ** 2 / n) * (F.col("qb") - F.col("sb") ** 2 / n)
    r = F.when(n > 1, F.when(spread > 0, cross / F.sqrt(spread)).otherwise(F.lit(float("nan"))))
    name = F.array(*[F.lit(f) for f in features])
    return cells.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), r.alias("r"))


def high_correlations(matrix: DataFrame, features: list[str], limit: float = 0.8) -> DataFrame:
    """Pairs of different features with absolute correlation above the limit, strongest first."""
    place = F.create_map(*[F.lit(x) for i, f in enumerate(features) for x in (f, i)])
    upper = F.element_at(place, F.col("a")) < F.element_at(place, F.col("b"))
    return matrix.where(upper & (F.abs("r") > limit)).orderBy(F.abs("r").desc(), "a", "b")


def target_correlations(df: DataFrame, features: list[str], label: str = "label", top: int = 10) -> DataFrame:
    """Correlation with the label, strongest first."""
    row = df.agg(*[F.corr(f, label).alias(f"r__{f}") for f in features])
    scores = unpivoted(row, features, ["r"]).withColumnRenamed("column", "feature")
    return scores.withColumn("abs_r", F.abs("r")).orderBy(F.col("abs_r").desc_nulls_last(), "feature").limit(top)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    return scalar_join(counts, totals).select(label, "n", (F.col("_total") / (F.col("_classes") * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive, 0 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("n_positive"), neg.alias("n_negative"), F.coalesce(_ratio(neg, pos), F.lit(0.0)).alias("positive_weight")
    )
