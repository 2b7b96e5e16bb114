"""Projections, filters and cleaning of readings and downtime logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.functions.columns import (
    clock_change, column_intersection, downtime_seconds, feature_columns, finite, local_to_utc, numeric_columns,
    title_case, unpivoted,
)
from voltlane.plans.joins import scalar_join
from voltlane.plans.ordering import chunked, null_safe_join, plain, settled, with_index, with_running
from voltlane.session import shared_path


def clean_text_fields(
    log: DataFrame, titled: tuple[str, ...] = ("Condition", "Station", "Line", "Shift"), trimmed: tuple[str, ...] = ("Comment",)
) -> DataFrame:
    """Trim and title-case the categorical fields, trim the comment."""
    changes = {c: title_case(F.trim(c)) for c in titled if c in log.columns}
    changes |= {c: F.trim(c) for c in trimmed if c in log.columns}
    return log.withColumns(changes)


def parse_local_timestamp(log: DataFrame, column: str = "Date", target: str = "StartTime") -> DataFrame:
    """Berlin wall-clock text to UTC, with a flag for times the clock change makes ambiguous or skips."""
    return log.withColumns({target: local_to_utc(F.col(column)), "dst_ambiguous": clock_change(F.col(column))})


def parse_downtime(log: DataFrame, column: str = "Downtime", target: str = "DowntimeSeconds") -> DataFrame:
    return log.withColumn(target, downtime_seconds(F.col(column)))


def derive_end_time(
    log: DataFrame, start: str = "StartTime", seconds: str = "DowntimeSeconds", target: str = "EndTime"
) -> DataFrame:
    """``start + downtime``; null when either is."""
    micros = F.round(F.col(seconds) * 1_000_000).cast("long")
    return log.withColumn(target, F.timestamp_micros(F.unix_micros(start) + micros))


def clean_log(log: DataFrame) -> DataFrame:
    """Text, start, downtime and end in one projection."""
    return derive_end_time(parse_downtime(parse_local_timestamp(clean_text_fields(log))))


def validate_intervals(
    log: DataFrame, start: str = "StartTime", end: str = "EndTime", seconds: str = "DowntimeSeconds"
) -> DataFrame:
    """Null counts, reversed rows, time range and downtime statistics in one pass."""
    return log.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(start).isNull()).alias("null_start"),
        F.count_if(F.col(end).isNull()).alias("null_end"),
        F.count_if(F.col(seconds).isNull()).alias("null_downtime"),
        F.count_if(F.col(end) < F.col(start)).alias("reversed"),
        F.min(start).alias("first_start"),
        F.max(end).alias("last_end"),
        F.avg(seconds).alias("mean_downtime"),
        F.min(seconds).alias("min_downtime"),
        F.max(seconds).alias("max_downtime"),
    )


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """The frame itself; raises when named columns are missing."""
    missing = column_intersection(df, required)[1]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def to_utc(df: DataFrame, column: str = "ts") -> DataFrame:
    """Time column as UTC timestamp, whatever it was; unreadable text becomes null."""
    if dict(df.dtypes)[column] == "string":
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def drop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Drop the columns that exist; also returns the missing ones."""
    present, missing = column_intersection(df, names)
    return df.drop(*present), missing


def drop_low_variance_columns(df: DataFrame, threshold: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop numeric columns with sample variance at or below the threshold; all-null columns stay."""
    columns = numeric_columns(df, keep)
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] <= threshold])


def drop_constant_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns with at most one distinct non-null value."""
    columns = feature_columns(df, keep)
    row = df.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not row[c]])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows before and after full-row de-duplication, from one aggregation."""
    groups = df.groupBy(*df.columns).count()
    return groups.agg(F.sum("count").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))


def drop_non_finite_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows whose features are all finite; the label goes with its row."""
    columns = columns or numeric_columns(df)
    return df.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns]))


def non_finite_to_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities to 0; nulls count as NaN."""
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)).otherwise(F.lit(0.0)) for c in columns})


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null features to the mean of their column."""
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = scalar_join(df, means)
    return joined.select(
        *[F.coalesce(c, f"_mean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def time_grid(df: DataFrame, part: list[str], ts: str, seconds: int) -> DataFrame:
    """Regular grid per part from its first to its last time; made in pieces of 4096 slots, spread over tasks."""
    step, piece = seconds * 1_000_000, 4096
    bounds = df.groupBy(*part).agg(F.unix_micros(F.min(ts)).alias("_a"), F.unix_micros(F.max(ts)).alias("_b"))
    slots = F.floor((F.col("_b") - F.col("_a")) / F.lit(step)).cast("long")
    pieces = bounds.select(*part, "_a", slots.alias("_n")).withColumn(
        "_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / piece).cast("long")))
    )
    spread = pieces.repartition(*part, "_p")
    last = F.least(F.col("_p") * piece + piece - 1, F.col("_n"))
    slot = F.explode(F.sequence(F.col("_p") * piece, last)).alias("slot")
    return spread.select(*part, "_a", slot).select(
        *part, "slot", F.timestamp_micros(F.col("_a") + F.col("slot") * step).alias(ts)
    )


def regularise_ffill(
    df: DataFrame, columns: list[str], seconds: int = 60, part: list[str] | None = None, ts: str = "ts", tie: tuple[str, ...] = ()
) -> DataFrame:
    """Regular grid per part; each slot takes the last values at or before it."""
    part = ["station"] if part is None else part
    grid = time_grid(df, part, ts, seconds)
    observed = df.select(*part, ts, *tie, F.struct(*columns).alias("_row"), F.lit(0).alias("_kind"))
    empty = grid.select(*part, "slot", ts, F.lit(1).alias("_kind"))
    both = observed.unionByName(empty, allowMissingColumns=True)
    cdf = chunked(both, part, [ts, "_kind", *tie])
    filled = with_running(cdf, part, {"_last": ("last", "_row")}).where("_kind = 1")
    return plain(filled).select(*part, "slot", ts, *[F.col(f"_last.{c}").alias(c) for c in columns])


def interpolate_linear(
    df: DataFrame, window: list[str], order: list[str], column: str, min_rows: int = 100
) -> DataFrame:
    """Linear in the row position inside each window, ends filled with the nearest value.

    Windows with fewer than ``min_rows`` rows or no value are dropped.
    """
    value = F.col(column)
    sizes = df.groupBy(*window).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"))
    usable = settled(sizes.where((F.col("_n") >= min_rows) & (F.col("_known") > 0)).select(*window))
    cdf = chunked(null_safe_join(df, usable, window, "left_semi"), window, order)
    known = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col("_pos").alias("p")))
    placed = with_index(cdf, window, "_pos")
    placed = with_running(placed, window, {"_back": ("last", known)})
    placed = with_running(placed, window, {"_ahead": ("last", known)}, backward=True)
    v0, p0, v1, p1 = F.col("_back.v"), F.col("_back.p"), F.col("_ahead.v"), F.col("_ahead.p")
    between = v0 + (v1 - v0) * (F.col("_pos") - p0) / (p1 - p0)
    filled = F.coalesce(value, F.when(p1 > p0, between), v1, v0)
    return placed.select(*[c for c in df.columns if c != column], filled.alias(column))


def filter_station(
    df: DataFrame, station: str, order: list[str], limit: int | None = None, column: str = "station"
) -> DataFrame:
    """Rows of one station by start; raises when there are none. ``limit`` is the preview size."""
    rows = df.where(F.col(column) == station)
    if rows.isEmpty():
        raise ValueError(f"no rows for station {station!r}")
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def select_numeric_features(df: DataFrame, exclude: tuple[str, ...] = ("ts", "anomaly_label")) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def select_features(df: DataFrame, required: list[str], wanted: list[str]) -> DataFrame:
    """Required columns plus the wanted ones that exist."""
    return require_columns(df, required).select(*required, *[c for c in column_intersection(df, wanted)[0] if c not in required])


def exclude_columns(df: DataFrame, excluded: list[str], label: str = "anomaly_label") -> DataFrame:
    """All columns but the excluded ones and the label."""
    return df.select(*feature_columns(df, [*excluded, label]))


# fixed values: log station (lower case) to energy table name
STATION_NAMES = {"pcb": "PCB", "ringmontage": "Ring", "kontaktieren": "Contacting"}


def map_station(
    df: DataFrame, column: str = "station", target: str = "energy_station", names: dict[str, str] | None = None, unknown: str = "unknown_station"
) -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for pair in (names or STATION_NAMES).items() for x in pair])
    return df.withColumn(target, F.coalesce(F.element_at(lookup, F.lower(column)), F.lit(unknown)))


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday (0 = Monday), day of year, month, ISO week, weekend flag, minute of day, hour of week."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": weekday,
            "day_of_year": F.dayofyear(ts),
            "month": F.month(ts),
            "week": F.weekofyear(ts),
            "is_weekend": (weekday >= 5).cast("int"),
            "minute_of_day": hour * 60 + F.minute(ts),
            "hour_of_week": weekday * 24 + hour,
        }
    )


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, mean, scale`` with the population deviation; a deviation of 0 becomes 1."""
    aggregates = []
    for c in columns:
        deviation = F.stddev_pop(c)
        aggregates += [F.avg(c).alias(f"mean__{c}"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"scale__{c}")]
    return unpivoted(df.agg(*aggregates), columns, ["mean", "scale"]).withColumnRenamed("column", "feature")


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / scale`` with a fitted scaler; the scaler is one row per feature."""
    wide = scaler.where(F.col("feature").isin(columns)).agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_s_{c}") for c in columns]
    )
    joined = scalar_join(df, wide)
    return joined.select(
        *[
            ((F.col(c) - F.col(f"_s_{c}.mean")) / F.col(f"_s_{c}.scale")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (the training part) and apply to ``df``."""
    return apply_scaler(df, fit_scaler(df if fit_on is None else fit_on, columns), columns)


def save_scaler(scaler: DataFrame, path: str | None = None) -> str:
    """Write a fitted scaler; returns where."""
    path = path or shared_path(scaler.sparkSession, "scaler")
    scaler.write.mode("overwrite").parquet(path)
    return path


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.schema("feature string, mean double, scale double").parquet(path)


def identity_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaler that changes nothing, for tree models."""
    return df.sparkSession.createDataFrame([(c, 0.0, 1.0) for c in columns], "feature string, mean double, scale double")


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: type, total rows and nulls, from one pass."""
    total = F.count(F.lit(1))
    aggregates = []
    for name, kind in df.dtypes:
        aggregates += [total.alias(f"total_rows__{name}"), (total - F.count(name)).alias(f"nulls__{name}")]
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    report = unpivoted(df.agg(*aggregates), df.columns, ["total_rows", "nulls"])
    return report.withColumn("dtype", F.element_at(kinds, F.col("column")))
