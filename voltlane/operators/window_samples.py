"""Choice of complete normal and anomalous windows for spectral comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.operators.intervals import normal_points_buffered, seconds_between
from voltlane.plans.joins import interval_join
from voltlane.plans.ordering import hash_key, settled

STATION, TS = "station", "ts"


def _later(start: Column, micros: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + micros)


def _complete(candidates: DataFrame, readings: DataFrame, size: int, needed: float, n: int) -> DataFrame:
    """Candidates whose half-open window holds enough readings, first ``n`` in hash order."""
    spans = candidates.withColumn("_end", _later(F.col("window_start"), size * 1_000_000 - 1))
    found = interval_join(readings.select(STATION, TS), spans, start="window_start", end="_end")
    counted = found.groupBy(STATION, "window_start", "_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    chosen = counted.where(F.col("n_rows") >= needed).orderBy("_hash", STATION, "window_start").limit(n)
    end = _later(F.col("window_start"), size * 1_000_000).alias("window_end")
    return chosen.select(STATION, "window_start", end, "n_rows")


def sample_normal_windows(
    readings: DataFrame, intervals: DataFrame, size_seconds: int = 3600, n: int = 20, expected: int | None = None,
    minutes: float = 10, attempts: int | None = None, seed: int = 42,
) -> DataFrame:
    """Windows that start at normal readings and hold at least 95 % of their rows.

    Like drawing starts at random with ``10 n`` attempts: the first candidates in hash order are tried, and the
    first ``n`` complete ones are kept.
    """
    needed = (size_seconds if expected is None else expected) * 0.95
    normal = normal_points_buffered(readings.select(STATION, TS), intervals, minutes)
    keyed = normal.distinct().withColumn("_micros", F.unix_micros(TS)).withColumn("_hash", hash_key(STATION, "_micros", seed=seed))
    tried = keyed.orderBy("_hash", STATION, TS).limit(attempts or n * 10)
    candidates = settled(tried.select(STATION, F.col(TS).alias("window_start"), "_hash"))
    return _complete(candidates, readings, size_seconds, needed, n)


def sample_anomaly_windows(
    readings: DataFrame, intervals: DataFrame, size_seconds: int = 3600, n: int = 20, expected: int | None = None, seed: int = 42
) -> DataFrame:
    """Up to ``n`` intervals of at least the window length, each with a window at a hashed offset, kept if complete."""
    needed = (size_seconds if expected is None else expected) * 0.95
    length = seconds_between("start_ts", "end_ts")
    usable = intervals.where(length >= size_seconds).withColumn("_micros", F.unix_micros("start_ts"))
    keyed = usable.withColumn("_hash", hash_key(STATION, "_micros", seed=seed))
    tried = keyed.orderBy("_hash", STATION, "start_ts").limit(n)
    room = F.floor(length - size_seconds).cast("long")
    draw = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    offset = F.when(room > 0, draw % F.greatest(room, F.lit(1))).otherwise(F.lit(0))
    candidates = tried.select(STATION, _later(F.col("start_ts"), offset * 1_000_000).alias("window_start"), "_hash")
    return _complete(settled(candidates), readings, size_seconds, needed, n)


def readings_of_windows(readings: DataFrame, windows: DataFrame, label: str) -> DataFrame:
    """Readings of every chosen window with its start and class; a reading in two windows appears twice."""
    spans = windows.select(STATION, "window_start", _later(F.col("window_end"), -1).alias("_end"))
    joined = interval_join(readings, spans, start="window_start", end="_end")
    return joined.drop("_end").withColumn("class", F.lit(label))
