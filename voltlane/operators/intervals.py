"""Downtime intervals: merging, overlaps, labels and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.plans.joins import BROADCAST_ROWS, inside_any, interval_join, small_enough, unused
from voltlane.plans.ordering import chunked, null_safe_join, plain, settled, with_index, with_neighbours, with_running

STATION, START, END = "station", "start_ts", "end_ts"


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Difference in seconds, as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def merge_intervals(intervals: DataFrame, part: str = STATION, start: str = START, end: str = END) -> DataFrame:
    """Union of overlapping or touching intervals per station."""
    cdf = chunked(intervals.select(part, start, end), [part], [start, end])
    seen = with_running(cdf, [part], {"_reach": ("max", end)}, inclusive=False)
    fresh = F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)
    islands = with_running(seen.withColumn("_fresh", fresh), [part], {"_island": ("sum", "_fresh")})
    return (
        islands.groupBy(part, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def sorted_intervals(intervals: DataFrame, part: str = STATION, start: str = START, end: str = END) -> DataFrame:
    """Intervals per station in start order, unmerged, with their position."""
    cdf = chunked(intervals.select(part, start, end), [part], [start, end])
    return plain(with_index(cdf, [part], "position"))


def adjacent_overlaps(intervals: DataFrame, part: str = STATION, start: str = START, end: str = END) -> DataFrame:
    """Neighbours in start order whose ranges overlap or touch, with both ranges, positions and seconds."""
    cdf = chunked(intervals.select(part, start, end), [part], [start, end])
    rows = with_index(cdf, [part], "first_index")
    rows = with_neighbours(rows, [part], after={"second_start": start, "second_end": end})
    return rows.where(F.col(end) >= F.col("second_start")).select(
        part,
        "first_index",
        F.col(start).alias("first_start"),
        F.col(end).alias("first_end"),
        (F.col("first_index") + 1).alias("second_index"),
        "second_start",
        "second_end",
        seconds_between("second_start", end).alias("overlap_seconds"),
    )


def overlap_summary(intervals: DataFrame, part: str = STATION, start: str = START, end: str = END) -> DataFrame:
    """Ranges, overlapping neighbours and summed overlap per station."""
    cdf = chunked(intervals.select(part, start, end), [part], [start, end])
    rows = with_neighbours(cdf, [part], after={"_next": start})
    hit = F.col(end) >= F.col("_next")
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("total_ranges"),
        F.count_if(hit).alias("overlaps"),
        F.coalesce(F.sum(F.when(hit, seconds_between("_next", end))), F.lit(0.0)).alias("overlap_seconds"),
    )


def interval_durations(intervals: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Intervals with their length in seconds and minutes, each rounded once: lengths that are equal to a bound compare as equal."""
    minutes = (F.unix_micros(end) - F.unix_micros(start)) / 60_000_000.0
    return intervals.withColumns({"duration_seconds": seconds_between(start, end), "duration_minutes": minutes})


def _merged_small(intervals: DataFrame) -> DataFrame:
    """``merge_intervals`` for a table known to be small: windows over its stations, without tables in between."""
    line = Window.partitionBy(STATION).orderBy(START, END)
    reach = F.max(END).over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_fresh", F.when(F.col(START) <= reach, 0).otherwise(1))
    island = F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_island", island).groupBy(STATION, "_island").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("_island")


def label_points_by_interval(
    points: DataFrame, intervals: DataFrame, label: str = "anomaly_label", *, merged: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """1 where some interval of the station contains the point, both ends closed; else 0.

    Merging first makes the intervals disjoint, so a point meets at most one. A table of intervals that is small
    enough is joined without moving the points; a larger one is put in order with them, or, where the points are a
    stream, joined by the nodes of the covers. Intervals without a station or a bound, or that end before they start, hold
    no point. The points may have any other columns, those of the intervals included.
    """
    whole = intervals.where(F.col(STATION).isNotNull() & (F.col(START) <= F.col(END))).select(STATION, START, END)
    whole = settled(whole)
    if small_enough(whole, max_broadcast_rows):
        return inside_any(points, whole if merged else _merged_small(whole), label)
    disjoint = whole if merged else merge_intervals(whole)
    return inside_any(points, disjoint, label) if points.isStreaming else _label_in_order(points, disjoint, label)


def _label_in_order(points: DataFrame, disjoint: DataFrame, label: str) -> DataFrame:
    """Label by the last interval that starts at or before the point: one balanced sort, whatever the skew."""
    p = unused("_o", points.columns)
    row = F.struct(*[F.col(c) for c in points.columns]).alias(f"{p}_row")
    rows = points.select(STATION, F.col("ts").alias(f"{p}_ts"), F.lit(1).alias(f"{p}_kind"), row)
    starts = disjoint.select(STATION, F.col(START).alias(f"{p}_ts"), F.lit(0).alias(f"{p}_kind"), F.col(END).alias(f"{p}_end"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    cdf = chunked(both, [STATION], [f"{p}_ts", f"{p}_kind"])
    seen = with_running(cdf, [STATION], {f"{p}_open": ("last", f"{p}_end")}).where(F.col(f"{p}_kind") == 1)
    inside = F.coalesce(F.col(f"{p}_ts") <= F.col(f"{p}_open"), F.lit(False))
    return seen.select(*[F.col(f"{p}_row.`{c}`").alias(c) for c in points.columns], inside.cast("int").alias(label))


def readings_in_interval(points: DataFrame, intervals: DataFrame, **join: object) -> DataFrame:
    """Each reading once per interval that contains it, marked as anomaly."""
    return interval_join(points, intervals, "inner", **join).withColumn("anomaly", F.lit(1))


def interval_coverage(
    intervals: DataFrame,
    readings: DataFrame,
    station_map: dict[str, str],
    *,
    key: list[str],
    full_share: float = 0.95,
    log_station: str = "station",
) -> DataFrame:
    """Readings inside every interval, the expected count, a status, and the first and last reading time.

    ``key`` identifies an interval; ``station_map`` translates log stations to reading stations.
    """
    lookup = F.create_map(*[F.lit(x) for pair in station_map.items() for x in pair])
    mapped = intervals.withColumn("_to", F.element_at(lookup, F.col(log_station)))
    sides = mapped.select(*key, F.col("_to").alias("station"), START, END).where("station is not null")
    matched = interval_join(readings.select("station", "ts"), sides, "inner")
    found = matched.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_found"), F.min("ts").alias("first_reading"), F.max("ts").alias("last_reading")
    )
    out = null_safe_join(mapped, found, key, "left")
    count = F.coalesce("_found", F.lit(0)).cast("long")
    expected = F.floor(seconds_between(START, END)).cast("long") + 1
    status = (
        F.when(F.col("_to").isNull(), "unknown_station")
        .when(count == 0, "none")
        .when(count >= expected * F.lit(full_share), "full")
        .otherwise("partial")
    )
    return out.select(
        *intervals.columns, count.alias("found"), expected.alias("expected"), status.alias("status"),
        "first_reading", "last_reading",
    )


def coverage_first_last(coverage: DataFrame) -> DataFrame:
    """First and last reading of the partly covered intervals."""
    return coverage.where("status = 'partial'").select(STATION, START, END, "first_reading", "last_reading")


def buffered(intervals: DataFrame, minutes: float = 10, start: str = START, end: str = END) -> DataFrame:
    """Intervals widened on both sides."""
    pad = int(minutes * 60_000_000)
    return intervals.withColumns(
        {start: F.timestamp_micros(F.unix_micros(start) - pad), end: F.timestamp_micros(F.unix_micros(end) + pad)}
    )


def normal_points_buffered(
    points: DataFrame, intervals: DataFrame, minutes: float = 10, max_broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Points outside every widened interval."""
    marked = label_points_by_interval(
        points, buffered(intervals, minutes), "_inside", max_broadcast_rows=max_broadcast_rows
    )
    return marked.where("_inside = 0").drop("_inside")


def align_scores(scores: DataFrame, methods: list[str], feature: str = "feature") -> DataFrame:
    """Long ``method, feature, score`` to one row per feature with a column per method; missing stays null."""
    return scores.groupBy(feature).pivot("method", methods).agg(F.first("score"))
