"""Resampling, sliding windows, sequences, gaps and seasonal components."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions.columns import floor_to
from voltlane.operators.intervals import seconds_between
from voltlane.plans.ordering import chunked, null_safe_join, plain, quantiles, settled, with_count, with_index, with_neighbours

STATION, TS, LABEL = "station", "ts", "anomaly_label"


def downsample_time(
    df: DataFrame, channels: list[str], seconds: int = 60, station: str = STATION, ts: str = TS
) -> DataFrame:
    """Mean of every channel per slot, labelled by its start; slots without any value are dropped."""
    step = seconds * 1_000_000
    slot = F.timestamp_micros(floor_to(F.unix_micros(ts), step)).alias(ts)
    means = df.groupBy(station, slot).agg(*[F.avg(c).alias(c) for c in channels])
    return means.dropna("all", subset=channels)


def assign_windows(
    df: DataFrame, size_seconds: int, step_seconds: int, station: str = STATION, ts: str = TS
) -> DataFrame:
    """One row per reading and sliding window that holds it.

    Windows start at the station's first reading, every ``step``, as long as they end by its last one. The windows
    of a reading follow from its distance to the first, so nothing is searched.
    """
    placed = null_safe_join(df, _bounds(df, station, ts), [station], "inner")
    return _held(placed, F.unix_micros(ts) - F.col("_a"), size_seconds * 1_000_000, step_seconds * 1_000_000)


class SlidingWindows:
    """Settings of a sliding-window table: sizes, the expected rows per window, and the order inside one.

    Rows are summed up by panes, the stretches of ``gcd(size, step)`` seconds of which every window is a whole number, so
    what is copied into each window that holds it is one row per pane. Panes of up to ``max_rows`` rows may be put in order in
    one task, and windows of up to ``max_rows`` rows may be arrays; larger ones are always spread.
    """

    def __init__(
        self,
        size_seconds: int,
        step_seconds: int,
        expected: int | None = None,
        min_share: float = 0.8,
        station: str = STATION,
        ts: str = TS,
        tie: tuple[str, ...] = (),
        max_rows: int = 1_000_000,
    ) -> None:
        self.size_seconds, self.step_seconds, self.max_rows = size_seconds, step_seconds, max_rows
        self.min_rows = int((size_seconds if expected is None else expected) * min_share)
        self.station, self.ts, self.tie = station, ts, tie

    @property
    def keys(self) -> list[str]:
        return [self.station, "window_id", "window_start"]

    @property
    def pane(self) -> list[str]:
        return [self.station, "_pane", "_a", "_b"]

    def rows(self, df: DataFrame) -> DataFrame:
        return assign_windows(df, self.size_seconds, self.step_seconds, self.station, self.ts)

    def placed(self, df: DataFrame) -> DataFrame:
        """Rows with the number of their pane, and the station's first and last time in microseconds."""
        width = gcd(self.size_seconds, self.step_seconds) * 1_000_000
        out = null_safe_join(df, _bounds(df, self.station, self.ts), [self.station], "inner")
        return out.withColumn("_pane", F.floor((F.unix_micros(self.ts) - F.col("_a")) / width).cast("long"))

    def in_windows(self, panes: DataFrame) -> DataFrame:
        """One row per pane and window that holds it."""
        width = gcd(self.size_seconds, self.step_seconds) * 1_000_000
        return _held(panes, F.col("_pane") * width, self.size_seconds * 1_000_000, self.step_seconds * 1_000_000)

    def aggregate(self, panes: DataFrame, *columns: Column) -> DataFrame:
        """Aggregate per window over its panes, keeping windows with enough rows (``_n`` of a pane)."""
        out = self.in_windows(panes).groupBy(*self.keys).agg(F.sum("_n").alias("_rows"), *columns)
        return out.where(F.col("_rows") >= self.min_rows).drop("_rows")

    def counted(self, placed: DataFrame) -> tuple[DataFrame, int]:
        """``keys, _rows`` of the windows with enough rows, and the largest of these numbers."""
        panes = settled(placed.groupBy(*self.pane).agg(F.count(F.lit(1)).alias("_n")))
        counts = self.in_windows(panes).groupBy(*self.keys).agg(F.sum("_n").alias("_rows")).where(F.col("_rows") >= self.min_rows)
        return counts, counts.agg(F.max("_rows")).first()[0] or 0

    def huge_rows(self, df: DataFrame, counts: DataFrame) -> DataFrame:
        """Rows of the windows that no task can hold, with their window."""
        huge = settled(counts.where(F.col("_rows") > self.max_rows).select(*self.keys))
        return null_safe_join(self.rows(df), huge, self.keys, "left_semi")

    def ordered(self, placed: DataFrame, channels: list[str], spread: bool) -> DataFrame:
        """Rows with their position in the pane and each channel's previous value there; ``spread`` orders them in balanced chunks."""
        if spread:
            cdf = with_index(chunked(placed, self.pane, [self.ts, *self.tie]), self.pane, "_pos")
            return plain(with_neighbours(cdf, self.pane, {f"_prev_{c}": c for c in channels}))
        line = Window.partitionBy(*self.pane).orderBy(self.ts, *self.tie)
        added = {"_pos": F.row_number().over(line) - 1} | {f"_prev_{c}": F.lag(c).over(line) for c in channels}
        return placed.withColumns(added)


def _bounds(df: DataFrame, station: str, ts: str) -> DataFrame:
    micros = F.unix_micros(ts)
    return settled(df.groupBy(station).agg(F.min(micros).alias("_a"), F.max(micros).alias("_b")))


def _held(rows: DataFrame, offset: Column, size: int, step: int) -> DataFrame:
    """Rows at ``offset`` after the station's first time ``_a``, once for each window that holds them."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((offset - size) / step).cast("long") + 1)
    last = F.least(F.floor(offset / step).cast("long"), F.floor((F.col("_b") - F.col("_a") - size) / step).cast("long"))
    staged = rows.withColumns({"_i": first, "_j": last}).where("_j >= _i")
    exploded = staged.withColumn("window_id", F.explode(F.sequence("_i", "_j")))
    start = F.timestamp_micros(F.col("_a") + F.col("window_id") * step)
    return exploded.withColumn("window_start", start).drop("_a", "_b", "_i", "_j")


def sliding_windows(df: DataFrame, spec: SlidingWindows) -> DataFrame:
    """The windows that hold enough rows, with their row count and end."""
    panes = spec.placed(df).groupBy(*spec.pane).agg(F.count(F.lit(1)).alias("_n"))
    counted = spec.aggregate(panes, F.sum("_n").alias("n_rows"))
    end = F.timestamp_micros(F.unix_micros("window_start") + spec.size_seconds * 1_000_000)
    return counted.withColumn("window_end", end)


class WindowStatistics:
    """Statistics of windows from summaries of their panes, merged by the formulas for central moments and co-moments.

    A pane keeps the count, mean, second and third central sums of each channel, its extremes, and where rows are in order the
    first and last value, the largest step, and the co-moments with the position. The mean of a window is known
    before its panes are merged, so nothing is lost by subtracting large sums.
    """

    def __init__(self, spec: SlidingWindows, channels: list[str], ordered: bool = False, label: str | None = None, share: float = 0.3):
        self.spec, self.channels, self.is_ordered, self.label, self.share = spec, channels, ordered, label, share

    def panes(self, rows: DataFrame, *more: Column) -> DataFrame:
        ts, out = F.unix_micros(self.spec.ts), [F.count(F.lit(1)).alias("_n")]
        out += [F.min(ts).alias("_t0"), F.max(ts).alias("_t1")]
        if self.label:
            out += [F.sum(self.label).alias("_hits"), F.count(self.label).alias("_known")]
        for c in self.channels:
            n, var = F.count(c), F.var_pop(c)
            cubed = F.coalesce(F.skewness(c), F.lit(0.0)) * F.pow(var, F.lit(1.5)) * n
            out += [n.alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), (var * n).alias(f"_s2_{c}"), cubed.alias(f"_s3_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
            if self.is_ordered:
                pos = F.when(F.col(c).isNotNull(), F.col("_pos").cast("double"))
                out += [F.avg(pos).alias(f"_pm_{c}"), (F.var_pop(pos) * n).alias(f"_p2_{c}"), (F.covar_pop(c, pos) * n).alias(f"_pc_{c}")]
                out.append(F.max(F.abs(F.col(c) - F.col(f"_prev_{c}"))).alias(f"_step_{c}"))
        if self.is_ordered:
            ends = F.struct(*[F.col(c) for c in self.channels])
            out += [F.min_by(ends, "_pos").alias("_first"), F.max_by(ends, "_pos").alias("_last")]
        return rows.groupBy(*self.spec.pane).agg(*out, *more)

    def windows(self, panes: DataFrame) -> DataFrame:
        """Panes in their windows, with the window's means and, in order, the rows and the value before each pane."""
        whole = Window.partitionBy(*self.spec.keys)
        line = whole.orderBy("_pane")
        rows = self.spec.in_windows(panes).withColumn("_all", F.sum("_n").over(whole)).where(F.col("_all") >= self.spec.min_rows)
        mean = lambda x, c: F.sum(F.col(f"_n_{c}") * x).over(whole) / F.nullif(F.sum(f"_n_{c}").over(whole), F.lit(0))
        rows = rows.withColumns({f"_mean_{c}": mean(F.col(f"_m_{c}"), c) for c in self.channels})
        if self.is_ordered:
            before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rows = rows.withColumns({"_before": before, "_prior": F.lag("_last").over(line)})
            rows = rows.withColumns({f"_place_{c}": F.col("_before") + F.col(f"_pm_{c}") for c in self.channels})
            rows = rows.withColumns({f"_mid_{c}": mean(F.col(f"_place_{c}"), c) for c in self.channels})
        return rows

    def _central(self, c: str) -> tuple[Column, Column, Column]:
        """Rows, and second and third central sums of a channel in the window."""
        n, d, s2 = F.col(f"_n_{c}"), F.col(f"_m_{c}") - F.col(f"_mean_{c}"), F.col(f"_s2_{c}")
        return F.sum(n), F.sum(s2 + n * d * d), F.sum(F.col(f"_s3_{c}") + 3 * d * s2 + n * d * d * d)

    def mean_std(self) -> list[Column]:
        out = []
        for c in self.channels:
            n, m2, _ = self._central(c)
            out += [F.max(f"_mean_{c}").alias(f"{c}_mean"), F.sqrt(m2 / F.nullif(n, F.lit(0))).alias(f"{c}_std")]
        return out

    def skew(self) -> list[Column]:
        out = []
        for c in self.channels:
            n, m2, m3 = self._central(c)
            var = m2 / F.nullif(n, F.lit(0))
            out.append(F.when(F.sqrt(var) > 1e-10, m3 / n / F.pow(var, F.lit(1.5))).otherwise(F.lit(0.0)).alias(f"{c}_skew"))
        return out

    def change_point(self) -> list[Column]:
        step = lambda c: F.greatest(f"_step_{c}", F.abs(F.col(f"_first.`{c}`") - F.col(f"_prior.`{c}`")))
        return [F.coalesce(F.max(step(c)), F.lit(0.0)).alias(f"{c}_change_point_score") for c in self.channels]

    def slope(self) -> list[Column]:
        out = []
        for c in self.channels:
            n, d, e = F.col(f"_n_{c}"), F.col(f"_m_{c}") - F.col(f"_mean_{c}"), F.col(f"_place_{c}") - F.col(f"_mid_{c}")
            both, position = F.sum(F.col(f"_pc_{c}") + n * d * e), F.sum(F.col(f"_p2_{c}") + n * e * e)
            flat = F.min(f"_lo_{c}") == F.max(f"_hi_{c}")
            out.append(F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(both, position), F.lit(0.0))).alias(f"{c}_trend_slope"))
        return out

    def midpoint(self) -> Column:
        low, high = F.min("_t0"), F.max("_t1")
        return F.timestamp_micros(low + F.floor((high - low) / 2).cast("long")).alias("midpoint")

    def labels(self) -> Column:
        return (F.try_divide(F.sum("_hits"), F.sum("_known")) >= self.share).cast("int").alias(self.label)

    def table(self, df: DataFrame, columns: Callable[[], list[Column]]) -> DataFrame:
        """The wanted columns of every window with enough rows."""
        rows = self.spec.placed(df)
        if self.is_ordered:
            rows = self.spec.ordered(rows, self.channels, self.spec.counted(rows)[1] > self.spec.max_rows)
        return self.windows(self.panes(rows)).groupBy(*self.spec.keys).agg(*columns())


def window_label(df: DataFrame, spec: SlidingWindows, label: str = LABEL, share: float = 0.3) -> DataFrame:
    """1 when at least ``share`` of the window's rows are anomalous."""
    stats = WindowStatistics(spec, [], label=label, share=share)
    return stats.table(df, lambda: [stats.labels()])


def window_midpoint(df: DataFrame, spec: SlidingWindows) -> DataFrame:
    """Midpoint of the first and last row time."""
    stats = WindowStatistics(spec, [])
    return stats.table(df, lambda: [stats.midpoint()])


def window_mean_std(df: DataFrame, spec: SlidingWindows, channels: list[str]) -> DataFrame:
    """Mean and population deviation per channel."""
    stats = WindowStatistics(spec, channels)
    return stats.table(df, stats.mean_std)


def window_change_point(df: DataFrame, spec: SlidingWindows, channels: list[str]) -> DataFrame:
    """Largest absolute step between neighbouring rows."""
    stats = WindowStatistics(spec, channels, ordered=True)
    return stats.table(df, stats.change_point)


def window_skew(df: DataFrame, spec: SlidingWindows, channels: list[str]) -> DataFrame:
    """Population skewness, 0 for constant windows."""
    stats = WindowStatistics(spec, channels)
    return stats.table(df, stats.skew)


def window_trend_slope(df: DataFrame, spec: SlidingWindows, channels: list[str]) -> DataFrame:
    """Least-squares slope over the row position, 0 for constant windows."""
    stats = WindowStatistics(spec, channels, ordered=True)
    return stats.table(df, stats.slope)


def blocks_with_halo(
    df: DataFrame, idx: str, size: int, before: int, after: int, block: str = "_block"
) -> DataFrame:
    """Copy rows near a block edge into the neighbouring blocks, so that each block sees its halo."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(idx) - after) / size).cast("long"))
    last = F.floor((F.col(idx) + before) / size).cast("long")
    return df.withColumn(block, F.explode(F.sequence(first, last)))


def sequence_windows(
    df: DataFrame,
    features: list[str],
    order: list[str],
    size: int,
    step: int = 1,
    label: str = LABEL,
    part: tuple[str, ...] = (),
    block_rows: int = 4096,
) -> DataFrame:
    """Row-count windows every ``step`` rows: feature matrix and label array.

    Rows go into blocks with a halo of ``size - 1`` rows, are put in order once per block, and the windows are
    slices of that array; a row is copied only where a window is written. Tests use ``step=size``.
    """
    keys = list(part)
    cdf = chunked(df.select(*dict.fromkeys([*keys, *order, *features, label])), keys, order)
    rows = plain(with_count(with_index(cdf, keys), keys, "_n"))
    entry = F.struct(
        F.col("idx"), F.array(*[F.col(f).cast("float") for f in features]).alias("x"), F.col(label).cast("int").alias("y")
    )
    # a window starts in the block of its first row and reaches up to size - 1 rows beyond it
    spread = blocks_with_halo(rows, "idx", block_rows, 0, size - 1)
    blocks = spread.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(entry)).alias("_rows"), F.max("_n").alias("_n")  # at most block_rows + size - 1 rows
    )
    low = F.col("_block") * block_rows
    first = F.ceil(low / step).cast("long")
    last = F.least(
        F.floor((low + block_rows - 1) / step).cast("long"), F.floor((F.col("_n") - size) / step).cast("long")
    )
    starts = blocks.withColumns({"_i": first, "_j": last}).where("_j >= _i")
    exploded = starts.withColumn("window_id", F.explode(F.sequence("_i", "_j")))
    # the halo only follows the block, so its first entry is the block's first row
    piece = F.slice("_rows", (F.col("window_id") * step - low + 1).cast("int"), size)
    windows = exploded.withColumn("_w", piece)
    return windows.select(
        *keys,
        "window_id",
        F.transform("_w", lambda r: r.getField("x")).alias("features"),
        F.transform("_w", lambda r: r.getField("y")).alias("labels"),
    )


def sequence_label_share(
    df: DataFrame, order: list[str], size: int, step: int = 1, label: str = LABEL, part: tuple[str, ...] = ()
) -> DataFrame:
    """Anomalous share over all positions of all windows, from how many windows hold each row."""
    keys = list(part)
    cdf = chunked(df.select(*dict.fromkeys([*keys, *order, label])), keys, order)
    rows = with_count(with_index(cdf, keys), keys, "_n")
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step))
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - size) / step))
    held = F.greatest(F.lit(0), last - first + 1)
    hits, total = F.sum(F.col(label) * held), F.sum(held)
    return rows.groupBy(*keys).agg(
        F.coalesce(hits, F.lit(0)).cast("long").alias("anomalies"), F.coalesce(total, F.lit(0)).cast("long").alias("timesteps"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("share"),
    )


def intervals_between_rows(
    df: DataFrame, ts: str = TS, tie: tuple[str, ...] = (), part: tuple[str, ...] = (STATION,)
) -> DataFrame:
    """Each row's time, the previous one and the seconds between; null on the first row."""
    cdf = chunked(df.select(*part, ts, *tie), list(part), [ts, *tie])
    rows = plain(with_neighbours(cdf, list(part), {"previous": ts}))
    return rows.withColumn("gap_seconds", seconds_between("previous", ts))


def interval_stats(gaps: DataFrame, ts: str = TS, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Points, span and median, mean, minimum, maximum and sample deviation of the gaps."""
    base = gaps.groupBy(*part).agg(
        F.count(F.lit(1)).alias("points"),
        seconds_between(F.min(ts), F.max(ts)).alias("span_seconds"),
        F.avg("gap_seconds").alias("mean"),
        F.min("gap_seconds").alias("min"),
        F.max("gap_seconds").alias("max"),
        F.stddev_samp("gap_seconds").alias("std"),
    )
    return null_safe_join(base, quantiles(gaps, list(part), "gap_seconds", {"median": 0.5}), list(part), "left")


def interval_stats_population(gaps: DataFrame, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the gaps."""
    return gaps.groupBy(*part).agg(
        F.min("gap_seconds").alias("min"), F.max("gap_seconds").alias("max"),
        F.avg("gap_seconds").alias("mean"), F.stddev_pop("gap_seconds").alias("std"),
    )


def common_intervals(gaps: DataFrame, top: int = 5, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Most frequent gaps, ties to the shorter; the rank limit is applied before the shuffle."""
    counts = gaps.where("gap_seconds is not null").groupBy(*part, "gap_seconds").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(*part).orderBy(F.col("n").desc(), "gap_seconds")
    return counts.withColumn("place", F.row_number().over(line)).where(F.col("place") <= top)


def significant_gaps(
    gaps: DataFrame, min_seconds: float = 300, first: int | None = None, ts: str = TS, part: tuple[str, ...] = (STATION,)
) -> DataFrame:
    """Gaps over the limit with start, end and length; ``first`` keeps the earliest ones of a report."""
    found = gaps.where(F.col("gap_seconds") > min_seconds).select(
        *part, F.col("previous").alias("gap_start"), F.col(ts).alias("gap_end"), "gap_seconds"
    )
    return found if first is None else found.orderBy("gap_start", *part).limit(first)


def gap_count(gaps: DataFrame, min_seconds: float = 300, first: int = 20, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Number of gaps over the limit, and how many lie beyond the first ones of a report."""
    n = F.count_if(F.col("gap_seconds") > min_seconds)
    return gaps.groupBy(*part).agg(n.alias("gaps"), F.greatest(n - first, F.lit(0)).alias("not_listed"))


def continuity_score(stats: DataFrame, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Percent of the points expected from span and median gap, at most 100; null if the median is 0."""
    expected = F.try_divide("span_seconds", "median")
    score = F.least(F.lit(100.0), F.try_divide(F.col("points"), expected) * 100)
    return stats.select(*part, F.when(F.col("median") > 0, score).alias("continuity_score"))


def seasonal_decompose(
    df: DataFrame, value: str, period: int, idx: str = "slot", part: tuple[str, ...] = (STATION,), block_rows: int | None = None
) -> DataFrame:
    """Additive trend, seasonal and residual parts of a regular series numbered by ``idx`` from 0.

    The centred moving average is a difference of running sums inside blocks with a halo of half a period, so rows
    are moved once and a block holds ``block_rows + period`` rows.
    """
    keys = list(part)
    half, even = period // 2, period % 2 == 0
    block_rows = block_rows or max(8192, 4 * period)
    totals = df.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    rows = null_safe_join(df, settled(totals), keys, "inner")
    spread = blocks_with_halo(rows, idx, block_rows, half + 1, half)
    line = Window.partitionBy(*keys, "_block").orderBy(idx)
    summed = spread.withColumn("_s", F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = lambda k: F.lead("_s", k).over(line)
    behind = lambda k: F.coalesce(F.lag("_s", k).over(line), F.lit(0.0))
    outer = ahead(half) - behind(half + 1)
    total = (outer + ahead(half - 1) - behind(half)) / 2 if even else outer
    inside = (F.col(idx) >= half) & (F.col(idx) <= F.col("_n") - 1 - half)
    trended = summed.withColumn("_t", total / period).where(
        F.col("_block") == F.floor(F.col(idx) / block_rows).cast("long")
    )
    trended = trended.select(*df.columns, F.when(inside, F.col("_t")).alias("trend"), (F.col(idx) % period).alias("_phase"))
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    phases = settled(phases)  # one row per phase and series
    centre = phases.groupBy(*keys).agg(F.avg("_p").alias("_m"))
    seasonal = null_safe_join(phases, centre, keys, "inner").select(*keys, "_phase", (F.col("_p") - F.col("_m")).alias("seasonal"))
    joined = null_safe_join(trended, settled(seasonal), [*keys, "_phase"], "left").drop("_phase")
    return joined.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def variance_shares(parts: DataFrame, value: str, part: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Variance of every component over the observed variance."""
    observed = F.var_samp(value)
    return parts.groupBy(*part).agg(
        *[F.try_divide(F.var_samp(c), observed).alias(f"{c}_share") for c in ("trend", "seasonal", "residual")]
    )
