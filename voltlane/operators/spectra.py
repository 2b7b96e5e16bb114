"""Spectra of windows and of whole series, autocorrelation and peaks.

Windows are bounded, so their samples travel as one array per window and numpy works on Arrow batches of windows.
A whole series is never gathered: its Fourier transform runs as two rounds of grouped short transforms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.functions.signals import detrended, filled, ks_distance, magnitude_features, normal_cdf, welch
from voltlane.operators.series import LABEL, SlidingWindows, WindowStatistics
from voltlane.plans.ordering import chunked, null_safe_join, plain, quantiles, settled, with_index, with_neighbours, with_running

_FEATURES = [
    "ks_test_statistic", "dominant_frequency", "spectral_peak", "spectral_flatness", "freq_energy_ratio_low_high",
    "welch_peak_power", "welch_total_power",
]


def _array_features(rate: float, standardised: bool):
    @F.pandas_udf(", ".join(f"{name} double" for name in _FEATURES))
    def compute(arrays: pd.Series) -> pd.DataFrame:
        rows = []
        for array in arrays:
            x = np.asarray(array, dtype=float)
            x = x[~np.isnan(x)]  # null samples are left out, here as where windows are spread
            if not len(x):
                rows.append((None,) * len(_FEATURES))
                continue
            peak = total = 0.0
            if len(x) >= 8:
                density = welch(x, min(len(x) // 2, 256), rate)[1]
                peak, total = float(density.max()), float(density.sum())
            rows.append((ks_distance(x, standardised), *magnitude_features(x, rate), peak, total))
        return pd.DataFrame(rows, columns=_FEATURES)

    return compute


def _ordered_values(order: list[str], value: str) -> Column:
    """Values of a bounded group as an array in order."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.transform(pairs, lambda p: p.getField("_v"))


def _expand(arrays: DataFrame, keep: list[str], channels: list[str], names: list[str], rate: float, standardised: bool) -> DataFrame:
    compute = _array_features(rate, standardised)
    staged = arrays.withColumns({f"_f_{c}": compute(f"_a_{c}") for c in channels})
    return staged.select(*keep, *[F.col(f"_f_{c}.{n}").alias(f"{c}_{n}") for c in channels for n in names])


@F.pandas_udf(T.DoubleType())
def _normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy()))


def _spread_ks(rows: DataFrame, keys: list[str], c: str, standardised: bool) -> DataFrame:
    """The distance to N(0, 1) of windows that no task can hold: ranks from chunks."""
    x = rows.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("_x"))
    sizes = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_d"))
    # equal values are counted before they are put in order: of a run of equal ranks only the ends matter
    counted = x.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    run = plain(with_running(chunked(counted, keys, ["_x"]), keys, {"_upto": ("sum", "_c")}))
    ranked = null_safe_join(run, settled(sizes), keys, "inner")
    scaled = F.when(F.lit(standardised) & (F.col("_d") > 0), (F.col("_x") - F.col("_m")) / F.col("_d")).otherwise(F.col("_x"))
    cdf = ranked.withColumn("_f", _normal_cdf(scaled))
    n, f = F.col("_n"), F.col("_f")
    return cdf.groupBy(*keys).agg(F.max(F.greatest(F.col("_upto") / n - f, f - (F.col("_upto") - F.col("_c")) / n)).alias(_FEATURES[0]))


def _spread_magnitudes(rows: DataFrame, keys: list[str], order: list[str], c: str, rate: float) -> DataFrame:
    """Magnitude features of windows that no task can hold, from the distributed transform."""
    spectrum = series_fft(rows, c, order, tuple(keys))
    positive = spectrum.where((F.col("k") >= 1) & (2 * F.col("k") < F.col("_len")))
    unit = F.lit(rate) / F.col("_len")
    top = F.floor((F.col("_len") - 1) / 2) * unit
    f, m = F.col("_f"), F.col("_m")
    bins = positive.select(*keys, (F.col("k") * unit).alias("_f"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("_m"), top.alias("_top"))
    low, high = (F.coalesce(F.sum(F.when(c, m)), F.lit(0.0)) for c in (f <= F.col("_top") / 3, f > 2 * F.col("_top") / 3))
    return bins.groupBy(*keys).agg(
        F.max_by("_f", F.struct("_m", -f)).alias(_FEATURES[1]), F.max("_m").alias(_FEATURES[2]),
        (F.exp(F.avg(F.log(m + 1e-10))) / (F.avg(m) + 1e-10)).alias(_FEATURES[3]), (low / (high + 1e-10)).alias(_FEATURES[4]),
    )


def _welch_udf(rate: float):
    @F.pandas_udf("array<double>")
    def compute(arrays: pd.Series) -> pd.Series:
        return pd.Series([welch(np.asarray(a, dtype=float), len(a), rate)[1] for a in arrays])

    return compute


def _spread_welch(rows: DataFrame, keys: list[str], order: list[str], c: str, rate: float) -> DataFrame:
    """Welch features of windows that no task can hold: segments of at most 256 rows are groups of their own."""
    indexed = settled(_indexed(rows, c, order, keys))
    sizes = settled(indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    placed = null_safe_join(indexed, sizes, keys, "inner")
    length = F.least(F.floor(F.col("_n") / 2), F.lit(256)).cast("long")
    placed = placed.withColumn("_l", length).withColumn("_s", (F.col("_l") - F.floor(F.col("_l") / 2)).cast("long"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - F.col("_l") + 1) / F.col("_s")).cast("long"))
    last = F.least(F.floor(F.col("i") / F.col("_s")), F.floor((F.col("_n") - F.col("_l")) / F.col("_s"))).cast("long")
    cut = placed.withColumns({"_a": first, "_b": last}).where("_b >= _a").withColumn("_g", F.explode(F.sequence("_a", "_b")))
    segments = cut.groupBy(*keys, "_g").agg(_ordered_values(["i"], "x").alias("_values"))
    density = segments.select(*keys, F.posexplode(_welch_udf(rate)("_values")).alias("_k", "_d"))
    means = density.groupBy(*keys, "_k").agg(F.avg("_d").alias("_d"))
    return means.groupBy(*keys).agg(F.max("_d").alias(_FEATURES[5]), F.sum("_d").alias(_FEATURES[6]))


def _spread_features(rows: DataFrame, spec: SlidingWindows, channels: list[str], names: list[str], rate: float, standardised: bool) -> DataFrame:
    """The features of windows that no task can hold, in the terms of ``_array_features``: nulls left out, zeros for few samples."""
    keys, order = spec.keys, [spec.ts, *spec.tie]
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in channels})
    out = settled(rows.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in channels]))
    least = dict.fromkeys(_FEATURES[1:5], 4) | dict.fromkeys(_FEATURES[5:], 8)
    for c in channels:
        pieces = []
        if _FEATURES[0] in names:
            pieces.append(_spread_ks(rows, keys, c, standardised))
        if _FEATURES[1] in names:
            pieces.append(_spread_magnitudes(rows, keys, order, c, rate))
        if _FEATURES[5] in names:
            pieces.append(_spread_welch(rows, keys, order, c, rate))
        n = F.col(f"_n_{c}")
        for piece in pieces:
            named = piece.select(*keys, *[F.col(n).alias(f"_f_{n}") for n in names if n in piece.columns])
            out = null_safe_join(out, named, keys, "left")
            for f in [f for f in names if f in piece.columns]:
                value = F.when((n > 0) & (n < least.get(f, 0)), 0.0).otherwise(F.col(f"_f_{f}"))
                out = out.withColumn(f"{c}_{f}", value).drop(f"_f_{f}")
    return out.drop(*[f"_n_{c}" for c in channels])


def _pane_arrays(spec: SlidingWindows, channels: list[str]) -> list[Column]:
    return [_ordered_values([spec.ts, *spec.tie], c).alias(f"_v_{c}") for c in channels]


def _window_arrays(channels: list[str]) -> list[Column]:
    """The samples of a window from its panes' arrays; a window of more rows than a task can hold gets none."""
    pieces = lambda c: F.sort_array(F.collect_list(F.struct("_pane", F.col(f"_v_{c}").alias("v"))))
    return [F.flatten(F.transform(pieces(c), lambda p: p.getField("v"))).alias(f"_a_{c}") for c in channels]


def _sampled_features(df: DataFrame, spec: SlidingWindows, channels: list[str], names: list[str], rate: float = 1.0, standardised: bool = False) -> DataFrame:
    """Features of the ordered samples: arrays for windows a task can hold, spread work for the others."""
    placed = spec.placed(df)
    counts, largest = spec.counted(placed)
    if largest > spec.max_rows:
        counts = settled(counts)
        placed = _of_small_windows(spec, placed, counts)
    panes = placed.groupBy(*spec.pane).agg(F.count(F.lit(1)).alias("_n"), *_pane_arrays(spec, channels))
    arrays = spec.in_windows(panes)
    if largest > spec.max_rows:
        arrays = null_safe_join(arrays, counts.where(F.col("_rows") <= spec.max_rows).select(*spec.keys), spec.keys, "left_semi")
    arrays = arrays.groupBy(*spec.keys).agg(F.sum("_n").alias("_rows"), *_window_arrays(channels)).where(F.col("_rows") >= spec.min_rows)
    out = _expand(arrays, spec.keys, channels, names, rate, standardised)
    if largest <= spec.max_rows:
        return out
    return out.unionByName(_spread_features(spec.huge_rows(df, counts), spec, channels, names, rate, standardised))


def _of_small_windows(spec: SlidingWindows, placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the panes that some window of at most ``max_rows`` rows holds, so that no array is longer."""
    panes = placed.select(*spec.pane).distinct()
    small = counts.where(F.col("_rows") <= spec.max_rows).select(*spec.keys)
    held = settled(null_safe_join(spec.in_windows(panes.withColumns({"_a0": F.col("_a"), "_b0": F.col("_b")})), small, spec.keys, "left_semi").select(spec.station, "_pane").distinct())
    return null_safe_join(placed, held, [spec.station, "_pane"], "left_semi")


def window_ks_normal(df: DataFrame, spec: SlidingWindows, channels: list[str], standardised: bool = False) -> DataFrame:
    """Distance of each window's raw values to N(0, 1)."""
    return _sampled_features(df, spec, channels, _FEATURES[:1], standardised=standardised)


def window_fft_features(df: DataFrame, spec: SlidingWindows, channels: list[str], rate: float = 1.0) -> DataFrame:
    """Dominant frequency, peak, flatness and low/high ratio of each window."""
    return _sampled_features(df, spec, channels, _FEATURES[1:5], rate)


def window_welch_features(df: DataFrame, spec: SlidingWindows, channels: list[str], rate: float = 1.0) -> DataFrame:
    """Peak and total of each window's Welch density."""
    return _sampled_features(df, spec, channels, _FEATURES[5:], rate)


def window_features(
    df: DataFrame, spec: SlidingWindows, channels: list[str], label: str | None = LABEL, rate: float = 1.0
) -> DataFrame:
    """All statistics of every window: one shuffle of the rows puts them into panes, with summaries and samples; windows merge these."""
    stats = WindowStatistics(spec, channels, ordered=True, label=label)
    native = [*stats.mean_std(), *stats.change_point(), *stats.skew(), *stats.slope(), stats.midpoint(), *([stats.labels()] if label else [])]
    placed = spec.placed(df)
    counts, largest = spec.counted(placed)
    if largest <= spec.max_rows:
        panes = stats.panes(spec.ordered(placed, channels, False), *_pane_arrays(spec, channels))
        table = stats.windows(panes).groupBy(*spec.keys).agg(*native, *_window_arrays(channels))
        return _expand(table, [c for c in table.columns if not c.startswith("_a_")], channels, _FEATURES, rate, False)
    table = stats.windows(stats.panes(spec.ordered(placed, channels, True))).groupBy(*spec.keys).agg(*native)
    return null_safe_join(table, settled(_sampled_features(df, spec, channels, _FEATURES, rate)), spec.keys, "inner")


# --- spectra of selected windows -------------------------------------------------------------------------------


def window_arrays(df: DataFrame, window: list[str], order: list[str], channels: list[str], min_rows: int = 100) -> DataFrame:
    """One row per window and channel with its values in order; short or all-null windows are left out."""
    arrays = df.groupBy(*window).agg(*[_ordered_values(order, c).alias(c) for c in channels])
    entries = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("values")) for c in channels]
    long = arrays.select(*window, F.inline(F.array(*entries)))
    filled = F.exists("values", lambda v: v.isNotNull())
    return long.where((F.size("values") >= min_rows) & filled)


_SPECTRUM = "freq array<double>, amplitude array<double>, psd_freq array<double>, psd array<double>"


def _spectrum_udf(rate: float, segment: int):
    @F.pandas_udf(_SPECTRUM)
    def compute(arrays: pd.Series) -> pd.DataFrame:
        rows = []
        for array in arrays:
            flat = detrended(filled(array))
            n = len(flat)
            taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
            last = (n - 1) // 2
            amplitude = np.abs(np.fft.rfft(flat * taper))[1 : last + 1] * 2 / n
            psd_freq, psd = welch(flat, min(segment, n), rate)
            rows.append((np.arange(1, last + 1) * (rate / n), amplitude, psd_freq, psd))
        return pd.DataFrame(rows, columns=["freq", "amplitude", "psd_freq", "psd"])

    return compute


def windowed_spectrum(arrays: DataFrame, rate: float = 1.0, segment: int = 256) -> DataFrame:
    """Per window and channel: amplitudes of the detrended, tapered samples, and their Welch density, as arrays."""
    staged = arrays.withColumn("_s", _spectrum_udf(rate, segment)("values"))
    kept = [c for c in arrays.columns if c != "values"]
    return staged.select(*kept, "_s.freq", "_s.amplitude", "_s.psd_freq", "_s.psd")


def _long(spectrum: DataFrame, freq: str, value: str) -> DataFrame:
    kept = [c for c in spectrum.columns if c not in ("freq", "amplitude", "psd_freq", "psd")]
    zipped = F.arrays_zip(F.col(freq).alias("freq"), F.col(value).alias(value))
    exploded = spectrum.select(*kept, F.posexplode(zipped).alias("k", "_z"))
    return exploded.select(*kept, "k", F.col("_z.freq").alias("freq"), F.col(f"_z.{value}").alias(value))


def amplitudes(spectrum: DataFrame) -> DataFrame:
    """``k, freq, amplitude`` rows; ``k`` is 0 for the first positive frequency."""
    return _long(spectrum, "freq", "amplitude")


def densities(spectrum: DataFrame) -> DataFrame:
    """``k, freq, psd`` rows."""
    return _long(spectrum, "psd_freq", "psd")


def dominant_frequencies(spectrum: DataFrame, top: int = 5) -> DataFrame:
    """Strongest frequencies per window and channel, taken from the sorted array without another shuffle."""
    kept = [c for c in spectrum.columns if c not in ("freq", "amplitude", "psd_freq", "psd")]
    zipped = F.arrays_zip(F.col("amplitude").alias("amplitude"), F.col("freq").alias("freq"))
    best = F.slice(F.sort_array(zipped, asc=False), 1, top)
    exploded = spectrum.select(*kept, F.posexplode(best).alias("place", "_z"))
    return exploded.select(*kept, (F.col("place") + 1).alias("place"), "_z.freq", "_z.amplitude")


def array_sum(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def total_power(spectrum: DataFrame) -> DataFrame:
    """Sum of the density per window and channel."""
    kept = [c for c in spectrum.columns if c not in ("freq", "amplitude", "psd_freq", "psd")]
    return spectrum.select(*kept, array_sum("psd").alias("total_power"))


def mean_spectrum_by_class(spectrum: DataFrame, label: str = "class") -> DataFrame:
    """Mean amplitude (``kind = 'amplitude'``) and density (``'psd'``) per frequency, class and channel."""
    parts = []
    for kind, rows in (("amplitude", amplitudes(spectrum)), ("psd", densities(spectrum))):
        rows = rows.withColumn("freq", F.round("freq", 12))  # the same frequency may come from other k and n
        means = rows.groupBy(label, "channel", "freq").agg(F.avg(kind).alias("mean"), F.count(kind).alias("windows"))
        parts.append(means.withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


# fixed values: half-open frequency bands in Hz
BANDS = {"very_low": (0.0, 0.0001), "low": (0.0001, 0.001), "mid": (0.001, 0.01), "high": (0.01, 0.5)}


def _within(low: float, high: float):
    return lambda z: (z["freq"] >= low) & (z["freq"] < high)


def band_energy(spectrum: DataFrame, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Density summed per band, window and channel; bands without a frequency give 0."""
    kept = [c for c in spectrum.columns if c not in ("freq", "amplitude", "psd_freq", "psd")]
    zipped = F.arrays_zip(F.col("psd_freq").alias("freq"), F.col("psd").alias("psd"))
    entries = []
    for name, (low, high) in (bands or BANDS).items():
        energy = F.aggregate(F.filter(zipped, _within(low, high)), F.lit(0.0), lambda acc, z: acc + z["psd"])
        entries.append(F.struct(F.lit(name).alias("band"), energy.alias("energy")))
    return spectrum.select(*kept, F.inline(F.array(*entries)))


def band_energy_ratio(energy: DataFrame, label: str = "class") -> DataFrame:
    """Mean anomaly over mean normal energy per band and channel, 0 without normal energy."""
    mean = lambda c: F.avg(F.when(F.col(label) == c, F.col("energy")))
    table = energy.groupBy("channel", "band").agg(mean("normal").alias("normal_mean"), mean("anomaly").alias("anomaly_mean"))
    return table.where("normal_mean is not null and anomaly_mean is not null").withColumn(
        "ratio", F.when(F.col("normal_mean") > 0, F.try_divide("anomaly_mean", "normal_mean")).otherwise(0.0)
    )


# --- whole series ----------------------------------------------------------------------------------------------


_DOUBLES = T.ArrayType(T.DoubleType())


@F.pandas_udf(T.StructType([T.StructField("re", _DOUBLES), T.StructField("im", _DOUBLES)]))
def _short_fft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    spectra = [np.fft.fft(np.asarray(a, dtype=float) + 1j * np.asarray(b, dtype=float)) for a, b in zip(re, im)]
    return pd.DataFrame({"re": [s.real for s in spectra], "im": [s.imag for s in spectra]})


def _grouped_fft(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Transform of ``re, im`` over ``position`` within each group; groups hold about the root of the series."""
    pairs = F.sort_array(F.collect_list(F.struct(position, "re", "im")))
    arrays = df.groupBy(*group).agg(pairs.alias("_a"))
    field = lambda name: F.transform("_a", lambda p: p.getField(name))
    done = arrays.select(*group, _short_fft(field("re"), field("im")).alias("_f"))
    zipped = F.arrays_zip(F.col("_f.re").alias("re"), F.col("_f.im").alias("im"))
    exploded = done.select(*group, F.posexplode(zipped).alias("_k", "_z"))
    return exploded.select(*group, F.col("_k").cast("long").alias("_k"), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def four_step_fft(df: DataFrame, part: list[str]) -> DataFrame:
    """Transform of every complete series ``part, i, re, im`` with row columns ``_n = _p * _q``; output ``part, k, re, im``.

    With ``i = q P + p`` the inner transforms run over ``q`` for each ``p``, are turned by ``exp(-2 pi j p k / n)``,
    and the outer ones run over ``p`` for each ``k``; bin ``k + Q r`` is the outer term ``r``.
    """
    keys = [*part, "_n", "_p", "_q"]
    cut = df.withColumns({"_col": F.col("i") % F.col("_p"), "_row": F.floor(F.col("i") / F.col("_p")).cast("long")})
    inner = _grouped_fft(cut.select(*keys, "_col", "_row", "re", "im"), [*keys, "_col"], "_row")
    angle = -2 * np.pi * ((F.col("_col") * F.col("_k")) % F.col("_n")) / F.col("_n")
    turned = inner.withColumns(
        {"_re": F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), "_im": F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)}
    ).select(*keys, F.col("_k").alias("_low"), "_col", F.col("_re").alias("re"), F.col("_im").alias("im"))
    outer = _grouped_fft(turned, [*keys, "_low"], "_col")
    return outer.select(*part, "_n", (F.col("_low") + F.col("_q") * F.col("_k")).alias("k"), "re", "im")


def _power_of_two(length: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(length.cast("double")))).cast("long")


def _power_of_two_cut(df: DataFrame, length: str) -> DataFrame:
    """``_p, _q`` for a power-of-two length."""
    p = F.pow(F.lit(2.0), F.floor(F.log2(F.col(length).cast("double")) / 2)).cast("long")
    return df.withColumns({"_n": F.col(length), "_p": p, "_q": (F.col(length) / p).cast("long")})


def _padding(sizes: DataFrame, part: list[str], low: Column, high: Column, piece: int = 65536) -> DataFrame:
    """Rows ``part, i`` for the positions ``low .. high - 1`` of every series, spread over tasks."""
    staged = sizes.withColumns({"_lo": low, "_hi": high}).where("_hi > _lo")
    pieces = staged.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / piece), F.floor((F.col("_hi") - 1) / piece))))
    spread = pieces.repartition(*part, "_c") if part else pieces.repartition("_c")
    first = F.greatest(F.col("_c") * piece, F.col("_lo"))
    last = F.least(F.col("_c") * piece + piece - 1, F.col("_hi") - 1)
    return spread.withColumn("i", F.explode(F.sequence(first, last))).drop("_lo", "_hi", "_c")


def _indexed(df: DataFrame, value: str, order: list[str], part: list[str]) -> DataFrame:
    """``part, i, x`` with the position of each non-null value."""
    cdf = chunked(df.where(F.col(value).isNotNull()).select(*part, *order, F.col(value).alias("_x")), part, order)
    rows = plain(with_index(cdf, part, "i")).select(*part, "i", F.col("_x").alias("x"))
    return rows


def _chirp(df: DataFrame, sign: int, index: str = "i", n: str = "_len") -> tuple[Column, Column]:
    """``exp(sign pi j i^2 / n)``; the square is reduced modulo 2 n first, which keeps the angle exact."""
    square = F.pmod(F.col(index).cast("decimal(19,0)") * F.col(index).cast("decimal(19,0)"), (2 * F.col(n)).cast("decimal(19,0)"))
    angle = sign * np.pi * square.cast("double") / F.col(n)
    return F.cos(angle), F.sin(angle)


def _any_length_fft(rows: DataFrame, sizes: DataFrame, part: list[str]) -> DataFrame:
    """Transform of series whose length has no useful divisor, as a convolution with a chirp.

    ``X_k = c_k sum_i (x_i c_i) conj(c_{k-i})`` with ``c_i = exp(-pi j i^2 / n)``; the convolution is three transforms of
    the next power of two. Exact for any length, so no row is dropped.
    """
    sizes = sizes.withColumn("_m", _power_of_two(2 * F.col("_len") - 1))
    c, s = _chirp(rows, -1)
    a = rows.select(*part, "_len", "i", (F.col("x") * c).alias("re"), (F.col("x") * s).alias("im"))
    a = null_safe_join(a, sizes.select(*part, "_m"), part, "inner")
    zeros = _padding(sizes, part, F.col("_len"), F.col("_m")).select(
        *part, "_len", "i", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), "_m"
    )
    fa = four_step_fft(_power_of_two_cut(a.unionByName(zeros), "_m"), part)
    span = _padding(sizes, part, F.lit(0).cast("long"), F.col("_m"))
    near = F.least(F.col("i"), F.col("_m") - F.col("i"))
    cb, sb = _chirp(span.withColumn("_d", near), 1, "_d")
    b = span.withColumn("_d", near)
    used = F.col("_d") < F.col("_len")
    b = b.select(*part, "_m", "i", F.when(used, cb).otherwise(0.0).alias("re"), F.when(used, sb).otherwise(0.0).alias("im"))
    fb = four_step_fft(_power_of_two_cut(b, "_m"), part)
    fb = fb.select(*part, "k", F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = null_safe_join(fa, fb, [*part, "k"], "inner")
    # conjugate of the product, so that a forward transform inverts it
    product = both.select(
        *part, F.col("_n").alias("_m"), F.col("k").alias("i"),
        (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (-(F.col("re") * F.col("im2") + F.col("im") * F.col("re2"))).alias("im"),
    )
    back = four_step_fft(_power_of_two_cut(product, "_m"), part)
    back = null_safe_join(back, sizes.select(*part, "_len"), part, "inner").where("k < _len")
    re, im = F.col("re") / F.col("_n"), -F.col("im") / F.col("_n")
    ck, sk = _chirp(back, -1, "k")
    return back.select(*part, "_len", "k", (re * ck - im * sk).alias("re"), (re * sk + im * ck).alias("im"))


def series_fft(df: DataFrame, value: str, order: list[str], part: tuple[str, ...] = ("station",)) -> DataFrame:
    """Transform of each whole series in order: ``part, _len, k, re, im``.

    A length with a divisor near its root is cut there; any other goes through the power-of-two convolution.
    """
    keys = list(part)
    rows = _indexed(df, value, order, keys)
    root = F.floor(F.sqrt(F.col("_len"))).cast("long")
    divisor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), root), lambda x: F.col("_len") % x == 0))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    sizes = settled(sizes.withColumn("_p", divisor).withColumn("_even", F.col("_p") * 8 >= F.sqrt(F.col("_len"))))
    kinds = {r[0] for r in sizes.select("_even").distinct().collect()}  # at most true and false
    out = None
    for even in sorted(kinds or {True}):
        chosen = sizes.where(F.col("_even") == even).drop("_even")
        mine = null_safe_join(rows, chosen, keys, "inner")
        if even:
            whole = mine.select(*keys, "i", F.col("x").alias("re"), F.lit(0.0).alias("im"), F.col("_len").alias("_n"), "_p")
            whole = whole.withColumn("_q", (F.col("_n") / F.col("_p")).cast("long"))
            done = four_step_fft(whole, keys).withColumnRenamed("_n", "_len")
        else:
            done = _any_length_fft(mine.drop("_p"), chosen.drop("_p"), keys)
        out = done if out is None else out.unionByName(done)
    return out


def periodogram(
    df: DataFrame, value: str, order: list[str], minutes: float = 1.0, part: tuple[str, ...] = ("station",)
) -> DataFrame:
    """Squared magnitude at the positive frequencies (per row), with the period in hours; rows are ``minutes`` apart."""
    spectrum = series_fft(df, value, order, part)
    positive = spectrum.where((F.col("k") >= 1) & (2 * F.col("k") < F.col("_len")))
    frequency = F.col("k") / F.col("_len")
    return positive.select(
        *part, "k", frequency.alias("frequency"), (F.col("re") ** 2 + F.col("im") ** 2).alias("power"),
        (F.lit(minutes / 60.0) / frequency).alias("period_hours"),
    )


def local_maxima(df: DataFrame, value: str, position: str, part: tuple[str, ...]) -> DataFrame:
    """Interior points above both neighbours; a flat top counts once, at its middle (rounded down)."""
    keys = list(part)
    cdf = chunked(df.select(*keys, position, value), keys, [position])
    rows = with_neighbours(cdf, keys, {"_before": value}, {"_after": value})
    v = F.col(value)
    opens = F.col("_before").isNull() | (F.col("_before") != v)
    runs = with_running(rows, keys, {"_run": ("last", F.when(opens, F.col(position)))})
    tops = runs.groupBy(*keys, "_run", value).agg(
        F.max(position).alias("_end"),
        F.coalesce(F.bool_or(F.when(F.col(position) == F.col("_run"), F.col("_before") < v)), F.lit(False)).alias("_rises"),
        F.coalesce(F.bool_or(F.when(F.col("_after") != v, F.col("_after") < v)), F.lit(False)).alias("_falls"),
    )
    middle = F.floor((F.col("_run") + F.col("_end")) / 2).cast("long")
    return tops.where("_rises and _falls").select(*keys, middle.alias(position), value)


def _strongest(df: DataFrame, value: str, position: str, part: tuple[str, ...], top: int) -> DataFrame:
    line = Window.partitionBy(*part).orderBy(F.col(value).desc(), position)
    return df.withColumn("place", F.row_number().over(line)).where(F.col("place") <= top)


def spectral_peaks(
    spectrum: DataFrame, part: tuple[str, ...] = ("station",), share: float = 0.95,
    hours: tuple[float, float] = (0.5, 168.0), top: int = 10,
) -> DataFrame:
    """Local maxima at or above the quantile, with a period in range, strongest first."""
    spectrum = settled(spectrum)  # read three times below
    limits = quantiles(spectrum, list(part), "power", {"_limit": share})
    peaks = null_safe_join(local_maxima(spectrum, "power", "k", part), settled(limits), list(part), "inner")
    periods = spectrum.select(*part, "k", "period_hours")
    found = null_safe_join(peaks.where(F.col("power") >= F.col("_limit")), periods, [*part, "k"], "inner")
    inside = found.where(F.col("period_hours").between(*hours)).drop("_limit")
    return _strongest(inside, "power", "k", part, top)


def autocorrelation(
    df: DataFrame, value: str, order: list[str], max_lag: int = 7 * 24 * 60, part: tuple[str, ...] = ("station",)
) -> DataFrame:
    """Biased autocorrelation at the lags ``0 .. min(max_lag, n / 4)`` by a padded transform and its inverse."""
    keys = list(part)
    rows = _indexed(df, value, order, keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"), F.avg("x").alias("_mean"))
    sizes = settled(sizes.withColumn("_m", _power_of_two(2 * F.col("_len"))))
    placed = null_safe_join(rows, sizes, keys, "inner")
    values = placed.select(*keys, "_m", "i", (F.col("x") - F.col("_mean")).alias("re"), F.lit(0.0).alias("im"))
    zeros = _padding(sizes, keys, F.col("_len"), F.col("_m")).select(*keys, "_m", "i", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    forward = four_step_fft(_power_of_two_cut(values.unionByName(zeros), "_m"), keys)
    power = forward.select(
        *keys, F.col("_n").alias("_m"), F.col("k").alias("i"), (F.col("re") ** 2 + F.col("im") ** 2).alias("re"), F.lit(0.0).alias("im")
    )
    back = four_step_fft(_power_of_two_cut(power, "_m"), keys)
    kept = null_safe_join(back, sizes.select(*keys, "_len"), keys, "inner")
    kept = kept.where(F.col("k") <= F.least(F.lit(max_lag), F.floor(F.col("_len") / 4)))
    kept = settled(kept.select(*keys, F.col("k").alias("lag"), "re"))
    zero = kept.where("lag = 0").select(*keys, F.col("re").alias("_zero"))
    joined = null_safe_join(kept, zero, keys, "inner")
    return joined.select(*keys, "lag", F.try_divide("re", "_zero").alias("acf"))


def autocorrelation_at(
    df: DataFrame, value: str, order: list[str], lags: list[int], part: tuple[str, ...] = ("station",)
) -> DataFrame:
    """The same for a short list of lags, as an equi join of the series with itself at ``i + lag``."""
    keys = list(part)
    rows = _indexed(df, value, order, keys)
    sizes = settled(rows.groupBy(*keys).agg(F.avg("x").alias("_mean"), (F.var_pop("x") * F.count("x")).alias("_ss")))
    centred = null_safe_join(rows, sizes, keys, "inner").select(*keys, "i", (F.col("x") - F.col("_mean")).alias("_x"), "_ss")
    early = centred.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("long") for k in lags])))
    early = early.select(*keys, "lag", (F.col("i") + F.col("lag")).alias("i"), F.col("_x").alias("_y"), "_ss")
    pairs = null_safe_join(early, centred.select(*keys, "i", "_x"), [*keys, "i"], "inner")
    total = F.sum(F.col("_x") * F.col("_y"))
    return pairs.groupBy(*keys, "lag").agg(F.try_divide(total, F.max("_ss")).alias("acf"))


def autocorrelation_peaks(
    acf: DataFrame, per_hour: float = 60.0, height: float = 0.1, hours: tuple[float, float] = (1.0, 168.0),
    top: int = 10, part: tuple[str, ...] = ("station",),
) -> DataFrame:
    """Local maxima of the lags above 0 that reach ``height``, between one hour and a week, strongest first."""
    peaks = local_maxima(acf.where("lag > 0"), "acf", "lag", part).where(F.col("acf") >= height)
    inside = peaks.withColumn("lag_hours", F.col("lag") / per_hour).where(F.col("lag_hours").between(*hours))
    return _strongest(inside, "acf", "lag", part, top)


def autocorrelation_by_hour(acf: DataFrame, per_hour: int = 60, days: int = 10) -> DataFrame:
    """Every full hour of the first ten days of lags."""
    chosen = acf.where((F.col("lag") % per_hour == 0) & (F.col("lag") < days * 24 * per_hour))
    return chosen.withColumn("lag_hours", F.col("lag") / per_hour)
