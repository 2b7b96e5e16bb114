"""Queries of the spectra, autocorrelation and window samples."""

from pyspark.sql import functions as F

from voltlane.operators import spectra as op
from voltlane.operators import window_samples as ws
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import ORACLES, query, rounded
from voltlane.queries.series import REGULAR, SPEC, WINDOWED, hourly, hourly_labelled, regular

_LONG = (
    WINDOWED
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT station, window_id, window_start, n, pos, '{c}' AS channel, {c} AS v FROM win" for c in fx.CHANNELS)
    + ")"
)
_WKEYS = "station, window_id, window_start"
_CDF = """CASE WHEN v > 9 THEN 1.0 WHEN v = 0 THEN 0.5 ELSE 0.5 + exp(-v * v / 2) / sqrt(2 * pi()) * list_sum(list_transform(
  range(0, 200), lambda j: exp((2 * j + 1) * ln(v) - ((j + 1) * ln(2) + lgamma(j + 1.5) - 0.5 * ln(pi()))))) END"""


def _wide(name: str, columns: list[str], digits: int = 6) -> str:
    picked = ", ".join(
        f"round(max({x}) FILTER (WHERE channel = '{c}'), {digits}) AS {c}_{x}" for c in fx.CHANNELS for x in columns
    )
    return f" SELECT {_WKEYS}, {picked} FROM {name} GROUP BY {_WKEYS}"


@query(
    "window_ks_normal",
    f"WITH {_LONG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {_WKEYS}, channel ORDER BY v) AS i, {_CDF} AS f FROM long), "
    + f"""ks AS (SELECT {_WKEYS}, channel, greatest(max(i / n::DOUBLE - f), max(f - (i - 1) / n::DOUBLE)) AS ks_test_statistic
    FROM ranked GROUP BY {_WKEYS}, channel)"""
    + _wide("ks", ["ks_test_statistic"]),
)
def window_ks_normal(spark, d):
    return rounded(op.window_ks_normal(hourly(spark, d), SPEC, fx.CHANNELS))


_DFT = (
    _LONG
    + f""", dft AS (SELECT {_WKEYS}, channel, k, n, k * (1.0::DOUBLE / n) AS f, ((n - 1) // 2) * (1.0::DOUBLE / n) AS top,
    sqrt(sum(v * cos(2 * pi() * k * pos / n)) ** 2 + sum(v * sin(2 * pi() * k * pos / n)) ** 2) AS m
  FROM long, range(1, 20) t(k) WHERE k <= (n - 1) // 2 GROUP BY {_WKEYS}, channel, k, n)"""
)


@query(
    "window_fft_features",
    f"WITH {_DFT}"
    + f""", feats AS (SELECT {_WKEYS}, channel, arg_max(f, m) AS dominant_frequency, max(m) AS spectral_peak,
    exp(avg(ln(m + 1e-10))) / (avg(m) + 1e-10) AS spectral_flatness,
    sum(m) FILTER (WHERE f <= top / 3) / (sum(m) FILTER (WHERE f > 2 * top / 3) + 1e-10) AS freq_energy_ratio_low_high
    FROM dft GROUP BY {_WKEYS}, channel)"""
    + _wide("feats", ["dominant_frequency", "spectral_peak", "spectral_flatness", "freq_energy_ratio_low_high"]),
)
def window_fft_features(spark, d):
    return rounded(op.window_fft_features(hourly(spark, d), SPEC, fx.CHANNELS))


@query(
    "window_welch_features",
    f"WITH {_LONG}"
    + f""", seg AS (SELECT {_WKEYS}, channel, s, n // 2 AS l, pos - s * (n // 2 - n // 2 // 2) AS j, v FROM long, range(0, 10) t(s)
      WHERE pos >= s * (n // 2 - n // 2 // 2) AND pos < s * (n // 2 - n // 2 // 2) + n // 2
        AND s * (n // 2 - n // 2 // 2) + n // 2 <= n),
    tapered AS (SELECT *, (v - avg(v) OVER (PARTITION BY {_WKEYS}, channel, s)) * (0.5 - 0.5 * cos(2 * pi() * j / l)) AS x,
      (0.5 - 0.5 * cos(2 * pi() * j / l)) ** 2 AS w2 FROM seg),
    psd AS (SELECT {_WKEYS}, channel, s, k, CASE WHEN k = 0 OR (l % 2 = 0 AND k = l // 2) THEN 1 ELSE 2 END
      * (sum(x * cos(2 * pi() * k * j / l)) ** 2 + sum(x * sin(2 * pi() * k * j / l)) ** 2) / sum(w2) AS p
      FROM tapered, range(0, 20) t(k) WHERE k <= l // 2 GROUP BY {_WKEYS}, channel, s, k, l),
    mean_psd AS (SELECT {_WKEYS}, channel, k, avg(p) AS p FROM psd GROUP BY {_WKEYS}, channel, k),
    feats AS (SELECT {_WKEYS}, channel, max(p) AS welch_peak_power, sum(p) AS welch_total_power FROM mean_psd
      GROUP BY {_WKEYS}, channel)"""
    + _wide("feats", ["welch_peak_power", "welch_total_power"]),
)
def window_welch_features(spark, d):
    return rounded(op.window_welch_features(hourly(spark, d), SPEC, fx.CHANNELS))


_SINGLE = [
    "window_mean_std", "window_change_point", "window_skew", "window_trend_slope", "window_label", "window_midpoint",
    "window_ks_normal", "window_fft_features", "window_welch_features",
]
_DIGITS = {"_mean": 9, "_std": 9, "_change_point_score": 7, "_skew": 5, "_trend_slope": 5}


@query(
    "window_features",
    "SELECT * FROM " + " JOIN ".join(f"({ORACLES[n]}) {'' if i == 0 else 'USING (' + _WKEYS + ')'}" for i, n in enumerate(_SINGLE)),
)
def window_features(spark, d):
    out = op.window_features(hourly_labelled(spark, d), SPEC, fx.CHANNELS)
    digits = lambda c: next((n for end, n in _DIGITS.items() if c.endswith(end)), 6)
    return out.withColumns({c: F.round(c, digits(c)) for c, t in out.dtypes if t == "double"})


RATE = 1 / 3600
_SPECTRUM = (
    WINDOWED.split(", bounds AS")[0]
    + """, days AS (SELECT station, CAST(ts AS DATE) AS day, ts, CASE WHEN hour(ts) <> 5 THEN value END AS value, k,
    CASE WHEN max(anomaly_label) OVER (PARTITION BY station, CAST(ts AS DATE)) = 1 THEN 'anomaly' ELSE 'normal' END AS class
    FROM hourly_labelled),
  long AS (SELECT station, day, class, ts, 'value' AS channel, value AS v FROM days UNION ALL
    SELECT station, day, class, ts, 'k' AS channel, k FROM days),
  placed AS (SELECT *, row_number() OVER (PARTITION BY station, day, channel ORDER BY ts) - 1 AS pos,
    count(*) OVER (PARTITION BY station, day, channel) AS n, count(v) OVER (PARTITION BY station, day, channel) AS known FROM long),
  marked AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
    first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1
    FROM placed WHERE n >= 12 AND known > 0
    WINDOW b AS (PARTITION BY station, day, channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           a AS (PARTITION BY station, day, channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT station, day, class, channel, pos, n,
    coalesce(v, CASE WHEN p1 > p0 THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, v1, v0) AS v FROM marked),
  lines AS (SELECT station, day, channel, regr_slope(v, pos) AS b, regr_intercept(v, pos) AS a FROM filled GROUP BY ALL),
  flat AS (SELECT f.*, v - (a + b * pos) AS d FROM filled f JOIN lines USING (station, day, channel)),
  amp AS (SELECT station, day, class, channel, k - 1 AS k, k * ((1 / 3600.0::DOUBLE) / n) AS freq,
    2.0 / n * sqrt(sum(d * (0.5 - 0.5 * cos(2 * pi() * pos / (n - 1))) * cos(2 * pi() * k * pos / n)) ** 2
      + sum(d * (0.5 - 0.5 * cos(2 * pi() * pos / (n - 1))) * sin(2 * pi() * k * pos / n)) ** 2) AS amplitude
    FROM flat, range(1, 30) t(k) WHERE k <= (n - 1) // 2 GROUP BY station, day, class, channel, k, n),
  psd AS (SELECT station, day, class, channel, k, k * ((1 / 3600.0::DOUBLE) / n) AS freq,
    CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END * 3600.0
      * (sum(d * (0.5 - 0.5 * cos(2 * pi() * pos / n)) * cos(2 * pi() * k * pos / n)) ** 2
      + sum(d * (0.5 - 0.5 * cos(2 * pi() * pos / n)) * sin(2 * pi() * k * pos / n)) ** 2)
      / sum((0.5 - 0.5 * cos(2 * pi() * pos / n)) ** 2) AS psd
    FROM flat, range(0, 30) t(k) WHERE k <= n // 2 GROUP BY station, day, class, channel, k, n)"""
)


def spectrum(spark, d):
    rows = hourly_labelled(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    classes = rows.groupBy("station", "day").agg(F.max("anomaly_label").alias("_m"))
    classes = classes.select("station", "day", F.when(F.col("_m") == 1, "anomaly").otherwise("normal").alias("class"))
    holed = rows.withColumn("value", F.expr("if(hour(ts) <> 5, value, null)"))
    arrays = op.window_arrays(holed, ["station", "day"], ["ts"], fx.CHANNELS, min_rows=12)
    return op.windowed_spectrum(arrays.join(classes, ["station", "day"]), RATE)


@query(
    "windowed_spectrum",
    f"""WITH {_SPECTRUM} SELECT station, day::VARCHAR AS day, class, channel, CAST(k AS INTEGER) AS k, round(freq, 9) AS freq,
    round(amplitude, 6) AS y, 'amplitude' AS kind FROM amp UNION ALL
    SELECT station, day::VARCHAR, class, channel, CAST(k AS INTEGER), round(freq, 9), round(psd, 1), 'psd' FROM psd""",
)
def windowed_spectrum(spark, d):
    s = spectrum(spark, d)
    amp = op.amplitudes(s).withColumn("y", F.round("amplitude", 6)).withColumn("kind", F.lit("amplitude")).drop("amplitude")
    psd = op.densities(s).withColumn("y", F.round("psd", 1)).withColumn("kind", F.lit("psd")).drop("psd")
    return amp.unionByName(psd).withColumn("freq", F.round("freq", 9))


@query(
    "dominant_frequencies",
    f"""WITH {_SPECTRUM} SELECT station, day::VARCHAR AS day, class, channel, round(freq, 9) AS freq, round(amplitude, 6) AS amplitude,
    CAST(row_number() OVER (PARTITION BY station, day, channel ORDER BY amplitude DESC) AS INTEGER) AS place FROM amp QUALIFY place <= 5""",
)
def dominant_frequencies(spark, d):
    out = op.dominant_frequencies(spectrum(spark, d))
    return out.withColumns({"freq": F.round("freq", 9), "amplitude": F.round("amplitude", 6)})


@query(
    "total_power",
    f"""WITH {_SPECTRUM} SELECT station, day::VARCHAR AS day, class, channel, round(sum(psd), 1) AS total_power FROM psd
    GROUP BY station, day, class, channel""",
)
def total_power(spark, d):
    return rounded(op.total_power(spectrum(spark, d)), 1)


@query(
    "mean_spectrum_by_class",
    f"""WITH {_SPECTRUM}, both_kinds AS (SELECT class, channel, round(freq, 9) AS freq, amplitude AS y, 'amplitude' AS kind FROM amp
    UNION ALL SELECT class, channel, round(freq, 9), psd, 'psd' FROM psd)
    SELECT class, channel, freq, kind, count(*) AS windows, round(avg(y), 2) AS mean FROM both_kinds GROUP BY ALL""",
)
def mean_spectrum_by_class(spark, d):
    out = op.mean_spectrum_by_class(spectrum(spark, d))
    return out.withColumns({"freq": F.round("freq", 9), "mean": F.round("mean", 2)})


_BANDS = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in op.BANDS.items())
_ENERGY = f"""WITH {_SPECTRUM}, bands(band, lo, hi) AS (VALUES {_BANDS}),
  energy AS (SELECT station, day, class, channel, band, coalesce(sum(psd) FILTER (WHERE freq >= lo AND freq < hi), 0.0) AS energy
    FROM psd, bands GROUP BY station, day, class, channel, band)"""


@query("band_energy", _ENERGY + " SELECT station, day::VARCHAR AS day, class, channel, band, round(energy, 1) AS energy FROM energy")
def band_energy(spark, d):
    return rounded(op.band_energy(spectrum(spark, d)), 1)


@query(
    "band_energy_ratio",
    _ENERGY
    + """, means AS (SELECT channel, band, avg(energy) FILTER (WHERE class = 'normal') AS nm,
      avg(energy) FILTER (WHERE class = 'anomaly') AS am FROM energy GROUP BY channel, band)
    SELECT channel, band, round(nm, 1) AS normal_mean, round(am, 1) AS anomaly_mean,
      round(CASE WHEN nm > 0 THEN am / nm ELSE 0.0 END, 6) AS ratio FROM means WHERE nm IS NOT NULL AND am IS NOT NULL""",
)
def band_energy_ratio(spark, d):
    out = op.band_energy_ratio(op.band_energy(spectrum(spark, d)))
    return out.withColumns(
        {"normal_mean": F.round("normal_mean", 1), "anomaly_mean": F.round("anomaly_mean", 1), "ratio": F.round("ratio", 6)}
    )


_PERIODOGRAM = f"""WITH {REGULAR}, sizes AS (SELECT station, count(*) AS n FROM regular GROUP BY station),
  power AS (SELECT r.station, k, k / s.n::DOUBLE AS frequency, sum(value * cos(2 * pi() * ((k * slot) % n) / n)) ** 2
    + sum(value * sin(2 * pi() * ((k * slot) % n) / n)) ** 2 AS power, n / k::DOUBLE AS period_hours
    FROM regular r JOIN sizes s USING (station), range(1, 400) t(k) WHERE 2 * k < n GROUP BY r.station, k, n)"""


def _periodogram(spark, d):
    return op.periodogram(regular(spark, d), "value", ["slot"], minutes=60)


@query(
    "periodogram",
    _PERIODOGRAM
    + """ SELECT station, CAST(k AS BIGINT) AS k, round(frequency, 6) AS frequency, round(power, 2) AS power,
    round(period_hours, 6) AS period_hours FROM power""",
)
def periodogram(spark, d):
    out = _periodogram(spark, d)
    return out.withColumns(
        {"frequency": F.round("frequency", 6), "power": F.round("power", 2), "period_hours": F.round("period_hours", 6)}
    )


@query(
    "spectral_peaks",
    _PERIODOGRAM
    + """, sides AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b,
      (SELECT quantile_cont(power, 0.95) FROM power q WHERE q.station = p.station) AS floor_power
      FROM power p WINDOW w AS (PARTITION BY station ORDER BY k))
    SELECT station, CAST(k AS BIGINT) AS k, round(power, 2) AS power, round(period_hours, 6) AS period_hours,
      CAST(row_number() OVER (PARTITION BY station ORDER BY power DESC) AS INTEGER) AS place FROM sides
    WHERE power > a AND power > b AND power >= floor_power AND period_hours BETWEEN 0.5 AND 168 QUALIFY place <= 10""",
)
def spectral_peaks(spark, d):
    out = op.spectral_peaks(_periodogram(spark, d))
    return out.withColumns({"power": F.round("power", 2), "period_hours": F.round("period_hours", 6)})


_ACF = f"""WITH {REGULAR}, centred AS (SELECT station, slot, value - avg(value) OVER (PARTITION BY station) AS x,
    count(*) OVER (PARTITION BY station) AS n FROM regular),
  acf AS (SELECT a.station, b.slot - a.slot AS lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM centred c WHERE c.station = a.station) AS acf
    FROM centred a JOIN centred b ON a.station = b.station AND b.slot >= a.slot AND b.slot <= a.slot + least(168, a.n // 4)
    GROUP BY a.station, b.slot - a.slot)"""


def _acf(spark, d):
    return op.autocorrelation(regular(spark, d), "value", ["slot"], max_lag=168)


@query("autocorrelation", _ACF + " SELECT station, CAST(lag AS BIGINT) AS lag, round(acf, 6) AS acf FROM acf")
def autocorrelation(spark, d):
    return rounded(_acf(spark, d))


@query(
    "autocorrelation_at",
    _ACF + " SELECT station, CAST(lag AS BIGINT) AS lag, round(acf, 6) AS acf FROM acf WHERE lag IN (1, 12, 24, 48)",
)
def autocorrelation_at(spark, d):
    return rounded(op.autocorrelation_at(regular(spark, d), "value", ["slot"], [1, 12, 24, 48]))


@query(
    "autocorrelation_peaks",
    _ACF
    + """, sides AS (SELECT *, lag(acf) OVER w AS a, lead(acf) OVER w AS b FROM acf WHERE lag > 0 WINDOW w AS (PARTITION BY station ORDER BY lag))
    SELECT station, CAST(lag AS BIGINT) AS lag, round(acf, 6) AS acf, lag::DOUBLE AS lag_hours,
    CAST(row_number() OVER (PARTITION BY station ORDER BY acf DESC) AS INTEGER) AS place FROM sides
    WHERE acf > a AND acf > b AND acf >= 0.01 QUALIFY place <= 10""",
)
def autocorrelation_peaks(spark, d):
    return rounded(op.autocorrelation_peaks(_acf(spark, d), per_hour=1, height=0.01))


@query(
    "autocorrelation_by_hour",
    _ACF + " SELECT station, CAST(lag AS BIGINT) AS lag, round(acf, 6) AS acf, lag / 2.0 AS lag_hours FROM acf WHERE lag % 2 = 0",
)
def autocorrelation_by_hour(spark, d):
    return rounded(op.autocorrelation_by_hour(_acf(spark, d), per_hour=2))


_TAIL = """, counted AS (SELECT t.station, t.window_start, t.hash, count(*) AS n_rows FROM tried t JOIN readings r
    ON r.station = t.station AND r.ts >= t.window_start AND r.ts < t.window_start + INTERVAL {s} SECOND GROUP BY ALL)
  SELECT station, window_start, window_start + INTERVAL {s} SECOND AS window_end, n_rows FROM counted WHERE n_rows >= {m}
  ORDER BY hash LIMIT 20"""


@query(
    "sample_normal_windows",
    f"""WITH {fx.READINGS}, {fx.INTERVALS}, tried AS (SELECT station, ts AS window_start,
    md5(concat_ws('|', '42', station, epoch_us(ts))) AS hash FROM (SELECT DISTINCT station, ts FROM readings r WHERE NOT EXISTS (
      SELECT 1 FROM intervals i WHERE i.station = r.station AND r.ts BETWEEN i.start_ts - INTERVAL 10 MINUTE
      AND i.end_ts + INTERVAL 10 MINUTE)) ORDER BY hash LIMIT 200)"""
    + _TAIL.format(s=3600, m=3.8),
)
def sample_normal_windows(spark, d):
    return ws.sample_normal_windows(fx.readings(spark, d), fx.intervals(spark, d), 3600, 20, expected=4)


@query(
    "sample_anomaly_windows",
    f"""WITH {fx.READINGS}, {fx.INTERVALS}, usable AS (SELECT *, md5(concat_ws('|', '42', station, epoch_us(start_ts))) AS hash,
      CAST(floor((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0 - 900) AS BIGINT) AS room
      FROM intervals WHERE (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0 >= 900 ORDER BY hash LIMIT 20),
    tried AS (SELECT station, hash, start_ts + to_seconds(CASE WHEN room > 0 THEN CAST('0x' || substr(hash, 1, 8) AS BIGINT) % room
      ELSE 0 END) AS window_start FROM usable)"""
    + _TAIL.format(s=900, m=1.9),
)
def sample_anomaly_windows(spark, d):
    return ws.sample_anomaly_windows(fx.readings(spark, d), fx.intervals(spark, d), 900, 20, expected=2)
