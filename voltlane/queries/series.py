"""Queries of resampling, sliding windows, sequences, gaps and seasonal components."""

from pyspark.sql import functions as F

from voltlane.operators import cleaning, series as op
from voltlane.operators import intervals as iv
from voltlane.plans.ordering import settled
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

HOURLY = (
    fx.LABELLED.split(", labelled AS")[0]
    + """, hourly AS (SELECT station, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS value, avg(k) AS k
    FROM readings GROUP BY 1, 2),
  hourly_labelled AS (SELECT h.*, CAST(EXISTS (SELECT 1 FROM intervals i WHERE i.station = h.station
    AND h.ts BETWEEN i.start_ts AND i.end_ts) AS INTEGER) AS anomaly_label FROM hourly h)"""
)
WINDOWED = (
    HOURLY
    + """, bounds AS (SELECT station, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY station),
  starts AS (SELECT station, CAST(g AS BIGINT) AS window_id, a + to_hours(6 * g) AS window_start FROM bounds, range(0, 2000) t(g)
    WHERE a + to_hours(6 * g) + INTERVAL 24 HOUR <= b),
  pairs AS (SELECT s.window_id, s.window_start, h.*, row_number() OVER (PARTITION BY s.station, s.window_id ORDER BY h.ts) - 1 AS pos,
      count(*) OVER (PARTITION BY s.station, s.window_id) AS n FROM starts s JOIN hourly_labelled h
    ON h.station = s.station AND h.ts >= s.window_start AND h.ts < s.window_start + INTERVAL 24 HOUR),
  win AS (SELECT * FROM pairs WHERE n >= 19)"""
)
SPEC = op.SlidingWindows(24 * 3600, 6 * 3600, expected=24)
_KEYS = "station, window_id, window_start"


def hourly(spark, d):
    """The resampled table, written once as the window operators read it several times."""
    return settled(op.downsample_time(fx.readings(spark, d), fx.CHANNELS, 3600))


def hourly_labelled(spark, d):
    rows = op.downsample_time(fx.readings(spark, d), fx.CHANNELS, 3600)
    return settled(iv.label_points_by_interval(rows, fx.intervals(spark, d)))


@query("downsample_time", f"WITH {HOURLY} SELECT station, ts, round(value, 7) AS value, round(k, 7) AS k FROM hourly")
def downsample_time(spark, d):
    return rounded(op.downsample_time(fx.readings(spark, d), fx.CHANNELS, 3600), 7)


@query(
    "sliding_windows",
    f"""WITH {WINDOWED} SELECT {_KEYS}, count(*) AS n_rows, window_start + INTERVAL 24 HOUR AS window_end FROM win
    GROUP BY {_KEYS}""",
)
def sliding_windows(spark, d):
    return op.sliding_windows(hourly(spark, d), SPEC)


@query(
    "window_label",
    f"WITH {WINDOWED} SELECT {_KEYS}, CAST(avg(anomaly_label) >= 0.3 AS INTEGER) AS anomaly_label FROM win GROUP BY {_KEYS}",
)
def window_label(spark, d):
    return op.window_label(hourly_labelled(spark, d), SPEC)


@query(
    "window_midpoint",
    f"""WITH {WINDOWED} SELECT {_KEYS}, make_timestamp(epoch_us(min(ts)) + CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 2) AS BIGINT))
    AS midpoint FROM win GROUP BY {_KEYS}""",
)
def window_midpoint(spark, d):
    return op.window_midpoint(hourly(spark, d), SPEC)


def _per_channel(template: str) -> str:
    return f"WITH {WINDOWED} SELECT {_KEYS}, " + ", ".join(template.format(c=c) for c in fx.CHANNELS) + f" FROM win GROUP BY {_KEYS}"


@query("window_mean_std", _per_channel("round(avg({c}), 9) AS {c}_mean, round(stddev_pop({c}), 9) AS {c}_std"))
def window_mean_std(spark, d):
    return rounded(op.window_mean_std(hourly(spark, d), SPEC, fx.CHANNELS), 9)


@query(
    "window_change_point",
    f"WITH {WINDOWED}, steps AS (SELECT *, "
    + ", ".join(f"abs({c} - lag({c}) OVER w) AS d_{c}" for c in fx.CHANNELS)
    + " FROM win WINDOW w AS (PARTITION BY station, window_id ORDER BY ts)) SELECT "
    + f"{_KEYS}, "
    + ", ".join(f"round(coalesce(max(d_{c}), 0.0), 7) AS {c}_change_point_score" for c in fx.CHANNELS)
    + f" FROM steps GROUP BY {_KEYS}",
)
def window_change_point(spark, d):
    return rounded(op.window_change_point(hourly(spark, d), SPEC, fx.CHANNELS), 7)


@query(
    "window_skew",
    f"WITH {WINDOWED}, centred AS (SELECT *, "
    + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY station, window_id) AS d_{c}" for c in fx.CHANNELS)
    + f" FROM win) SELECT {_KEYS}, "
    + ", ".join(
        f"round(CASE WHEN stddev_pop({c}) > 1e-10 THEN avg(d_{c} ** 3) / avg(d_{c} ** 2) ** 1.5 ELSE 0.0 END, 5) AS {c}_skew"
        for c in fx.CHANNELS
    )
    + f" FROM centred GROUP BY {_KEYS}",
)
def window_skew(spark, d):
    return rounded(op.window_skew(hourly(spark, d), SPEC, fx.CHANNELS), 5)


@query(
    "window_trend_slope",
    _per_channel("round(CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE regr_slope({c}, pos) END, 5) AS {c}_trend_slope"),
)
def window_trend_slope(spark, d):
    return rounded(op.window_trend_slope(hourly(spark, d), SPEC, fx.CHANNELS), 5)


_SEQ = f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx,
  count(*) OVER () AS n FROM feature_rows), starts AS (SELECT CAST(g AS BIGINT) AS window_id FROM
  range(0, (SELECT count(*) FROM feature_rows)) t(g) WHERE g * 20 + 60 <= (SELECT count(*) FROM feature_rows)),
  seq AS (SELECT s.window_id, p.* FROM starts s JOIN placed p ON p.idx >= s.window_id * 20 AND p.idx < s.window_id * 20 + 60)"""


@query(
    "sequence_windows",
    _SEQ
    + """ SELECT window_id, string_agg(label::VARCHAR, '' ORDER BY idx) AS labels, count(*) AS n_rows,
    round(sum(l_quantity::FLOAT::DOUBLE * (idx - window_id * 20 + 1)), 3) AS weighted FROM seq GROUP BY window_id""",
)
def sequence_windows(spark, d):
    windows = op.sequence_windows(fx.features(spark, d), fx.FEATURES, fx.SORT, 60, 20, "label")
    weighted = F.aggregate(
        F.transform("features", lambda x, i: x[0].cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return windows.select(
        "window_id",
        F.array_join(F.transform("labels", lambda y: y.cast("string")), "").alias("labels"),
        F.size("features").cast("long").alias("n_rows"),
        F.round(weighted, 3).alias("weighted"),
    )


@query(
    "sequence_label_share",
    _SEQ + " SELECT CAST(sum(label) AS BIGINT) AS anomalies, count(*) AS timesteps, round(avg(label), 6) AS share FROM seq",
)
def sequence_label_share(spark, d):
    return rounded(op.sequence_label_share(fx.features(spark, d), fx.SORT, 60, 20, "label"))


GAPS = f"""WITH {fx.READINGS}, gaps AS (SELECT station, ts, event_id, lag(ts) OVER w AS previous,
  (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 AS gap_seconds FROM readings
  WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))"""


def gaps(spark, d):
    return op.intervals_between_rows(fx.readings(spark, d), tie=("event_id",))


@query("intervals_between_rows", GAPS + " SELECT station, ts, event_id, previous, round(gap_seconds, 6) AS gap_seconds FROM gaps")
def intervals_between_rows(spark, d):
    return rounded(gaps(spark, d))


_STATS = """SELECT station, count(*) AS points, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_seconds,
  avg(gap_seconds) AS mean, min(gap_seconds) AS min, max(gap_seconds) AS max, stddev_samp(gap_seconds) AS std,
  quantile_cont(gap_seconds, 0.5) AS median FROM gaps GROUP BY station"""


@query(
    "interval_stats",
    GAPS
    + f""" SELECT station, points, {', '.join(f'round({c}, 5) AS {c}' for c in ('span_seconds', 'mean', 'min', 'max', 'std', 'median'))}
    FROM ({_STATS})""",
)
def interval_stats(spark, d):
    return rounded(op.interval_stats(gaps(spark, d)), 5)


@query(
    "interval_stats_population",
    GAPS
    + """ SELECT station, round(min(gap_seconds), 5) AS min, round(max(gap_seconds), 5) AS max, round(avg(gap_seconds), 5) AS mean,
    round(stddev_pop(gap_seconds), 5) AS std FROM gaps GROUP BY station""",
)
def interval_stats_population(spark, d):
    return rounded(op.interval_stats_population(gaps(spark, d)), 5)


@query(
    "common_intervals",
    f"""WITH {fx.READINGS}, slots AS (SELECT DISTINCT station, time_bucket(INTERVAL 10 MINUTE, ts) AS ts FROM readings),
    gaps AS (SELECT station, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station ORDER BY ts))) / 1000000.0 AS gap_seconds FROM slots),
    counts AS (SELECT station, gap_seconds::DOUBLE AS gap_seconds, count(*) AS n FROM gaps WHERE gap_seconds IS NOT NULL GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY station ORDER BY n DESC, gap_seconds) AS INTEGER) AS place FROM counts QUALIFY place <= 5""",
)
def common_intervals(spark, d):
    slots = op.downsample_time(fx.readings(spark, d), ["value"], 600)
    return op.common_intervals(op.intervals_between_rows(slots))


@query(
    "significant_gaps",
    GAPS + """ SELECT station, previous AS gap_start, ts AS gap_end, round(gap_seconds, 6) AS gap_seconds FROM gaps
    WHERE gap_seconds > 300""",
)
def significant_gaps(spark, d):
    return rounded(op.significant_gaps(gaps(spark, d)))


@query(
    "gap_count",
    GAPS
    + """ SELECT station, count(*) FILTER (WHERE gap_seconds > 300) AS gaps,
    greatest(count(*) FILTER (WHERE gap_seconds > 300) - 20, 0) AS not_listed FROM gaps GROUP BY station""",
)
def gap_count(spark, d):
    return op.gap_count(gaps(spark, d))


@query(
    "continuity_score",
    GAPS + f" SELECT station, round(least(100.0, points / (span_seconds / median) * 100), 5) AS continuity_score FROM ({_STATS})",
)
def continuity_score(spark, d):
    return rounded(op.continuity_score(op.interval_stats(gaps(spark, d))), 5)


REGULAR = f"""{fx.READINGS}, bounds AS (SELECT station, min(ts) AS a, max(ts) AS b FROM readings GROUP BY station),
  grid AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM bounds),
  regular AS (SELECT g.station, CAST(row_number() OVER (PARTITION BY g.station ORDER BY g.ts) - 1 AS BIGINT) AS slot, g.ts, r.value
    FROM grid g ASOF JOIN readings r ON g.station = r.station AND g.ts >= r.ts)"""
_PARTS = f"""WITH {REGULAR}, trended AS (SELECT *, CASE WHEN slot >= 12 AND slot <= max(slot) OVER p - 12 THEN
    (0.5 * (lag(value, 12) OVER w + lead(value, 12) OVER w) + sum(value) OVER (PARTITION BY station ORDER BY slot
      ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)) / 24 END AS trend FROM regular
    WINDOW p AS (PARTITION BY station), w AS (PARTITION BY station ORDER BY slot)),
  phases AS (SELECT station, slot % 24 AS phase, avg(value - trend) AS p FROM trended GROUP BY 1, 2),
  parts AS (SELECT t.*, f.p - (SELECT avg(p) FROM phases g WHERE g.station = t.station) AS seasonal FROM trended t
    JOIN phases f ON f.station = t.station AND f.phase = t.slot % 24)"""


def regular(spark, d):
    return settled(cleaning.regularise_ffill(fx.readings(spark, d), ["value"], 3600))


@query(
    "seasonal_decompose",
    _PARTS
    + """ SELECT station, slot, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
    round(value - trend - seasonal, 6) AS residual FROM parts""",
)
def seasonal_decompose(spark, d):
    return rounded(op.seasonal_decompose(regular(spark, d), "value", 24).drop("ts", "value"))


@query(
    "variance_shares",
    _PARTS
    + """ SELECT station, round(var_samp(trend) / var_samp(value), 6) AS trend_share,
    round(var_samp(seasonal) / var_samp(value), 6) AS seasonal_share,
    round(var_samp(value - trend - seasonal) / var_samp(value), 6) AS residual_share FROM parts GROUP BY station""",
)
def variance_shares(spark, d):
    return rounded(op.variance_shares(op.seasonal_decompose(regular(spark, d), "value", 24), "value"))
