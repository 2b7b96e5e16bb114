"""Queries of the interval family."""

from pyspark.sql import functions as F

from voltlane.operators import intervals as op
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

_OVERLAPS = f"""WITH {fx.INTERVALS}, ordered AS (
  SELECT station, start_ts, end_ts,
    row_number() OVER w - 1 AS first_index,
    lead(start_ts) OVER w AS second_start, lead(end_ts) OVER w AS second_end
  FROM intervals WINDOW w AS (PARTITION BY station ORDER BY start_ts, end_ts))"""

STATION_MAP = {"S0": "S0", "S1": "S2"}

_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("merge_intervals", f"WITH {fx.MERGED} SELECT * FROM merged")
def merge_intervals(spark, d):
    return op.merge_intervals(fx.intervals(spark, d))


@query(
    "sorted_intervals",
    f"""WITH {fx.INTERVALS} SELECT station, start_ts, end_ts,
    CAST(row_number() OVER (PARTITION BY station ORDER BY start_ts, end_ts) - 1 AS BIGINT) AS position FROM intervals""",
)
def sorted_intervals(spark, d):
    return op.sorted_intervals(fx.intervals(spark, d))


@query(
    "adjacent_overlaps",
    _OVERLAPS
    + """ SELECT station, CAST(first_index AS BIGINT) AS first_index, start_ts AS first_start, end_ts AS first_end,
    CAST(first_index + 1 AS BIGINT) AS second_index, second_start, second_end,
    round((epoch_us(end_ts) - epoch_us(second_start)) / 1000000.0, 6) AS overlap_seconds
    FROM ordered WHERE end_ts >= second_start""",
)
def adjacent_overlaps(spark, d):
    return rounded(op.adjacent_overlaps(fx.intervals(spark, d)))


@query(
    "overlap_summary",
    _OVERLAPS
    + """ SELECT station, count(*) AS total_ranges, count(*) FILTER (WHERE end_ts >= second_start) AS overlaps,
    round(coalesce(sum(CASE WHEN end_ts >= second_start
      THEN (epoch_us(end_ts) - epoch_us(second_start)) / 1000000.0 END), 0.0), 4) AS overlap_seconds
    FROM ordered GROUP BY station""",
)
def overlap_summary(spark, d):
    return rounded(op.overlap_summary(fx.intervals(spark, d)), 4)


@query(
    "interval_durations",
    f"""WITH {fx.INTERVALS} SELECT station, start_ts, end_ts,
    round((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0, 6) AS duration_seconds,
    round((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0, 6) AS duration_minutes FROM intervals""",
)
def interval_durations(spark, d):
    return rounded(op.interval_durations(fx.intervals(spark, d)))


@query("label_points_by_interval", f"WITH {fx.LABELLED} SELECT event_id, station, ts, anomaly_label FROM labelled")
def label_points_by_interval(spark, d):
    points = fx.readings(spark, d).select("event_id", "station", "ts")
    return op.label_points_by_interval(points, fx.intervals(spark, d))


@query(
    "readings_in_interval",
    f"""WITH {fx.READINGS}, {fx.INTERVALS} SELECT r.event_id, r.station, r.ts, r.value, i.start_ts, i.end_ts, 1 AS anomaly
    FROM readings r JOIN intervals i ON r.station = i.station AND r.ts BETWEEN i.start_ts AND i.end_ts""",
)
def readings_in_interval(spark, d):
    return op.readings_in_interval(fx.readings(spark, d).drop("k"), fx.intervals(spark, d))


_COVERAGE = f"""WITH {fx.READINGS}, {fx.INTERVALS}, mapped AS (
  SELECT *, CASE station WHEN 'S0' THEN 'S0' WHEN 'S1' THEN 'S2' END AS target FROM intervals),
found AS (SELECT m.event_id, count(*) AS n, min(r.ts) AS first_reading, max(r.ts) AS last_reading
  FROM mapped m JOIN readings r ON r.station = m.target AND r.ts BETWEEN m.start_ts AND m.end_ts GROUP BY m.event_id),
coverage AS (SELECT m.event_id, m.station, m.start_ts, m.end_ts, coalesce(f.n, 0) AS found,
  CAST(floor((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0) AS BIGINT) + 1 AS expected,
  f.first_reading, f.last_reading, m.target FROM mapped m LEFT JOIN found f USING (event_id)),
status AS (SELECT * EXCLUDE (target), CASE WHEN target IS NULL THEN 'unknown_station' WHEN found = 0 THEN 'none'
  WHEN found >= expected * 0.002 THEN 'full' ELSE 'partial' END AS status FROM coverage)"""


def _coverage(spark, d):
    # readings are minutes apart here, so a share of 0.2 % stands in for 95 % of one-second readings
    return op.interval_coverage(
        fx.downtimes(spark, d), fx.readings(spark, d), STATION_MAP, key=["event_id"], full_share=0.002
    )


@query("interval_coverage", _COVERAGE + " SELECT * FROM status")
def interval_coverage(spark, d):
    return _coverage(spark, d)


@query(
    "coverage_first_last",
    _COVERAGE + " SELECT station, start_ts, end_ts, first_reading, last_reading FROM status WHERE status = 'partial'",
)
def coverage_first_last(spark, d):
    return op.coverage_first_last(_coverage(spark, d))


@query(
    "normal_points_buffered",
    f"""WITH {fx.READINGS}, {fx.INTERVALS} SELECT event_id, station, ts FROM readings r WHERE NOT EXISTS (
    SELECT 1 FROM intervals i WHERE i.station = r.station
    AND r.ts BETWEEN i.start_ts - INTERVAL 10 MINUTE AND i.end_ts + INTERVAL 10 MINUTE)""",
)
def normal_points_buffered(spark, d):
    return op.normal_points_buffered(fx.readings(spark, d).select("event_id", "station", "ts"), fx.intervals(spark, d))


@query(
    "align_scores",
    """WITH scores AS (SELECT event_type AS method, 'u' || user_id AS feature, round(max(value), 6) AS score
      FROM events GROUP BY 1, 2)
    SELECT feature, """ + ", ".join(f"max(score) FILTER (WHERE method = '{m}') AS \"{m}\"" for m in _EVENT_TYPES) + " FROM scores GROUP BY feature",
)
def align_scores(spark, d):
    scores = (
        fx.events(spark, d)
        .groupBy(F.col("event_type").alias("method"), F.concat(F.lit("u"), "user_id").alias("feature"))
        .agg(F.round(F.max("value"), 6).alias("score"))
    )
    return op.align_scores(scores, _EVENT_TYPES)
