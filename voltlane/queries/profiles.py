"""Queries of the counts, distributions and profiles."""

from pyspark.sql import functions as F

from voltlane.operators import cleaning, profiles as op, sampling
from voltlane.operators import intervals as iv
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

_CLASS = """count(*) AS total, count(*) FILTER (WHERE {l} = 1) AS anomalies, count(*) FILTER (WHERE {l} <> 1) AS normals,
  round(count(*) FILTER (WHERE {l} = 1) / count(*)::DOUBLE, 6) AS anomaly_share,
  round(count(*) FILTER (WHERE {l} <> 1) / count(*)::DOUBLE, 6) AS normal_share,
  round(count(*) FILTER (WHERE {l} <> 1) / nullif(count(*) FILTER (WHERE {l} = 1), 0)::DOUBLE, 6) AS normals_per_anomaly"""
_SPLIT = f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx,
  count(*) OVER () AS n FROM feature_rows), split_rows AS (SELECT *, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN idx < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)"""
_MINUTES = f"""WITH {fx.INTERVALS}, minutes AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0 AS minutes
  FROM intervals)"""
_QUART = """round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.5), 6) AS median,
  round(quantile_cont({v}, 0.75), 6) AS q3"""


def labelled(spark, d):
    return iv.label_points_by_interval(fx.readings(spark, d), fx.intervals(spark, d))


def split_rows(spark, d):
    return sampling.sequential_split(fx.features(spark, d), fx.SORT)


def minutes(spark, d):
    rows = iv.interval_durations(fx.downtimes(spark, d))
    return rows.select("event_id", "station", F.col("duration_minutes").alias("minutes"))


@query("class_ratio", "SELECT " + _CLASS.format(l="toxic") + " FROM labels")
def class_ratio(spark, d):
    return rounded(op.class_ratio(fx.table(spark, d, "labels"), "toxic"))


@query(
    "class_ratio_by_split",
    _SPLIT + " SELECT coalesce(split, 'total') AS split, " + _CLASS.format(l="label") + " FROM split_rows GROUP BY ROLLUP (split)",
)
def class_ratio_by_split(spark, d):
    return rounded(op.class_ratio_by_split(split_rows(spark, d), "label"))


@query(
    "label_statistics",
    f"""WITH {fx.LABELLED} SELECT station, count(*) AS total, count(*) FILTER (WHERE anomaly_label = 1) AS anomalies,
    round(avg(anomaly_label) * 100, 6) AS anomaly_percent, min(ts) AS first_time, max(ts) AS last_time,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS span_days FROM labelled GROUP BY station""",
)
def label_statistics(spark, d):
    return rounded(op.label_statistics(labelled(spark, d)))


@query(
    "data_info",
    _SPLIT
    + """ SELECT split, count(*) AS size, 4 AS n_features, round(avg(label), 6) AS label_mean,
    count(*) FILTER (WHERE label = 0) AS n_negative, count(*) FILTER (WHERE label = 1) AS n_positive FROM split_rows GROUP BY split""",
)
def data_info(spark, d):
    return rounded(op.data_info(split_rows(spark, d), fx.FEATURES))


@query("value_counts", f"WITH {fx.READINGS} SELECT station, count(*) AS n FROM readings GROUP BY station")
def value_counts(spark, d):
    return op.value_counts(fx.readings(spark, d), "station")


@query(
    "describe_downtime",
    f"""WITH {fx.RAW_LOG}, m AS (SELECT CASE WHEN len(string_split("Downtime", ':')) = 3 THEN
      TRY_CAST(string_split("Downtime", ':')[1] AS DOUBLE) * 60 + TRY_CAST(string_split("Downtime", ':')[2] AS DOUBLE)
      + TRY_CAST(string_split("Downtime", ':')[3] AS DOUBLE) / 60 END AS m FROM raw_log)
    SELECT count(m) AS count, count(*) - count(m) AS nulls, round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS std,
      round(min(m), 5) AS min, round(max(m), 5) AS max, round(quantile_cont(m, 0.25), 5) AS q1,
      round(quantile_cont(m, 0.5), 5) AS median, round(quantile_cont(m, 0.75), 5) AS q3 FROM m""",
)
def describe_downtime(spark, d):
    return rounded(op.describe_downtime(cleaning.parse_downtime(fx.raw_log(spark, d)), "DowntimeSeconds"), 5)


@query(
    "duration_stats",
    _MINUTES
    + " SELECT station, count(*) AS count, round(avg(minutes), 6) AS mean, round(stddev_pop(minutes), 6) AS std, "
    + "round(min(minutes), 6) AS min, round(max(minutes), 6) AS max, " + _QUART.format(v="minutes") + " FROM minutes GROUP BY station",
)
def duration_stats(spark, d):
    return rounded(op.duration_stats(minutes(spark, d), "minutes"))


@query(
    "duration_distribution",
    _MINUTES
    + """, edges AS (SELECT station, unnest([0, 5, 10, 15, 30, 60, 120, 240, 480]) AS low, max(minutes) AS top
      FROM minutes GROUP BY station),
    bins AS (SELECT station, low, lead(low) OVER (PARTITION BY station ORDER BY low) AS high,
      CAST(row_number() OVER (PARTITION BY station ORDER BY low) - 1 AS INTEGER) AS position FROM edges WHERE low <= top)
    SELECT b.station, b.position, CASE WHEN high IS NULL THEN low || '+' ELSE low || '-' || high END AS bin,
      (SELECT count(*) FROM minutes m WHERE m.station = b.station AND m.minutes > low AND (high IS NULL OR m.minutes <= high)) AS events,
      (SELECT count(*) FROM minutes m WHERE m.station = b.station AND m.minutes <= 0) AS outside FROM bins b""",
)
def duration_distribution(spark, d):
    return op.duration_distribution(minutes(spark, d), "minutes")


@query(
    "duration_ecdf",
    _MINUTES
    + """ SELECT event_id, station, round(minutes, 6) AS minutes, CAST(row_number() OVER w - 1 AS BIGINT) AS idx,
    round(row_number() OVER w / (count(*) OVER p)::DOUBLE, 6) AS share,
    round((row_number() OVER w - 1) / (count(*) OVER p - 1)::DOUBLE, 6) AS share_from_zero FROM minutes
    WINDOW p AS (PARTITION BY station), w AS (PARTITION BY station ORDER BY minutes, event_id)""",
)
def duration_ecdf(spark, d):
    return rounded(op.duration_ecdf(minutes(spark, d), "minutes", ["event_id"]))


@query(
    "fixed_width_histogram",
    _MINUTES
    + """, bounds AS (SELECT min(minutes) AS lo, max(minutes) AS hi, count(*) AS total FROM minutes),
    counted AS (SELECT least(CAST(floor((minutes - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin, count(*) AS n
      FROM minutes, bounds GROUP BY 1)
    SELECT CAST(g AS BIGINT) AS bin, round(lo + g * ((hi - lo) / 30), 6) AS left_edge, round(lo + (g + 1) * ((hi - lo) / 30), 6) AS right_edge,
      coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE / ((hi - lo) / 30), 6) AS density
    FROM range(30) t(g) CROSS JOIN bounds LEFT JOIN counted ON counted.bin = g""",
)
def fixed_width_histogram(spark, d):
    return rounded(op.fixed_width_histogram(minutes(spark, d), "minutes", 30))


@query(
    "box_stats",
    _MINUTES
    + """, q AS (SELECT station, quantile_cont(minutes, 0.25) AS q1, quantile_cont(minutes, 0.5) AS median,
      quantile_cont(minutes, 0.75) AS q3 FROM minutes GROUP BY station)
    SELECT station, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(min(minutes) FILTER (WHERE minutes >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max(minutes) FILTER (WHERE minutes <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      count(*) FILTER (WHERE minutes < q1 - 1.5 * (q3 - q1) OR minutes > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM minutes JOIN q USING (station) GROUP BY station, q1, median, q3""",
)
def box_stats(spark, d):
    return rounded(op.box_stats(minutes(spark, d), "minutes"))


@query(
    "column_quality",
    f"WITH {fx.READINGS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count(v) AS missing,
        round((count(*) - count(v)) / count(*)::DOUBLE * 100, 6) AS missing_percent, count(*) FILTER (WHERE v = 0) AS zeros,
        round(count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE * 100, 6) AS zero_percent, count(DISTINCT v) AS "distinct",
        count(DISTINCT v) > 1 AS has_variance FROM (SELECT {e} AS v FROM readings)"""
        for c, e in (("value", "CASE WHEN event_id % 5 <> 0 THEN value END"), ("k", "k"), ("flat", "1.0"))
    ),
)
def column_quality(spark, d):
    rows = fx.readings(spark, d).select(
        F.expr("if(event_id % 5 <> 0, value, null)").alias("value"), "k", F.lit(1.0).alias("flat")
    )
    return rounded(op.column_quality(rows))


@query(
    "column_stats",
    f"WITH {fx.READINGS} "
    + " UNION ALL ".join(
        f"""SELECT station, '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS min, round(max({c}), 6) AS max, {_QUART.format(v=c)} FROM readings GROUP BY station"""
        for c in fx.CHANNELS
    ),
)
def column_stats(spark, d):
    return rounded(op.column_stats(fx.readings(spark, d), fx.CHANNELS))


@query(
    "structure_profile",
    "WITH docs AS (SELECT doc_id, lang, source FROM documents) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
        count(*) - count(DISTINCT {c}) AS duplicates,
        (SELECT string_agg({c}::VARCHAR, ', ' ORDER BY doc_id) FROM (SELECT * FROM docs ORDER BY doc_id LIMIT 3)) AS samples FROM docs"""
        for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"))
    ),
)
def structure_profile(spark, d):
    return op.structure_profile(fx.table(spark, d, "documents").select("doc_id", "lang", "source"), ["doc_id"])


@query(
    "duplicate_profile",
    """WITH whole AS (SELECT l_suppkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
    keyed AS (SELECT l_suppkey, l_linenumber, sum(n) AS k FROM whole GROUP BY ALL)
    SELECT CAST((SELECT sum(n) FROM whole) AS BIGINT) AS total,
      CAST((SELECT coalesce(sum(n), 0) FROM whole WHERE n > 1) AS BIGINT) AS full_row_duplicates,
      CAST((SELECT coalesce(sum(k), 0) FROM keyed WHERE k > 1) AS BIGINT) AS key_duplicates""",
)
def duplicate_profile(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    return op.duplicate_profile(rows, ["l_suppkey", "l_linenumber"])


@query(
    "distinct_text_values",
    """SELECT 'lang' AS "column", lang AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang
    UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def distinct_text_values(spark, d):
    return op.distinct_text_values(fx.table(spark, d, "documents"), ["lang", "source"])


@query("time_range", f"WITH {fx.READINGS} SELECT min(ts) AS first_time, max(ts) AS last_time, count(*) AS rows FROM readings")
def time_range(spark, d):
    return op.time_range(fx.readings(spark, d))


def _grouped(slot: str, key: str) -> str:
    return f"""WITH {fx.READINGS} SELECT CAST({key} AS INTEGER) AS {slot}, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM readings GROUP BY 1"""


@query("profile_by_hour", _grouped("hour", "hour(ts)"))
def profile_by_hour(spark, d):
    return rounded(op.profile_by_hour(fx.readings(spark, d), "value"))


@query("profile_by_weekday", _grouped("day_of_week", "isodow(ts) - 1"))
def profile_by_weekday(spark, d):
    return rounded(op.profile_by_weekday(fx.readings(spark, d), "value"))


@query(
    "profile_by_week_hour",
    f"""WITH {fx.READINGS} SELECT CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week,
    round(avg(value), 6) AS mean FROM readings GROUP BY 1""",
)
def profile_by_week_hour(spark, d):
    return rounded(op.profile_by_week_hour(fx.readings(spark, d), "value"))


@query(
    "heatmap_day_hour",
    f"WITH {fx.READINGS} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, "
    + ", ".join(f"round(avg(value) FILTER (WHERE hour(ts) = {h}), 6) AS h{h}" for h in range(24))
    + " FROM readings GROUP BY 1",
)
def heatmap_day_hour(spark, d):
    return rounded(op.heatmap_day_hour(fx.readings(spark, d), "value"))


@query(
    "workday_weekend_profile",
    f"""WITH {fx.READINGS} SELECT CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ts) AS INTEGER) AS hour,
    round(avg(value), 6) AS mean FROM readings GROUP BY 1, 2""",
)
def workday_weekend_profile(spark, d):
    return rounded(op.workday_weekend_profile(fx.readings(spark, d), "value"))


@query(
    "variation_by_hour",
    f"""WITH {fx.READINGS} SELECT CAST(hour(ts) AS INTEGER) AS hour, round(stddev_samp(value) / avg(value), 6) AS variation
    FROM readings GROUP BY 1""",
)
def variation_by_hour(spark, d):
    return rounded(op.variation_by_hour(fx.readings(spark, d), "value"))


@query(
    "periodicity_summary",
    f"""WITH {fx.READINGS}, h AS (SELECT CAST(hour(ts) AS INTEGER) AS s, avg(value) AS m FROM readings GROUP BY 1),
    w AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS s, avg(value) AS m FROM readings GROUP BY 1),
    e AS (SELECT avg(value) FILTER (WHERE isodow(ts) < 6) AS wd, avg(value) FILTER (WHERE isodow(ts) >= 6) AS we FROM readings)
    SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
      round(stddev_samp(value) / avg(value), 6) AS variation, (SELECT arg_max(s, m) FROM h) AS peak_hour,
      (SELECT arg_min(s, m) FROM h) AS low_hour, round((SELECT max(m) - min(m) FROM h), 6) AS hour_spread,
      (SELECT arg_max(s, m) FROM w) AS peak_day, (SELECT arg_min(s, m) FROM w) AS low_day,
      round((SELECT wd FROM e), 6) AS workday_mean, round((SELECT we FROM e), 6) AS weekend_mean,
      round((SELECT wd / we FROM e), 6) AS workday_weekend_ratio FROM readings""",
)
def periodicity_summary(spark, d):
    return rounded(op.periodicity_summary(fx.readings(spark, d), "value"))


_MIX = {"value": "value", "k": "k", "mix": "value + k / 10", "inverse": "-2 * value + event_id % 3"}
_MIX_SQL = f"WITH {fx.READINGS}, mixed AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _MIX.items()) + " FROM readings)"


def _mixed(spark, d):
    return fx.readings(spark, d).select(*[F.expr(e).cast("double").alias(c) for c, e in _MIX.items()])


@query(
    "correlation_matrix",
    f"WITH {fx.FEATURE_ROWS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM feature_rows" for a in fx.FEATURES for b in fx.FEATURES
    ),
)
def correlation_matrix(spark, d):
    return rounded(op.correlation_matrix(fx.features(spark, d), fx.FEATURES))


@query(
    "high_correlations",
    _MIX_SQL
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM mixed"
        for i, a in enumerate(_MIX)
        for b in list(_MIX)[i + 1 :]
    )
    + ") WHERE abs(r) > 0.8",
)
def high_correlations(spark, d):
    return rounded(op.high_correlations(op.correlation_matrix(_mixed(spark, d), list(_MIX)), list(_MIX)))


@query(
    "target_correlations",
    f"WITH {fx.FEATURE_ROWS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS r, round(abs(corr({c}, label)), 6) AS abs_r FROM feature_rows"
        for c in fx.FEATURES
    ),
)
def target_correlations(spark, d):
    return rounded(op.target_correlations(fx.features(spark, d), fx.FEATURES))


@query(
    "class_weights",
    f"""WITH {fx.FEATURE_ROWS}, c AS (SELECT label, count(*) AS n FROM feature_rows GROUP BY label)
    SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 6) AS weight FROM c""",
)
def class_weights(spark, d):
    return rounded(op.class_weights(fx.features(spark, d)))


@query(
    "positive_weight",
    f"""WITH {fx.FEATURE_ROWS} SELECT count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative,
    round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)::DOUBLE, 6) AS positive_weight FROM feature_rows""",
)
def positive_weight(spark, d):
    return rounded(op.positive_weight(fx.features(spark, d)))
