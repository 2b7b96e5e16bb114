"""Queries of the projection, filter and cleaning operators."""

from pyspark.sql import functions as F

from voltlane.operators import cleaning as op
from voltlane.operators import sampling
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

_TITLE = (
    r"array_to_string(list_transform(regexp_extract_all(trim({c}), '[\p{{Lu}}\p{{Ll}}]+|[^\p{{Lu}}\p{{Ll}}]+'), "
    r"lambda x: upper(x[1]) || lower(x[2:])), '')"
)
_LOCAL = "try_strptime(trim(\"Date\"), '%d.%m.%Y, %H:%M:%S') - INTERVAL 1 HOUR"  # the tables hold January only
_SECONDS = """CASE WHEN len(string_split("Downtime", ':')) = 3 THEN TRY_CAST(string_split("Downtime", ':')[1] AS DOUBLE) * 3600
  + TRY_CAST(string_split("Downtime", ':')[2] AS DOUBLE) * 60 + TRY_CAST(string_split("Downtime", ':')[3] AS DOUBLE) END"""
_CLEAN = f"""WITH {fx.RAW_LOG}, clean AS (SELECT event_id, {_LOCAL} AS start_time, {_SECONDS} AS seconds FROM raw_log),
ended AS (SELECT *, start_time + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)) AS end_time FROM clean)"""


@query(
    "clean_text_fields",
    f"""WITH {fx.RAW_LOG} SELECT event_id, {', '.join(_TITLE.format(c=f'"{c}"') + f' AS "{c}"' for c in ("Condition", "Line", "Shift"))},
    CASE WHEN "Station" IS NOT NULL THEN {_TITLE.format(c='"Station"')} END AS "Station", trim("Comment") AS "Comment" FROM raw_log""",
)
def clean_text_fields(spark, d):
    return op.clean_text_fields(fx.raw_log(spark, d)).select(
        "event_id", "Condition", "Line", "Shift", "Station", "Comment"
    )


@query("parse_local_timestamp", _CLEAN + ' SELECT event_id, start_time AS "StartTime" FROM ended')
def parse_local_timestamp(spark, d):
    return op.parse_local_timestamp(fx.raw_log(spark, d)).select("event_id", "StartTime")


@query("parse_downtime", _CLEAN + ' SELECT event_id, seconds AS "DowntimeSeconds" FROM ended')
def parse_downtime(spark, d):
    return op.parse_downtime(fx.raw_log(spark, d)).select("event_id", "DowntimeSeconds")


@query("derive_end_time", _CLEAN + ' SELECT event_id, end_time AS "EndTime", start_time IS NULL AS null_start FROM ended')
def derive_end_time(spark, d):
    return op.clean_log(fx.raw_log(spark, d)).select("event_id", "EndTime", F.col("StartTime").isNull().alias("null_start"))


@query(
    "validate_intervals",
    _CLEAN
    + """ SELECT count(*) AS total_rows, count(*) FILTER (WHERE start_time IS NULL) AS null_start,
    count(*) FILTER (WHERE end_time IS NULL) AS null_end, count(*) FILTER (WHERE seconds IS NULL) AS null_downtime,
    count(*) FILTER (WHERE end_time < start_time) AS reversed, min(start_time) AS first_start, max(end_time) AS last_end,
    round(avg(seconds), 6) AS mean_downtime, min(seconds) AS min_downtime, max(seconds) AS max_downtime FROM ended""",
)
def validate_intervals(spark, d):
    return rounded(op.validate_intervals(op.clean_log(fx.raw_log(spark, d))))


@query("require_columns", f"WITH {fx.READINGS} SELECT event_id, station, ts, value, k FROM readings")
def require_columns(spark, d):
    return op.require_columns(fx.readings(spark, d), ["station", "ts", "value"])


@query("to_utc", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def to_utc(spark, d):
    text = fx.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return op.to_utc(text)


@query("drop_columns", f"WITH {fx.READINGS} SELECT ts, value, k, 'Missing' AS missing FROM readings")
def drop_columns(spark, d):
    kept, missing = op.drop_columns(fx.readings(spark, d), ["event_id", "station", "Missing"])
    return kept.withColumn("missing", F.lit(",".join(missing)))


@query("drop_low_variance_columns", f"WITH {fx.FEATURE_ROWS} SELECT l_quantity, l_extendedprice, label FROM feature_rows")
def drop_low_variance_columns(spark, d):
    return op.drop_low_variance_columns(fx.features(spark, d).select(*fx.FEATURES, "label"))


@query("drop_constant_columns", f"WITH {fx.READINGS} SELECT event_id, value FROM readings")
def drop_constant_columns(spark, d):
    rows = fx.readings(spark, d).select(
        "event_id", "value", F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("empty")
    )
    return op.drop_constant_columns(rows)


@query(
    "drop_exact_duplicates",
    "SELECT DISTINCT l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
)
def drop_exact_duplicates(spark, d):
    return op.drop_exact_duplicates(
        fx.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    )


@query(
    "duplicate_counts",
    """SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber, l_quantity, l_returnflag)""",
)
def duplicate_counts(spark, d):
    return op.duplicate_counts(
        fx.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    )


def _spoiled(spark, d):
    """Readings with infinities, NaN and nulls on known rows."""
    eid = F.col("event_id")
    bad = (
        F.when(eid % 11 == 0, float("inf")).when(eid % 13 == 0, float("-inf")).when(eid % 17 == 0, float("nan"))
        .when(eid % 7 != 0, F.col("value"))
    )
    return fx.readings(spark, d).select("event_id", "k", bad.alias("value"))


_SPOILED = f"""WITH {fx.READINGS}, spoiled AS (SELECT event_id, k, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE
  WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE
  WHEN event_id % 7 <> 0 THEN value END AS value FROM readings)"""


@query("drop_non_finite_rows", _SPOILED + " SELECT * FROM spoiled WHERE value IS NOT NULL AND isfinite(value)")
def drop_non_finite_rows(spark, d):
    return op.drop_non_finite_rows(_spoiled(spark, d), ["value", "k"])


@query(
    "non_finite_to_zero",
    _SPOILED + " SELECT event_id, k, CASE WHEN isfinite(value) THEN value ELSE 0.0 END AS value FROM spoiled",
)
def non_finite_to_zero(spark, d):
    return op.non_finite_to_zero(_spoiled(spark, d), ["value"])


_GAPPY = f"""WITH {fx.READINGS}, gappy AS (SELECT event_id, station, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS value,
  CASE WHEN event_id % 7 <> 0 THEN k END AS k FROM readings)"""


def _gappy(spark, d):
    return fx.readings(spark, d).withColumns(
        {"value": F.expr("if(event_id % 5 <> 0, value, null)"), "k": F.expr("if(event_id % 7 <> 0, k, null)")}
    )


@query(
    "fill_with_mean",
    _GAPPY
    + """ SELECT event_id, station, ts, round(coalesce(value, (SELECT avg(value) FROM gappy)), 6) AS value,
    round(coalesce(k, (SELECT avg(k) FROM gappy)), 6) AS k FROM gappy""",
)
def fill_with_mean(spark, d):
    return rounded(op.fill_with_mean(_gappy(spark, d), ["value", "k"]))


@query(
    "regularise_ffill",
    f"""WITH {fx.READINGS}, bounds AS (SELECT station, min(ts) AS a, max(ts) AS b FROM readings GROUP BY station),
    grid AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM bounds)
    SELECT g.station, CAST(row_number() OVER (PARTITION BY g.station ORDER BY g.ts) - 1 AS BIGINT) AS slot, g.ts, r.value, r.k
    FROM grid g ASOF JOIN readings r ON g.station = r.station AND g.ts >= r.ts""",
)
def regularise_ffill(spark, d):
    return op.regularise_ffill(fx.readings(spark, d), fx.CHANNELS, 3600)


@query(
    "interpolate_linear",
    _GAPPY
    + """, placed AS (SELECT event_id, station, CAST(ts AS DATE) AS day, value, row_number() OVER w AS pos,
      count(*) OVER p AS n, count(value) OVER p AS known FROM gappy
      WINDOW p AS (PARTITION BY station, CAST(ts AS DATE)), w AS (PARTITION BY station, CAST(ts AS DATE) ORDER BY ts)),
    marked AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
      first_value(value IGNORE NULLS) OVER a AS v1,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1
      FROM placed WHERE n >= 5 AND known > 0
      WINDOW b AS (PARTITION BY station, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY station, day ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, station, round(coalesce(value, CASE WHEN p1 > p0 THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END,
      v1, v0), 6) AS value FROM marked""",
)
def interpolate_linear(spark, d):
    rows = _gappy(spark, d).withColumn("day", F.to_date("ts"))
    out = op.interpolate_linear(rows, ["station", "day"], ["ts"], "value", min_rows=5)
    return rounded(out.select("event_id", "station", "value"))


@query(
    "filter_station",
    f"WITH {fx.INTERVALS} SELECT * FROM intervals WHERE station = 'S1' ORDER BY start_ts LIMIT 1000",
)
def filter_station(spark, d):
    return op.filter_station(fx.downtimes(spark, d), "S1", ["start_ts"], 1000)


@query("select_numeric_features", f"WITH {fx.FEATURE_ROWS} SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM feature_rows")
def select_numeric_features(spark, d):
    return op.select_numeric_features(fx.features(spark, d), ("ts", "label", *fx.ROW_KEY))


@query("select_features", f"WITH {fx.FEATURE_ROWS} SELECT ts, label, l_tax, l_quantity FROM feature_rows")
def select_features(spark, d):
    return op.select_features(fx.features(spark, d), ["ts", "label"], ["l_tax", "not_there", "l_quantity"])


@query("exclude_columns", f"WITH {fx.FEATURE_ROWS} SELECT l_quantity, l_extendedprice, l_discount FROM feature_rows")
def exclude_columns(spark, d):
    return op.exclude_columns(fx.features(spark, d), ["ts", "l_tax", *fx.ROW_KEY], label="label")


@query(
    "map_station",
    f"""WITH {fx.INTERVALS} SELECT event_id, station, CASE station WHEN 'S0' THEN 'Contacting' WHEN 'S1' THEN 'PCB'
    ELSE 'unknown_station' END AS energy_station FROM intervals""",
)
def map_station(spark, d):
    rows = fx.downtimes(spark, d).select("event_id", "station")
    return op.map_station(rows, names={"s0": "Contacting", "s1": "PCB"})


@query(
    "time_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(month(ts) AS INTEGER) AS month, CAST(weekofyear(ts) AS INTEGER) AS week,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day,
    CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week FROM events""",
)
def time_features(spark, d):
    return op.time_features(fx.events(spark, d).select("event_id", "ts")).drop("ts")


_TRAIN = f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx,
  count(*) OVER () AS n FROM feature_rows), train AS (SELECT * FROM placed WHERE idx < floor(n * 0.7))"""
_SCALER = "(SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)"


@query(
    "standardise",
    _TRAIN
    + " SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - {_SCALER.format(c=c)}, 6) AS {c}" for c in fx.FEATURES)
    + " FROM feature_rows",
)
def standardise(spark, d):
    rows = sampling.sequential_split(fx.features(spark, d), fx.SORT)
    out = op.standardise(rows, fx.FEATURES, rows.where("split = 'train'"))
    return rounded(out.select("l_orderkey", "l_linenumber", *fx.FEATURES))


@query(
    "save_load_scaler",
    f"WITH {fx.FEATURE_ROWS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS scale FROM feature_rows"
        for c in fx.FEATURES
    ),
)
def save_load_scaler(spark, d):
    path = op.save_scaler(op.fit_scaler(fx.features(spark, d), fx.FEATURES))
    return rounded(op.load_scaler(spark, path), 5)


@query(
    "missing_report",
    _GAPPY
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS nulls, '{t}' AS dtype FROM gappy"
        for c, t in (("event_id", "bigint"), ("station", "string"), ("ts", "timestamp"), ("value", "double"), ("k", "double"))
    ),
)
def missing_report(spark, d):
    return op.missing_report(_gappy(spark, d))
