"""Queries of the sorts, limits, splits, samples and set operations."""

from pyspark.sql import functions as F

from voltlane.operators import cleaning
from voltlane.operators import intervals as iv
from voltlane.operators import sampling as op
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

KEY = [*fx.ROW_KEY]
_HASH = "md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))"
_PLACED = f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY {_HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS size FROM feature_rows),
  totals AS (SELECT count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM feature_rows)"""
_OUT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, label"


def _rows(spark, d):
    return fx.features(spark, d).select(*KEY, "ts", "l_extendedprice", "label")


@query("sort_by_time", f"WITH {fx.READINGS} SELECT event_id, station, ts, value FROM readings ORDER BY ts, event_id")
def sort_by_time(spark, d):
    return op.sort_by_time(fx.readings(spark, d).drop("k"), ["ts", "event_id"])


@query(
    "first_last_rows",
    f"""WITH {fx.READINGS} (SELECT event_id, ts, value, 'first' AS side FROM readings ORDER BY ts LIMIT 5) UNION ALL
    (SELECT event_id, ts, value, 'last' AS side FROM readings ORDER BY ts DESC LIMIT 5)""",
)
def first_last_rows(spark, d):
    return op.first_last_rows(fx.readings(spark, d).select("event_id", "ts", "value"), ["ts"], 5)


@query("first_n_rows", f"WITH {fx.READINGS} SELECT event_id, ts, value FROM readings ORDER BY ts LIMIT 500")
def first_n_rows(spark, d):
    return op.first_n_rows(fx.readings(spark, d).select("event_id", "ts", "value"), ["ts"], 500)


@query(
    "top_features",
    """SELECT 'p' || l_partkey AS feature, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY l_partkey
    ORDER BY score DESC, feature LIMIT 20""",
)
def top_features(spark, d):
    scores = fx.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return op.top_features(scores.select(F.concat(F.lit("p"), "l_partkey").alias("feature"), "score"), 20)


@query(
    "sequential_split",
    f"""WITH {fx.FEATURE_ROWS}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx,
      count(*) OVER () AS n FROM feature_rows)
    SELECT {_OUT}, CAST(idx AS BIGINT) AS idx, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN idx < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def sequential_split(spark, d):
    return op.sequential_split(_rows(spark, d), fx.SORT).select(*KEY, "label", "idx", "split")


@query(
    "stratified_split",
    _PLACED
    + f""" SELECT {_OUT}, CASE WHEN pos < floor(size * 0.7::DOUBLE) THEN 'train'
    WHEN pos < floor(size * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def stratified_split(spark, d):
    return op.stratified_split(_rows(spark, d), KEY).select(*KEY, "label", "split")


@query(
    "balance_training",
    _PLACED + f" SELECT {_OUT} FROM placed, totals WHERE label = 1 OR pos < floor(a * (1 - 0.4::DOUBLE) / 0.4::DOUBLE)",
)
def balance_training(spark, d):
    return op.balance_training(_rows(spark, d), KEY, 0.4).select(*KEY, "label")


@query("balanced_sample", _PLACED + f" SELECT {_OUT} FROM placed WHERE pos < CASE label WHEN 1 THEN 900 ELSE 2100 END")
def balanced_sample(spark, d):
    return op.balanced_sample(_rows(spark, d), KEY, 3000, 0.3).select(*KEY, "label")


@query("minority_equal_sample", _PLACED + f" SELECT {_OUT} FROM placed, totals WHERE pos < least(a, b)")
def minority_equal_sample(spark, d):
    return op.minority_equal_sample(_rows(spark, d), KEY).select(*KEY, "label")


@query(
    "random_sample",
    f"""WITH {fx.FEATURE_ROWS} SELECT {_OUT} FROM feature_rows
    ORDER BY {_HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""",
)
def random_sample(spark, d):
    return op.random_sample(_rows(spark, d), KEY, 1000).select(*KEY, "label")


@query(
    "balanced_oversample",
    """WITH placed AS (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic
      ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY toxic) AS size FROM labels)
    SELECT doc_id, label, CAST(unnest(generate_series(0, CASE label WHEN 1 THEN CAST(floor((100 - 1 - pos) / size::DOUBLE) AS BIGINT)
      ELSE 0 END)) AS BIGINT) AS copy FROM placed WHERE pos < 100""",
)
def balanced_oversample(spark, d):
    rows = fx.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return op.balanced_oversample(rows, ["doc_id"], 200)


@query(
    "union_all",
    f"""WITH {fx.READINGS}, {fx.INTERVALS} SELECT event_id, station, ts, value FROM readings
    UNION ALL SELECT event_id, station, start_ts, NULL FROM intervals""",
)
def union_all(spark, d):
    starts = fx.downtimes(spark, d).select("event_id", "station", F.col("start_ts").alias("ts"))
    return op.union_all(fx.readings(spark, d).drop("k"), starts)


@query(
    "difference_timestamps",
    f"WITH {fx.LABELLED} SELECT DISTINCT station, ts FROM labelled WHERE anomaly_label = 0",
)
def difference_timestamps(spark, d):
    points = fx.readings(spark, d)
    inside = iv.readings_in_interval(points, fx.intervals(spark, d))
    return op.difference_timestamps(points, inside, ["station", "ts"])


@query("union_index", "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_index(spark, d):
    rows = fx.table(spark, d, "labels")
    return op.union_index(rows.where("quality = 1"), rows.where("toxic = 1"), ["doc_id"])


@query(
    "column_intersection",
    """SELECT c AS "column", c IN (SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem)) AS present
    FROM (VALUES ('l_tax'), ('ID'), ('l_shipdate'), ('Station')) t(c)""",
)
def column_intersection(spark, d):
    return op.column_report(fx.table(spark, d, "lineitem"), ["l_tax", "ID", "l_shipdate", "Station"])
