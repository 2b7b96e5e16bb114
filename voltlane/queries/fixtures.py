"""The driver's tables in the shape of telemetry, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ["value", "k"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DATE_FORMAT, TIME_FORMAT = "dd.MM.yyyy, HH:mm:ss", "HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("S"), F.col("user_id") % 3).alias("station"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
        "user_id",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type <> 'error'").drop("event_type", "user_id")


def downtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.round(F.col("value") * 6_000_000).cast("long")
    return (
        events(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            "event_id",
            "station",
            F.col("ts").alias("start_ts"),
            F.timestamp_micros(F.unix_micros("ts") + micros).alias("end_ts"),
        )
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downtimes(spark, sf_dir).drop("event_id")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downtime log as text, with bad values on known rows."""
    ev = table(spark, sf_dir, "events").where("event_type = 'error'")
    eid = F.col("event_id")
    seconds = F.round(F.col("value") * 6).cast("long")
    clock = F.date_format(F.timestamp_seconds(seconds).cast("timestamp_ntz"), TIME_FORMAT)
    return ev.select(
        "event_id",
        F.when(eid % 97 == 0, F.lit("31.02.2024 late"))
        .otherwise(F.concat(F.lit(" "), F.date_format("ts", DATE_FORMAT), F.lit(" ")))
        .alias("Date"),
        F.when(eid % 89 == 0, F.lit("12:30")).when(eid % 83 == 0, F.lit("aa:bb:cc")).otherwise(clock).alias("Downtime"),
        F.when(eid % 2 == 0, F.lit("  o'neil a-b ")).otherwise(F.lit("MOTOR fault2x")).alias("Condition"),
        F.when(eid % 79 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" s"), F.col("user_id") % 3, F.lit("-line ")))
        .alias("Station"),
        F.concat(F.lit("line "), F.col("user_id") % 5).alias("Line"),
        F.when(eid % 3 == 0, F.lit("früh")).otherwise(F.lit("NACHT schicht")).alias("Shift"),
        F.concat(F.lit(" "), F.col("props"), F.lit("  ")).alias("Comment"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *ROW_KEY, F.col("l_shipdate").cast("timestamp").alias("ts"), *FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with many tied scores."""
    return features(spark, sf_dir).select(
        *ROW_KEY, "ts", "label", (F.col("l_discount") * 10).alias("score"),
        (F.col("l_discount") * 10 >= 0.5).cast("int").alias("predicted"), "l_extendedprice",
    )


SORT = ["ts", *ROW_KEY, "l_extendedprice"]

READINGS = """readings AS (
  SELECT event_id, 'S' || (user_id % 3)::VARCHAR AS station, ts, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events WHERE event_type <> 'error')"""

INTERVALS = """intervals AS (
  SELECT event_id, 'S' || (user_id % 3)::VARCHAR AS station, ts AS start_ts,
         ts + to_microseconds(CAST(round(value * 6000000) AS BIGINT)) AS end_ts
  FROM events WHERE event_type = 'error')"""

MERGED = (
    INTERVALS
    + """, flagged AS (
  SELECT station, start_ts, end_ts, CASE WHEN start_ts <= max(end_ts) OVER (
      PARTITION BY station ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS fresh FROM intervals),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island
  FROM flagged),
merged AS (SELECT station, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM islands GROUP BY station, island)"""
)

LABELLED = (
    f"{READINGS}, {MERGED}"
    + """, labelled AS (
  SELECT r.*, CAST(EXISTS (SELECT 1 FROM intervals i WHERE i.station = r.station
      AND r.ts BETWEEN i.start_ts AND i.end_ts) AS INTEGER) AS anomaly_label
  FROM readings r)"""
)

FEATURE_ROWS = """feature_rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts, l_quantity, l_extendedprice, l_discount,
         l_tax, CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem)"""

SCORED = (
    FEATURE_ROWS
    + """, scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts, label, l_discount * 10 AS score,
         CAST(l_discount * 10 >= 0.5 AS INTEGER) AS predicted, l_extendedprice
  FROM feature_rows)"""
)

SORT_SQL = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

RAW_LOG = r"""raw_log AS (
  SELECT event_id,
    CASE WHEN event_id % 97 = 0 THEN '31.02.2024 late' ELSE ' ' || strftime(ts, '%d.%m.%Y, %H:%M:%S') || ' ' END AS "Date",
    CASE WHEN event_id % 89 = 0 THEN '12:30' WHEN event_id % 83 = 0 THEN 'aa:bb:cc'
      ELSE strftime(make_timestamp(CAST(round(value * 6) AS BIGINT) * 1000000), '%H:%M:%S') END AS "Downtime",
    CASE WHEN event_id % 2 = 0 THEN '  o''neil a-b ' ELSE 'MOTOR fault2x' END AS "Condition",
    CASE WHEN event_id % 79 = 0 THEN NULL ELSE ' s' || (user_id % 3) || '-line ' END AS "Station",
    'line ' || (user_id % 5) AS "Line",
    CASE WHEN event_id % 3 = 0 THEN 'früh' ELSE 'NACHT schicht' END AS "Shift",
    ' ' || props || '  ' AS "Comment"
  FROM events WHERE event_type = 'error')"""
