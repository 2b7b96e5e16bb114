"""Queries of the scans and sinks. Files are derived from the tables and written to the shared folder."""

from pyspark.sql import functions as F

from voltlane.operators import intervals as iv
from voltlane.plans.ordering import ordered_index
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query
from voltlane.session import shared_path
from voltlane.sources import catalogue as ca
from voltlane.sources import readers as rd
from voltlane.sources import writers as wr
from voltlane.streaming import operators as st


@query("scan_csv_monthly", f"WITH {fx.READINGS} SELECT * FROM readings")
def scan_csv_monthly(spark, d):
    folder = shared_path(spark, "monthly")
    rows = fx.readings(spark, d)
    monthly = rows.withColumn("_month", F.date_format("ts", "yyyy-MM"))
    monthly.write.partitionBy("_month").csv(folder, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rd.scan_csv_monthly(spark, folder, rows.schema)


def _semicolon(spark, d):
    log = fx.raw_log(spark, d)
    path = wr.sink_csv(log.toDF(*[f" {c} " for c in log.columns]), shared_path(spark, "log"), sep=";")
    return rd.scan_csv_semicolon(spark, path)


@query(
    "scan_csv_semicolon",
    f"""WITH {fx.RAW_LOG} SELECT event_id::VARCHAR AS event_id, "Downtime", "Line", "Shift", trim("Station") AS "Station",
    trim("Condition") AS "Condition" FROM raw_log""",
)
def scan_csv_semicolon(spark, d):
    log = _semicolon(spark, d)
    return log.select("event_id", "Downtime", "Line", "Shift", F.trim("Station").alias("Station"), F.trim("Condition").alias("Condition"))


@query(
    "csv_statistics",
    f"WITH {fx.RAW_LOG} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count(\"{c}\") AS nulls, 'string' AS dtype FROM raw_log"
        for c in ("event_id", "Date", "Downtime", "Condition", "Station", "Line", "Shift", "Comment")
    ),
)
def csv_statistics(spark, d):
    return rd.csv_statistics(_semicolon(spark, d), ["event_id"])[0]


@query("scan_csv_limited", f"WITH {fx.READINGS} SELECT * FROM readings ORDER BY event_id LIMIT 1000")
def scan_csv_limited(spark, d):
    rows = fx.readings(spark, d)
    return rd.scan_csv_limited(spark, wr.sink_csv(rows, shared_path(spark, "csv")), ["event_id"], 1000, rows.schema)


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, d):
    return rd.scan_parquet(spark, f"{d}/orders.parquet")


@query("scan_parquet_columns", "SELECT l_shipdate, l_quantity FROM lineitem")
def scan_parquet_columns(spark, d):
    return rd.scan_parquet_columns(spark, f"{d}/lineitem.parquet", ["l_shipdate", "l_quantity"])


@query("scan_parquet_footer_intersect", "SELECT l_shipdate, l_returnflag, l_tax, l_discount FROM lineitem")
def scan_parquet_footer_intersect(spark, d):
    ranked = ["l_tax", "not_there", "l_discount", "l_quantity"]
    return rd.scan_parquet_footer_intersect(spark, f"{d}/lineitem.parquet", ["l_shipdate", "l_returnflag"], ranked, 3)


@query("scan_parquet_tree", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de')")
def scan_parquet_tree(spark, d):
    root = shared_path(spark, "tree")
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    docs.where("lang = 'en'").write.parquet(f"{root}/one")
    docs.where("lang = 'de'").write.parquet(f"{root}/two/three")
    docs.where("lang not in ('en', 'de')").drop("source").write.parquet(f"{root}/two/four")
    return rd.scan_parquet_tree(spark, root, "source")


@query("scan_parquet_file_or_dir", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def scan_parquet_file_or_dir(spark, d):
    path = wr.sink_parquet(fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), shared_path(spark, "orders"))
    return rd.scan_parquet_file_or_dir(spark, path, ["o_orderdate", "o_orderkey"])


@query("scan_in_batches", f"WITH {fx.LABELLED} SELECT event_id, station, ts, value, k, anomaly_label FROM labelled")
def scan_in_batches(spark, d):
    """Scan, label and append two files at a time; a second run takes up the files that came after the first."""
    folder, target, state = (shared_path(spark, n) for n in ("arrivals", "labelled", "state"))
    rows, known = fx.readings(spark, d), fx.intervals(spark, d)
    label = lambda part: iv.label_points_by_interval(part, known)
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).repartition(3).write.mode("append").parquet(folder)
        out = st.scan_in_batches(spark, folder, rows.schema, target, state, label, 2)
    return out


@query("label_as_they_come", f"WITH {fx.LABELLED} SELECT event_id, station, ts, value, k, anomaly_label FROM labelled")
def label_as_they_come(spark, d):
    """The intervals are there before the readings, so labels are those of the whole table."""
    folder, target, state = (shared_path(spark, n) for n in ("arrivals", "labelled", "state"))
    rows = fx.readings(spark, d)
    rows.repartition(2).write.parquet(folder)
    return st.label_as_they_come(st.stream_readings(spark, folder, rows.schema, 1), lambda: fx.intervals(spark, d), target, state)


def _daily(spark, d):
    rows = fx.readings(spark, d).withColumn("day", F.to_date("ts"))
    return wr.sink_parquet(rows, shared_path(spark, "daily"), ("station", "day"))


@query(
    "scan_one_file_per_station",
    f"""WITH {fx.READINGS} SELECT event_id, station, value FROM readings r WHERE CAST(ts AS DATE) =
    (SELECT min(CAST(ts AS DATE)) FROM readings q WHERE q.station = r.station)""",
)
def scan_one_file_per_station(spark, d):
    return rd.scan_one_file_per_station(spark, _daily(spark, d)).select("event_id", "station", "value")


@query(
    "latest_snapshot",
    f"""WITH {fx.READINGS} SELECT event_id, station, value FROM readings r WHERE CAST(ts AS DATE) =
    (SELECT max(CAST(ts AS DATE)) FROM readings q WHERE q.station = r.station)""",
)
def latest_snapshot(spark, d):
    return rd.latest_snapshot(spark, _daily(spark, d)).select("event_id", "station", "value")


@query("scan_between", f"WITH {fx.READINGS} SELECT event_id, station, ts, value FROM readings WHERE ts BETWEEN '2024-01-05' AND '2024-01-06 12:00:00'")
def scan_between(spark, d):
    """A stretch of time from files in time order, found by the bounds in their footers."""
    folder = shared_path(spark, "ordered")
    # written as 64-bit times, whose bounds are in the footers
    rows = fx.readings(spark, d).select("event_id", "station", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    rows.repartitionByRange(16, "ts").write.parquet(folder)
    return ca.scan_between(spark, folder, "ts", "2024-01-05", "2024-01-06 12:00:00")


_MONTHS = ", ".join(f"'{m}'" for m in rd.MONTH_NAMES)


@query(
    "month_partition_lookup",
    f"""WITH events_in AS (SELECT l_suppkey AS station, min(l_shipdate) AS start_ts FROM lineitem
      GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate))
    SELECT e.station, e.start_ts, CAST(year(start_ts) AS INTEGER) AS year, CAST(month(start_ts) AS INTEGER) AS month,
      [{_MONTHS}][month(start_ts)] || '_' || year(start_ts) AS file, o_orderkey
    FROM events_in e JOIN orders o ON o_custkey = e.station AND year(o_orderdate) = year(e.start_ts) AND month(o_orderdate) = month(e.start_ts)
      AND o_orderdate BETWEEN e.start_ts AND e.start_ts + INTERVAL 20 DAY""",
)
def month_partition_lookup(spark, d):
    """Preview of events: the readings of the event's station and range from the month file of its start."""
    orders = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("station"), "o_orderkey", F.col("o_orderdate").alias("ts"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    )
    monthly = rd.scan_parquet(spark, wr.sink_parquet(orders, shared_path(spark, "months"), ("year", "month")))
    rows = fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate"), F.month("l_shipdate"))
    starts = rows.agg(F.min("l_shipdate").alias("start_ts")).select("station", "start_ts", (F.col("start_ts") + F.expr("INTERVAL 20 DAYS")).alias("end_ts"))
    found = rd.month_partition_lookup(starts, monthly, on=("station",), end="end_ts")
    return found.select("station", "start_ts", "year", "month", "file", "o_orderkey")


_REPORT = """WITH report AS (SELECT 'part_' || l_partkey AS feature, count(*) AS n FROM lineitem GROUP BY l_partkey)"""


def _report(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat(F.lit("part_"), "l_partkey").alias("feature"), "n")


@query("scan_feature_list", _REPORT + " SELECT feature FROM report")
def scan_feature_list(spark, d):
    path = shared_path(spark, "features")
    lines = _report(spark, d).select(F.explode(F.array(F.format_string(" - %s: %d (x: y)", "feature", "n"), F.lit("no name"))))
    lines.write.text(path)
    return rd.scan_feature_list(spark, path)


@query(
    "scan_importance_csv",
    _REPORT + """, ranked AS (SELECT feature, CAST(n AS DOUBLE) AS importance, CAST(row_number() OVER (ORDER BY n DESC, feature) AS INTEGER) AS rank
    FROM report) SELECT * FROM ranked ORDER BY rank, feature LIMIT 25""",
)
def scan_importance_csv(spark, d):
    placed = ordered_index(_report(spark, d), [], [F.col("n").desc(), "feature"])
    table = placed.select("feature", F.col("n").cast("double").alias("importance"), (F.col("idx") + 1).cast("int").alias("rank"))
    return rd.scan_importance_csv(spark, wr.sink_csv(table, shared_path(spark, "importance")), 25)


@query("sink_parquet", f"WITH {fx.READINGS} SELECT * FROM readings")
def sink_parquet(spark, d):
    path = wr.sink_parquet(fx.readings(spark, d), shared_path(spark, "readings"), stamped=True)
    return rd.scan_parquet(spark, path)


@query("sink_parquet_verified", f"WITH {fx.INTERVALS} SELECT * FROM intervals")
def sink_parquet_verified(spark, d):
    return wr.sink_parquet_verified(fx.downtimes(spark, d), shared_path(spark, "verified"))


@query("sink_csv", f"WITH {fx.INTERVALS} SELECT * FROM intervals")
def sink_csv(spark, d):
    rows = fx.downtimes(spark, d)
    return spark.read.schema(rows.schema).csv(
        wr.sink_csv(rows, shared_path(spark, "csv")), header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )


@query("sink_interval_table", f"WITH {fx.MERGED} SELECT station, start_ts, end_ts FROM merged")
def sink_interval_table(spark, d):
    return wr.sink_interval_table(iv.merge_intervals(fx.intervals(spark, d)), shared_path(spark, "intervals"))


@query("unknown_stations", "SELECT 'S' || g AS station FROM (SELECT DISTINCT user_id % 5 AS g FROM events) WHERE g > 2")
def unknown_stations(spark, d):
    stored = wr.sink_interval_table(fx.intervals(spark, d), shared_path(spark, "intervals"))
    wanted = fx.table(spark, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 5).alias("station"))
    return wr.unknown_stations(wanted, stored)


@query(
    "sink_json_report",
    f"""WITH {fx.INTERVALS} SELECT to_json({{'station': station, 'first_start': strftime(min(start_ts), '%Y-%m-%d %H:%M:%S'),
    'n': count(*)}})::VARCHAR AS report FROM intervals GROUP BY station""",
)
def sink_json_report(spark, d):
    rows = fx.intervals(spark, d).groupBy("station").agg(F.min("start_ts").alias("first_start"), F.count(F.lit(1)).alias("n"))
    return wr.sink_json_report(rows, shared_path(spark, "report"))
