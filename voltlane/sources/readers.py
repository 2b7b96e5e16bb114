"""Scans: CSV and parquet files of readings, logs, feature lists and importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltlane.functions.columns import column_intersection
from voltlane.operators.cleaning import missing_report, require_columns
from voltlane.plans.joins import interval_join, unused
from voltlane.plans.ordering import settled
from voltlane.session import materialise
from voltlane.sources.catalogue import footers, list_files, scan_paths

# fixed values: month names in the file names of the energy data
MONTH_NAMES = [
    "Januar", "Februar", "März", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
]

#: events of one month file that meet all its readings
FEW_EVENTS = 8


def scan_csv_monthly(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Union of all CSV files below a station folder, with an explicit schema."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return reader.csv(folder, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")


def scan_csv_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """Downtime log: ``;`` separated text, header names trimmed, empty fields null."""
    raw = spark.read.csv(path, sep=";", header=True)
    return raw.toDF(*[c.strip() for c in raw.columns])


def csv_statistics(log: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Row and null counts per column, and a sample of five rows."""
    return missing_report(log), log.orderBy(*order).limit(5)


def scan_csv_limited(
    spark: SparkSession, path: str, order: list[str], n: int = 1000, schema: StructType | str | None = None
) -> DataFrame:
    """First ``n`` rows of a CSV in the given order (files of a distributed CSV have no order of their own)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True).orderBy(*order).limit(n)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def scan_parquet_footer_intersect(
    spark: SparkSession, path: str, metadata: list[str], ranked: list[str], top: int | None = None
) -> DataFrame:
    """Metadata columns plus the first ``top`` ranked columns, as far as the footer has them."""
    df = spark.read.parquet(path)
    wanted = [*metadata, *(ranked if top is None else ranked[:top])]
    return df.select(*column_intersection(df, list(dict.fromkeys(wanted)))[0])


def scan_parquet_tree(spark: SparkSession, root: str, column: str | None = None) -> DataFrame:
    """All parquet files below ``root`` with a merged schema.

    With ``column``, only files whose schema has it: footers are looked at, no rows, and the other files are not read.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
    df = reader.parquet(root)
    if column is None:
        return df
    having = footers(spark, root).where(F.array_contains("columns", column)).select("path")
    chosen = scan_paths(spark, root, having, merge=True)
    return df.where("false") if chosen is None else chosen


def scan_parquet_file_or_dir(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """One file or a folder of files, sorted by time."""
    return spark.read.parquet(path).orderBy(*order)


def _one_folder(spark: SparkSession, root: str, station: str, pick) -> DataFrame:
    """The rows of one folder of each station, chosen from the list of files; no other file is opened."""
    listed = list_files(spark, root).withColumn("_station", F.element_at("parts", station))
    chosen = listed.where("_station IS NOT NULL").groupBy("_station").agg(pick("folder").alias("folder")).select("folder")
    rows = scan_paths(spark, root, chosen)
    if rows is None:
        raise ValueError(f"no folders {station}=... below {root}")
    return rows


def scan_one_file_per_station(spark: SparkSession, root: str, station: str = "station") -> DataFrame:
    """Rows of the first month (or day) folder by name of every station, for profiling; ``station`` is a partition column."""
    return _one_folder(spark, root, station, F.min)


def latest_snapshot(spark: SparkSession, root: str, station: str = "station") -> DataFrame:
    """Rows of the newest folder by name of every station."""
    return _one_folder(spark, root, station, F.max)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


def month_partition_lookup(
    events: DataFrame, monthly: DataFrame, start: str = "start_ts", on: tuple[str, ...] = (), end: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Rows of the month file of each event's start; with ``end`` those between start and end only, as a preview shows them.

    ``monthly`` is partitioned by ``year, month`` (and ``on``, e.g. the station), so the months of the events prune the
    folders that are read. With ``end`` readings meet only the events of their station and month whose range covers them; a column
    of the events that the readings have too then becomes ``interval_<name>``. Null keys match nothing. Up to ``FEW_EVENTS`` events
    of a month meet its readings as they are, which are so many pairs a reading at most; where a month has more it takes a range join,
    whose rows an event are some thirty. The file name follows the month, e.g. ``Januar_2024``.
    """
    keys = [*on, "year", "month"]
    keyed = events.withColumns({"year": F.year(start), "month": F.month(start)})
    named = keyed.withColumn("file", F.concat_ws("_", month_name(F.col("month")), F.col("year")))
    if end is None:
        return named.join(monthly, keys)
    p = unused("_mp", [*named.columns, *monthly.columns])
    text = [F.col(c).cast("string").alias(f"{p}_of_{c}") for c in keys]
    known = lambda df: df.dropna("any", subset=keys)
    time = lambda c, name: F.col(c).cast("timestamp").alias(f"{p}_{name}")
    rest = [c for c in named.columns if c not in keys]
    columns = [*keys, *[f"interval_{c}" if c in monthly.columns else c for c in rest], *[c for c in monthly.columns if c not in keys]]
    sides = materialise(known(named).select(*text, time(start, "from"), time(end, "to"), *rest), "events")
    months = settled(sides.select(*[F.col(f"{p}_of_{c}").cast("int").alias(c) for c in ("year", "month")]).distinct())
    readings = known(monthly.join(months, ["year", "month"], "left_semi")).select("*", *text, time(ts, "at"))
    ids = [f"{p}_of_{c}" for c in keys]
    many = settled(sides.groupBy(*ids).count().where(F.col("count") > FEW_EVENTS).select(*ids))
    crowded = not many.isEmpty()
    few = (sides.join(many, ids, "left_anti") if crowded else sides).select(*ids, *[F.col(c).alias(f"{p}_e_{c}") for c in sides.columns if c not in ids])
    met = readings.join(few, ids).where(F.col(f"{p}_at").between(F.col(f"{p}_e_{p}_from"), F.col(f"{p}_e_{p}_to")))
    found = met.withColumnsRenamed({f"{p}_e_{c}": f"interval_{c}" if c in monthly.columns else c for c in rest}).select(*columns)
    if not crowded:
        return found
    key = F.to_json(F.struct(*ids)).alias(f"{p}_key")
    of_many = lambda df: df.join(many, ids, "left_semi").withColumn(f"{p}_key", key).drop(*ids)
    ranged = interval_join(of_many(readings), of_many(sides), station=f"{p}_key", ts=f"{p}_at", start=f"{p}_from", end=f"{p}_to")
    return found.unionByName(ranged.select(*columns))


def scan_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Feature names from report lines such as ``3. name: 0.2``."""
    name = F.regexp_extract("value", ".*?([a-zA-Z0-9_]+):", 1)
    return spark.read.text(path).select(name.alias("feature")).where("feature <> ''")


def scan_importance_csv(
    spark: SparkSession, path: str, n: int, rank: str = "rank", schema: str = "feature string, importance double, rank int"
) -> DataFrame:
    """First ``n`` features of a ranked CSV."""
    df = require_columns(spark.read.schema(schema).csv(path, header=True), ["feature", rank])
    return df.orderBy(rank, "feature").limit(n)
