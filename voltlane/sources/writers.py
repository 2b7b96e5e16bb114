"""Sinks: parquet, CSV, interval tables and JSON reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sink_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), stamped: bool = False) -> str:
    """Snappy parquet; ``stamped`` adds the time to the name. Returns the path.

    Partitioned output is rebalanced first: each task holds few partitions, and a hot one is split over several tasks.
    """
    if stamped:
        path = f"{path}_{datetime.now():%Y%m%d_%H%M%S}"
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)
    return path


def sink_parquet_verified(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write, read back, and raise when the row counts differ. The rows are counted while they are written."""
    written = Observation()
    sink_parquet(df.observe(written, F.count(F.lit(1)).alias("rows")), path, partition_by)
    back = df.sparkSession.read.parquet(path)
    found = back.count()
    if found != written.get["rows"]:
        raise RuntimeError(f"wrote {written.get['rows']} rows but read {found} from {path}")
    return back


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return path


def sink_interval_table(intervals: DataFrame, path: str) -> DataFrame:
    """Intervals partitioned by station, read back."""
    sink_parquet(intervals, path, ("station",))
    return intervals.sparkSession.read.parquet(path)


def unknown_stations(wanted: DataFrame, intervals: DataFrame) -> DataFrame:
    """Stations that the interval table does not know."""
    return wanted.select("station").distinct().join(intervals.select("station").distinct(), "station", "left_anti")


def as_text(df: DataFrame) -> DataFrame:
    """Timestamps as text, as JSON reports hold them."""
    changed = {
        f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(changed) if changed else df


def sink_json_report(df: DataFrame, path: str) -> DataFrame:
    """One JSON object per row, timestamps as text; read back as ``report``."""
    text = as_text(df)
    text.select(F.to_json(F.struct(*text.columns)).alias("value")).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).withColumnRenamed("value", "report")
