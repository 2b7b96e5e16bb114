"""The resampling, labelling and de-duplication operators on streaming readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltlane.operators.intervals import label_points_by_interval
from voltlane.session import shared_path

STATION, TS = "station", "ts"


def stream_readings(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_downsample(
    readings: DataFrame, channels: list[str], every: str = "1 minute", delay: str = "10 minutes", station: str = STATION, ts: str = TS
) -> DataFrame:
    """Mean of every channel per slot; a slot is final once the watermark has passed its end, later rows are dropped."""
    slots = readings.withWatermark(ts, delay).groupBy(station, F.window(ts, every).alias("_w"))
    means = slots.agg(*[F.avg(c).alias(c) for c in channels])
    return means.select(station, F.col("_w.start").alias(ts), *channels)


def stream_label(readings: DataFrame, intervals: DataFrame, merged: bool = False) -> DataFrame:
    """Label each arriving reading by the stored intervals: a stream-static range join."""
    return label_points_by_interval(readings, intervals, merged=merged)


def stream_dedup(
    readings: DataFrame, delay: str = "10 minutes", station: str = STATION, ts: str = TS, key: tuple[str, ...] = ()
) -> DataFrame:
    """First reading per station and time among those that arrive within the watermark delay.

    ``key`` names what else tells readings apart, where a station may have several at the same time.
    """
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([station, ts, *key])


def run_available(stream: DataFrame, path: str, output_mode: str = "append") -> DataFrame:
    """Process what is there, write it as parquet under ``path``, and read it back."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode(output_mode).trigger(availableNow=True)
    running = writer.option("path", path).option("checkpointLocation", shared_path(spark, "stream-state")).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(path)


def scan_in_batches(
    spark: SparkSession, folder: str, schema: StructType, target: str, state: str, process: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1
) -> DataFrame:
    """Process the files of a folder, so many at a time and oldest first, append the results to ``target``, and read it.

    ``state`` keeps which files are consumed, and ``target`` which of its files are committed, a batch as a whole or not at all.
    A run that is stopped at any point goes on with the batch it was in, files that come later are the next batches, and each row
    is there once. ``process`` works on the rows of a stream, so it may use what does not depend on other batches.
    """
    rows = stream_readings(spark, folder, schema, files_per_batch)
    out = rows if process is None else process(rows)
    writer = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    running = writer.option("path", target).option("checkpointLocation", state).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(out.schema).parquet(target)


def label_as_they_come(
    readings: DataFrame, intervals: Callable[[], DataFrame], target: str, state: str, label: str = "anomaly_label"
) -> DataFrame:
    """Label arriving readings by the intervals known when their batch is processed, and read the results.

    ``intervals`` gives the table as it is now; it is called for every batch. A batch has a folder of its own that a
    repetition replaces, so a run that is stopped can be taken up. A reading keeps the label of its batch.
    """
    spark, schema = readings.sparkSession, f"{label} int"

    def run(batch: DataFrame, number: int) -> None:
        label_points_by_interval(batch, intervals(), label).write.mode("overwrite").parquet(f"{target}/batch={number}")

    running = readings.writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", state).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(StructType([*readings.schema.fields, *StructType.fromDDL(schema).fields])).parquet(target).drop("batch")
