"""Session settings, the shared folder for written intermediates, and Spark jobs side by side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "voltlane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, path: str | None = None) -> bool:
    """Delete one written intermediate, or all of this application; frames that read them end with it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or _own_folder(spark))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the written intermediate that a frame reads; the frame ends with it."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        release(df.sparkSession, path)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Parquet rather than an RDD checkpoint, so that later readers still prune columns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, run: Callable, items: Iterable, threads: int) -> list:
    """``run`` of every item, as Spark jobs of several threads; results in the order of the items.

    Each call gets its own copy of the local properties: threads that share one set and clear the id of a running query for each other.
    """
    calls = [inheritable_thread_target(spark)(partial(run, item)) for item in items]
    with ThreadPool(max(1, min(threads, len(calls)))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)
