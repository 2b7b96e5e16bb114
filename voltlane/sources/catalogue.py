"""A catalogue of parquet files: where they are, what their folders say, and what their footers say.

Files are listed by Spark's own index, footers are read by tasks over that list, and scans are given the chosen paths: choosing
reads no rows, and the plan of the scan that follows has the chosen files only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: stores that tasks open themselves to read the end of a file; elsewhere Spark reads the files for them
DIRECT = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
FILES_PER_TASK = 256
FOOTER = "path string, columns array<string>, n_rows long, low timestamp, high timestamp"


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``path, folder, length, parts`` of the parquet files below ``root``; ``parts`` maps ``name=value`` folders, null for Hive's default."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    value = "nullif(try_url_decode(replace(substr(p, instr(p, '=') + 1), '+', '%2B')), '__HIVE_DEFAULT_PARTITION__')"
    pairs = f"transform(regexp_extract_all(path, '([^/=]+=[^/]*)(?=/)', 1), p -> struct(substr(p, 1, instr(p, '=') - 1), {value}))"
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return files.select("path", folder, "length", F.expr(f"map_from_entries({pairs})").alias("parts"), *(["content"] if content else []))


def _footer(path: str, content: bytes | None, ts: str | None) -> tuple:
    import pyarrow.parquet as pq
    from pyarrow import fs

    if content is not None:
        source = pa.BufferReader(content)
    else:
        scheme, rest = path.split(":", 1)
        store, name = (fs.LocalFileSystem(), rest) if scheme == "file" else fs.FileSystem.from_uri(f"{DIRECT[scheme]}:{rest}")
        source = store.open_input_file("/" + name.lstrip("/") if scheme == "file" else name)
    with source:
        found = pq.ParquetFile(source).metadata
        names = found.schema.to_arrow_schema().names
        bounds = []
        if ts in names:
            at = [found.schema.column(i).path for i in range(found.num_columns)].index(ts)
            bounds = [found.row_group(i).column(at).statistics for i in range(found.num_row_groups)]
        # the old 96-bit times have no bounds that hold
        known = bool(bounds) and all(s is not None and s.physical_type != "INT96" and s.has_min_max for s in bounds)
        return path, names, found.num_rows, min(s.min for s in bounds) if known else None, max(s.max for s in bounds) if known else None


def footers(spark: SparkSession, root: str, ts: str | None = None) -> DataFrame:
    """``path, columns, n_rows, low, high`` from the footer of every file; the last two bound the times in ``ts`` where the footer knows.

    Bounds without a zone count as UTC.
    """
    listed = list_files(spark, root)
    first = listed.select("path").take(1)
    direct = bool(first) and first[0].path.split(":", 1)[0] in DIRECT
    files = listed.select("path") if direct else list_files(spark, root, content=True).select("path", "content")
    if direct:
        files = files.repartition(max(1, -(-listed.count() // FILES_PER_TASK)))
    arrow = pa.schema([("path", pa.string()), ("columns", pa.list_(pa.string())), ("n_rows", pa.int64()), ("low", pa.timestamp("us", "UTC")), ("high", pa.timestamp("us", "UTC"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
            rows = [_footer(p, c, ts) for p, c in zip(batch.column(0).to_pylist(), contents)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow) if rows else pa.RecordBatch.from_pylist([], arrow)

    return files.mapInArrow(run, FOOTER)


def scan_paths(spark: SparkSession, root: str, chosen: DataFrame, schema: StructType | None = None, merge: bool = False) -> DataFrame | None:
    """The files or folders in the one column of ``chosen``, with the partition columns below ``root``; None if there are none.

    The paths go through the driver, as the list of files of any scan does.
    """
    paths = sorted(r[0] for r in chosen.distinct().collect())
    if not paths:
        return None
    reader = spark.read.option("basePath", root).option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def scan_between(spark: SparkSession, root: str, ts: str, low: str, high: str) -> DataFrame:
    """Rows with ``low <= ts <= high`` (times as text, UTC), from the files whose footers allow any: others are not opened."""
    inside = (F.col("high").isNull() | (F.col("high") >= F.lit(low).cast("timestamp"))) & (F.col("low").isNull() | (F.col("low") <= F.lit(high).cast("timestamp")))
    known = footers(spark, root, ts).where(F.array_contains("columns", ts))
    rows = scan_paths(spark, root, known.where(inside).select("path"))
    if rows is None:
        return spark.read.parquet(root).where("false")
    kind = rows.schema[ts].dataType.simpleString()
    return rows.where(F.col(ts).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
