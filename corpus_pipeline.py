"""A corpus pipeline over the documents: each stage's rows are written and read again as the next one's input.

All stages but the last return the columns they got, whatever their names: those that a stage adds inside are named apart. A null text counts
as an empty one, which the quality rules reject; a null id is smaller than every other, a null source the last one; an empty
table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltlane.llm import bpe, exact, mixing, near, quality
from voltlane.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; rows with a null or empty text go, repeated rows stay or go together."""
    return quality.keep_quality(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of every group of equal texts; of rows with that id one stays."""
    return exact.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near duplicates; rows without an id are left as they are."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeated rows and rows without an id are documents of their own."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every row of the mix; an empty text has none."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality rules", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't state near dedup by signatures, the dealt mix and the encoding; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
