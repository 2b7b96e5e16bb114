"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch brings changes of documents: an insert adds its counts, a delete takes them away, and a revised count does
both. Totals are additive, so a batch is summed first and then added; nothing already counted is read again.

A ledger names the tables of sums that count, each with the ids of the batches in it. A commit writes its table aside and
then puts a new ledger in the place of the old one by a rename, so readers and lost drivers see it whole or not at all. A batch
that is delivered again replaces its table; once it is compacted with others it is known by its id and left out. So
every batch counts once, however often it comes.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import flat, owner, pieces, sums, word_bounds, worker_store
from voltlane.llm.tokens import WordCache, encode_piece, merges, ship_vocabulary
from voltlane.session import materialise, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("source", "lang", "tokenizer")
COUNTS = ("n_docs", "n_tokens", "n_chars")
WORD_VERSION, BPE_VERSION = "words-1", "byte_bpe_50k-1"
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def document_counts(docs: DataFrame, *, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens, n_chars`` with one row per document and tokenizer version.

    Tokens are words in one version and ids of the byte-level BPE vocabulary in the other; a null text counts as empty.
    """
    shipped = ship_vocabulary(docs.sparkSession, tokenizer_path)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokenizer string, n_tokens long, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("rollups")
        if store.get("of") != shipped.value.raw:
            store["of"], store["cache"] = shipped.value.raw, WordCache(shipped.value)
        for piece in pieces(batches):
            data, offsets = flat(piece.column(3))
            _, ends = encode_piece(data, offsets, merges(shipped.value.raw).encode, store["cache"])
            words = np.bincount(owner(word_bounds(data, offsets)[0], offsets), minlength=piece.num_rows)
            chars = sums((data & 0xC0) != 0x80, offsets)
            for version, n in ((WORD_VERSION, words), (BPE_VERSION, np.diff(ends))):
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:3], pa.array([version] * piece.num_rows, pa.string()), pa.array(n.astype(np.int64)), pa.array(chars)],
                    ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"],
                )

    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, schema)


def signed_changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Changes with a ``sign``: counts of new documents, of removed ones, and the old and new counts of revised ones."""
    old, new = revised or (None, None)
    frames = [f.withColumn("sign", F.lit(s)) for f, s in ((inserted, 1), (deleted, -1), (old, -1), (new, 1)) if f is not None]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def batch_sums(changes: DataFrame) -> DataFrame:
    """What a batch adds to each total; keys whose sums are all 0 are left out. Null keys are keys like any other."""
    sign = F.col("sign").cast("long")
    counted = changes.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), *[F.sum(sign * F.col(c)).alias(c) for c in COUNTS[1:]])
    return counted.where(" OR ".join(f"{c} <> 0" for c in COUNTS))


class Ledger:
    """Which tables below a folder count: ``[{"table": name, "ids": [batch ids]}]`` in one small file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.of("").toUri(), conf)
        self.store = self.of("").getFileSystem(conf)

    def entries(self) -> list[dict]:
        if not self.store.exists(self.of("_ledger")):
            return []
        stream = self.store.open(self.of("_ledger"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def replace(self, entries: list[dict]) -> None:
        aside = f"_ledger-{uuid.uuid4().hex}"
        stream = self.store.create(self.of(aside))
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.files.rename(self.of(aside), self.of("_ledger"), options)

    def write(self, sums_: DataFrame) -> str:
        name = f"sums-{uuid.uuid4().hex}"
        sums_.write.parquet(f"{self.path}/{name}")
        return name


def commit_batch(path: str, batch_id: str, changes: DataFrame) -> bool:
    """Commit a batch's sums under its id; whether it counts anew. The same id again replaces them, and one that was compacted does nothing.

    One writer at a time: the ledger is replaced, not merged.
    """
    ledger = Ledger(changes.sparkSession, path)
    entries = ledger.entries()
    if any(batch_id in e["ids"] for e in entries if e.get("compact")):
        return False
    table = ledger.write(batch_sums(changes))
    ledger.replace([e for e in entries if e["ids"] != [batch_id]] + [{"table": table, "ids": [batch_id]}])
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of all committed batches; keys without documents are left out."""
    tables = [f"{path.rstrip('/')}/{e['table']}" for e in Ledger(spark, path).entries()]
    batches = spark.read.schema(SUMS).parquet(*tables) if tables else spark.createDataFrame([], SUMS)
    summed = batches.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.where(" OR ".join(f"{c} <> 0" for c in COUNTS))


def compact(spark: SparkSession, path: str) -> None:
    """Put the sums of all batches into one table, which keeps their ids. The old tables stay until their readers are done."""
    ledger = Ledger(spark, path)
    ids = [i for e in ledger.entries() for i in e["ids"]]
    ledger.replace([{"table": ledger.write(totals(spark, path)), "ids": ids, "compact": True}])


def maintained_totals(docs: DataFrame, *, tokenizer_path: str | None = None) -> DataFrame:
    """Totals over all documents, brought about by changes: ``source, lang, tokenizer`` and the three sums.

    All documents come in with their number of characters as a first count, which is then revised, twice under one
    key as a retry would; documents with odd ids are deleted, the batches are compacted, the deletion is delivered once more, and
    the documents come in again. An empty table gives no rows; repeated
    rows count as often as they occur; a null or empty text adds a document without tokens.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "rollups")
    counts = materialise(document_counts(docs, tokenizer_path=tokenizer_path), "counts")
    first = counts.withColumn("n_tokens", F.col("n_chars"))
    odd = counts.where(F.col("doc_id") % 2 != 0)
    commit_batch(path, "0001", signed_changes(inserted=first))
    for _ in range(2):
        commit_batch(path, "0002", signed_changes(revised=(first, counts)))
    commit_batch(path, "0003", signed_changes(deleted=odd))
    compact(spark, path)
    for again in ("0003", "0004"):
        commit_batch(path, again, signed_changes(deleted=odd) if again == "0003" else signed_changes(inserted=odd))
    return totals(spark, path)
