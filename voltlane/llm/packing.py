"""Token ids on disk: frequency-ranked, in one to three bytes each, with the lengths in separate control bytes.

The documents are put in order of their ids in ranges; each range is one shard, written by one task as blocks of bounded
size. A block ranks its token ids by frequency, so the commonest 256 take one data byte and the rest of 65,536 take
two. Four lengths, less one, make a control byte. Decoding looks the lengths of a control byte up in a table and never
loops over tokens. Blocks hold all that decoding needs, so files are read where they lie; they are rows of a Parquet
container, so Spark commits them as a whole and a lost task is written again.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import flat, parts_for, pieces, worker_store
from voltlane.llm.tokens import WordCache, encode_piece, library_words, ship_vocabulary
from voltlane.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES, BLOCK_TOKENS, END_ID = 16 << 20, 4 << 20, 0
FILES = "shard int, block int, ranks binary, doc_ids binary, known binary, n_tokens binary, n long, control binary, data binary"
#: lengths, less one, of the four values that a control byte describes
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned values below 2**32, lowest byte first."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    keep = np.arange(4) <= extra[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``pack``: lengths by table lookup, then each byte is added where it belongs."""
    extra = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(extra + 1) - extra - 1
    out = raw[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        if not len(more):
            break
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Ids that occur, from the most to the least frequent; ties by id."""
    return np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]


def _block(shard: int, block: int, owners: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    order = by_frequency(np.bincount(ids))
    rank = np.zeros(int(ids.max()) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = pack(rank[ids])
    own = [np.asarray(x.fill_null(0)).astype("<i8").tobytes() for x, _ in owners]
    known = [np.asarray(x.is_valid()).tobytes() for x, _ in owners]
    lengths = np.concatenate([n for _, n in owners]).astype("<i8")
    row = [shard, block, order.astype("<u4").tobytes(), b"".join(own), b"".join(known), lengths.tobytes(), len(ids), control, data]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [f.split()[0] for f in FILES.split(", ")])


def write_files(docs: DataFrame, path: str, *, tokenizer_path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``doc_id, text`` rows with the tokenizers library and write the ids in ascending ``doc_id`` order."""
    shipped = ship_vocabulary(docs.sparkSession, tokenizer_path)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # nulls come first; many rows of one id are dealt by how their texts begin, which keeps the order
    ordered = ordered.repartitionByRange(parts_for(docs, shard_bytes), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("packing")
        if store.get("of") != shipped.value.raw:
            store["of"], store["run"], store["cache"] = shipped.value.raw, library_words(shipped.value.raw), WordCache(shipped.value)
        owners, parts, block, size = [], [], 0, 0
        for piece in pieces(batches):
            ids, ends = encode_piece(*flat(piece.column(1)), store["run"], store["cache"])
            owners.append((piece.column(0), np.diff(ends) + 1))
            parts.append(np.insert(ids, ends[1:], end_id))
            size += len(parts[-1])
            if size >= block_tokens:
                yield _block(piece.column(2)[0].as_py(), block, owners, parts)
                owners, parts, block, size = [], [], block + 1, 0
        if parts:
            yield _block(piece.column(2)[0].as_py(), block, owners, parts)

    ordered.mapInArrow(run, FILES).write.option("compression", "none").parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from written files; ``start`` counts the ids of all documents before."""
    files = spark.read.schema(FILES).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ranks"], "<u4")[unpack(r["control"], r["data"], r["n"])].astype("<u4")
                lengths = np.frombuffer(r["n_tokens"], "<i8")
                ends = np.cumsum(lengths)
                own, known = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["known"], bool)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                place = [pa.array(np.full(len(own), r[c], np.int32)) for c in ("shard", "block")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(own, mask=~known), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "ahead", "n_tokens", "ids_crc32"])

    decoded = files.mapInArrow(run, "shard int, block int, doc_id long, ahead long, n_tokens long, ids_crc32 long")
    # one row per block, then one per shard
    blocks = files.select("shard", "block", "n")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = totals.select("shard", before(Window.orderBy("shard")).alias("first"))
    inside = blocks.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("inner"))
    starts = inside.join(shards, "shard").select("shard", "block", (F.col("first") + F.col("inner")).alias("begin"))
    joined = decoded.join(starts, ["shard", "block"])
    return joined.select("doc_id", (F.col("begin") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **settings) -> DataFrame:
    """Write the files below the shared folder and read them back: one row per document.

    A null or empty text has only its end id. Rows with one id follow each other by text; null ids come first. Other
    columns are ignored; an empty table gives no rows.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_files(docs, path, **settings)
    return read_files(docs.sparkSession, path)
