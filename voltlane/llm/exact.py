"""Exact duplicates over a sharded cuckoo-filter index of content digests.

A shard holds the keys (SHA-256 digests) it has stored, each with the largest document id and the number of rows, and a
cuckoo filter over them. A filter hit points at a slot of a bucket, and the stored key in that slot is compared in
full, so a false hit never joins two texts. A filter that overflows is rebuilt at twice the size from the stored keys.
Only digests are shuffled, after equal ones of a batch have been put together, so one text that makes up a third of
all rows reaches its shard as a few rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import flat, fresh, mix
from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS, KEY_BYTES, SHARD_KEYS, NO_ID = 4, 32, 1_000_000, np.iinfo(np.int64).min
ENTRY = "shard int, digest binary, keep_id long, n_rows long"


class CuckooIndex:
    """Keys of four 64-bit words with an id and a count each; insertion, deletion and verified lookup, all vectorised."""

    def __init__(self, capacity: int = 1024):
        self.keys = np.zeros((0, 4), np.uint64)
        self.ids = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.live = np.zeros(0, bool)
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        self.n_buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 4) / SLOTS / 0.85))))
        self.prints = np.zeros((self.n_buckets, SLOTS), np.uint16)  # 0: free
        self.slots = np.full((self.n_buckets, SLOTS), -1, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys[:, 0] ^ keys[:, 2])
        prints = ((h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        first = (h & np.uint64(self.n_buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key among the stored keys, or -1; every filter hit is verified against the stored key."""
        found = np.full(len(keys), -1, np.int64)
        prints, first, second = self._places(keys)
        for bucket in (first, second):
            for s in range(SLOTS):
                hit = np.flatnonzero((self.prints[bucket, s] == prints) & (found < 0))
                at = self.slots[bucket[hit], s]
                same = (self.keys[at] == keys[hit]).all(1)
                found[hit[same]] = at[same]
        return found

    def _place(self, at: np.ndarray) -> bool:
        """Put stored keys into the filter; False when it overflows."""
        prints, bucket, _ = self._places(self.keys[at])
        rng = np.random.default_rng(len(self.keys))
        for _ in range(500):
            for s in range(SLOTS):
                free = np.flatnonzero(self.prints[bucket, s] == 0)
                _, one = np.unique(bucket[free], return_index=True)
                put = free[one]
                self.prints[bucket[put], s], self.slots[bucket[put], s] = prints[put], at[put]
                rest = np.ones(len(at), bool)
                rest[put] = False
                at, prints, bucket = at[rest], prints[rest], bucket[rest]
            if not len(at):
                return True
            bucket = self._other(bucket, prints)
            full = np.flatnonzero((self.prints[bucket] != 0).all(1))
            _, one = np.unique(bucket[full], return_index=True)
            kick, s = full[one], rng.integers(0, SLOTS, len(one))
            # the victim takes the newcomer's place in the queue and goes on to its other bucket
            gone, gone_print = self.slots[bucket[kick], s].copy(), self.prints[bucket[kick], s].copy()
            self.slots[bucket[kick], s], self.prints[bucket[kick], s] = at[kick], prints[kick]
            at[kick], prints[kick] = gone, gone_print
            bucket[kick] = self._other(bucket[kick], gone_print)
        return False

    def _resize(self) -> None:
        alive = np.flatnonzero(self.live)
        self.keys, self.ids, self.counts = self.keys[alive], self.ids[alive], self.counts[alive]
        self.live = np.ones(len(alive), bool)
        capacity = max(2 * self.n_buckets * SLOTS, int(len(alive) / 0.8))
        while True:
            self._clear(capacity)
            if self._place(np.arange(len(alive))):
                return
            capacity *= 2

    def insert(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add rows; keys already there get the larger id and the sum of counts."""
        if not len(keys):
            return
        order = np.lexsort((ids, *keys.T))
        keys, ids, counts = keys[order], ids[order], counts[order]
        last = np.concatenate([(keys[1:] != keys[:-1]).any(1), [True]])
        sums = np.diff(np.concatenate([[0], np.cumsum(counts)[last]]))
        keys, ids, counts = keys[last], ids[last], sums
        at = self.find(keys)
        known, new = at[at >= 0], at < 0
        self.ids[known] = np.maximum(self.ids[known], ids[~new])
        self.counts[known] += counts[~new]
        begin = len(self.keys)
        self.keys = np.concatenate([self.keys, keys[new]])
        self.ids = np.concatenate([self.ids, ids[new]])
        self.counts = np.concatenate([self.counts, counts[new]])
        self.live = np.concatenate([self.live, np.ones(int(new.sum()), bool)])
        fits = self.live.sum() <= 0.95 * self.n_buckets * SLOTS
        if not fits or not self._place(np.arange(begin, len(self.keys))):
            self._resize()

    def delete(self, keys: np.ndarray) -> None:
        """Take live keys out of the filter and the store; unknown keys are ignored."""
        at = np.unique(self.find(keys))
        at = at[at >= 0]
        prints, first, second = self._places(self.keys[at])
        for bucket in (first, second):
            for s in range(SLOTS):
                hit = np.flatnonzero(self.slots[bucket, s] == at)
                self.prints[bucket[hit], s], self.slots[bucket[hit], s] = 0, -1
        self.live[at] = False


def _keys(column: pa.Array) -> np.ndarray:
    data, _ = flat(column)
    return np.frombuffer(data.tobytes(), "<u8").reshape(-1, 4)


def _entries(shard: int, index: CuckooIndex) -> pa.Table:
    live = np.flatnonzero(index.live)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(live), [None, pa.py_buffer(np.ascontiguousarray(index.keys[live]).tobytes())])
    ids = index.ids[live]
    return pa.table(
        [pa.array(np.full(len(live), shard, np.int32)), raw.cast(pa.binary()), pa.array(ids, mask=ids == NO_ID), pa.array(index.counts[live])],
        names=["shard", "digest", "keep_id", "n_rows"],
    )


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID))


def content_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of every row; a null text counts as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))


def _batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.table([batch.column(1), batch.column(0)], names=["digest", "doc_id"])
        out = table.group_by("digest").aggregate([("doc_id", "max"), ([], "count_all")])
        yield pa.RecordBatch.from_arrays([out["digest"].combine_chunks(), out["doc_id_max"].combine_chunks(), out["count_all"].combine_chunks()], ["digest", "keep_id", "n_rows"])


def _sharded(rows: DataFrame, n_shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))


def build_index(digests: DataFrame, n_shards: int) -> DataFrame:
    """The live entries of an index over ``doc_id, digest`` rows: ``shard, digest, keep_id, n_rows``."""
    rows = _sharded(digests.mapInArrow(_batch_sums, "digest binary, keep_id long, n_rows long"), n_shards)

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            index.insert(_keys(b.column(0)), _ids(b.column(1)), np.asarray(b.column(2)))
        yield from _entries(key[0].as_py(), index).to_batches()

    return rows.groupBy("shard").applyInArrow(build, ENTRY)


def update_index(entries: DataFrame, stored: DataFrame, inserts: DataFrame, deletes: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """The index and the stored ``doc_id, digest`` rows after a batch of deletions and insertions.

    ``deletes`` names stored rows by ``doc_id``. A digest without rows left is deleted from its shard; one that keeps
    rows gets its largest id anew from them. Unknown ids are ignored.
    """
    gone = stored.join(deletes.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
    hit = gone.select("digest").distinct()
    rest = stored.join(deletes.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    again = rest.join(hit, "digest", "left_semi").select("doc_id", "digest").unionByName(inserts.select("doc_id", "digest"))
    fresh = again.mapInArrow(_batch_sums, "digest binary, keep_id long, n_rows long")
    drop = hit.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n_rows"))
    changes = _sharded(fresh.withColumn("kind", F.lit(1)).unionByName(drop.withColumn("kind", F.lit(0))), n_shards)
    old = entries.select("digest", "keep_id", "n_rows", F.lit(-1).alias("kind"), "shard")

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        index, kind = CuckooIndex(), np.asarray(table["kind"])
        keys, ids, counts = _keys(table["digest"]), _ids(table["keep_id"].combine_chunks()), np.asarray(table["n_rows"])
        for k in (-1, 0, 1):
            at = kind == k
            if k == 0:
                index.delete(keys[at])
            else:
                index.insert(keys[at], ids[at], counts[at])
        return _entries(key[0].as_py(), index)

    merged = old.unionByName(changes.select(*old.columns))
    return merged.groupBy("shard").applyInArrow(apply, ENTRY), rest.unionByName(inserts.select(*rest.columns))


def exact_groups(docs: DataFrame, *, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. The largest id of a group stays (null ids are
    smallest); of repeated rows with that id one stays. Other columns are ignored; an empty table gives no rows.
    """
    digests = materialise(content_digests(docs), "digests")
    n_shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-digests.count() // shard_keys))
    entries = materialise(build_index(digests, n_shards), "index")
    both = digests.join(entries.drop("shard"), "digest")
    of_keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    winners = both.where(of_keeper).withColumn("_n", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")))
    rows = both.where(~of_keeper).withColumn("_n", F.lit(0)).unionByName(winners)
    return rows.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), (F.col("_n") == 1).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_exact(docs: DataFrame, *, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay."""
    digests = materialise(content_digests(docs), "digests")
    n_shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-digests.count() // shard_keys))
    key, keep, place = fresh(docs, "_digest", "_keep", "_place")
    entries = materialise(build_index(digests, n_shards), "index").select(F.col("digest").alias(key), F.col("keep_id").alias(keep))
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    staying = docs.join(entries, (digest == F.col(key)) & docs["doc_id"].cast("long").eqNullSafe(F.col(keep)))
    one = F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))
    return staying.withColumn(place, one).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
