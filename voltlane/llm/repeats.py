"""Repeated passages across documents by common-prefix intervals of sharded, enhanced suffix arrays.

Where a passage of ``length`` bytes goes is decided by its minimizer, the least hash of its shorter substrings: equal
passages share it wherever they stand, and neighbouring passages mostly do, so they travel as one stretch of text.

1. Documents are put in groups by a hash of their id; every later step addresses text by group, so no text is
   gathered beyond a group and the one exchange of the texts serves all steps.
2. Each group sends fingerprints of its minimizers; those seen in one document only can't be part of a repeat.
3. Stretches with the other minimizers go to their shard, equal ones of a group once. A shard sorts the suffixes of its
   stretches and scans the common prefixes of neighbours with a stack: each interval is a repeat with all its
   occurrences. Intervals that all occurrences extend to the left by the same byte are part of a longer one and left out.
4. Each group gets back what is repeated in documents with smaller ids.

Minimizers that are in very many groups are split by those of longer substrings, so that a common phrase in ever new
surroundings does not fill one shard.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.llm.common import flat, mix, owner, prefix_hash, rolling_hash, size_hint, slice_hash, sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, SEED_BYTES, SPLIT_BYTES, CHUNK, HASHED = 50, 24, 40, 1 << 20, 1 << 15
GROUP_BYTES, SHARD_BYTES, HOT_GROUPS = (2 << 20, 8 << 20), 4 << 20, 64
NO_ID = np.iinfo(np.int64).min


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def minimizers(data: np.ndarray, seed: int, length: int) -> np.ndarray:
    """For every window of ``length`` bytes the least hash of its substrings of ``seed`` bytes, scrambled."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    return mix(sliding_min(rolling_hash(data, seed), length - seed + 1))


def window_runs(data: np.ndarray, offsets: np.ndarray, seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches ``[start, end)`` of window starts with one minimizer, and the minimizer; windows stay in their document.

    Long texts are read in chunks; a stretch may be cut anywhere and is never longer than the number of seeds in a window.
    """
    starts, ends, keys, longest = [], [], [], length - seed + 1
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    bad = np.cumsum(edge)[:-1] > 0  # windows that would leave their document
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    for a in range(0, len(data), CHUNK):
        m = minimizers(data[a : a + CHUNK + length - 1], seed, length)
        good = ~bad[a : a + len(m)]
        new = good.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~good[:-1] | first[a + 1 : a + len(m)]
        begin = np.flatnonzero(new)
        stop = good.copy()
        stop[:-1] &= new[1:] | ~good[1:]
        end = np.flatnonzero(stop) + 1
        pieces = -(-(end - begin) // longest)
        if len(pieces) and pieces.max() > 1:
            which = np.repeat(np.arange(len(begin)), pieces)
            part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, end = begin[which] + part * longest, np.minimum(end[which], begin[which] + (part + 1) * longest)
        starts.append(begin + a)
        ends.append(end + a)
        keys.append(m[begin])
    empty = np.zeros(0, np.int64)
    if not starts:
        return empty, empty, empty.astype(np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(keys)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each slice; slices are short and in order of their start, so chunks of the data suffice."""
    out = np.zeros((2, len(starts)), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + HASHED, HASHED))
    for i, (p, q) in enumerate(zip(cuts, cuts[1:])):
        if p < q:
            a = i * HASHED
            part = data[a : int(ends[p:q].max())]
            for w in (0, 1):
                out[w, p:q] = slice_hash(prefix_hash(part, w), starts[p:q] - a, ends[p:q] - a, w)
    return out[0], out[1]


def distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct pair of hashes, and which of them every entry is."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(keys) else np.zeros(0, np.int64)
    if len(first) and (check[first[inverse]] != check).any():
        order = np.lexsort((check, keys))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])])
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.cumsum(new) - 1
        _, first = np.unique(inverse, return_index=True)
    return first, inverse


def least_of(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each of the ``n`` groups; every group occurs."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, values)
    np.maximum.at(high, group, values)
    return low, high


class Group:
    """The documents of a group with the stretches of their windows; made the same way in every step."""

    def __init__(self, table: pa.Table, n_shards: int, length: int, seed: int):
        by = np.argsort(np.asarray(table["row"]), kind="stable")
        table = table.take(pa.array(by)) if len(by) else table
        self.length, self.n_shards = length, n_shards
        self.ids = np.asarray(table["doc_id"].combine_chunks().fill_null(NO_ID))
        self.rows = np.asarray(table["row"])
        self.data, self.offsets = flat(table["text"].combine_chunks())
        self.starts, self.ends, self.keys = window_runs(self.data, self.offsets, seed, length)
        self.doc_ids = self.ids[owner(self.starts, self.offsets)] if len(self.starts) else np.zeros(0, np.int64)
        self.unique, self.which = np.unique(self.keys, return_inverse=True)

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The entries of each shard that has some, in a fixed order."""
        # small numbers are sorted by their digits
        shard = (keys % np.uint64(self.n_shards)).astype(np.uint16 if self.n_shards <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield int(shard[part[0]]), part

    def fingerprints(self) -> Iterator[tuple[int, bytes, bytes]]:
        """For each shard its minimizers in 32 bits, and whether two documents of this group have them."""
        if not len(self.unique):
            return
        low, high = least_of(self.which, self.doc_ids, len(self.unique))
        for shard, part in self.by_shard(self.unique):
            prints = (self.unique[part] // np.uint64(self.n_shards)).astype(np.uint32)
            yield shard, prints.tobytes(), np.packbits(low[part] != high[part]).tobytes()

    def select(self, flags: dict[int, bytes]) -> None:
        """Keep the stretches of repeated minimizers, split those of very common ones, and find the equal ones."""
        marks = np.zeros(len(self.unique), np.uint8)
        for shard, part in self.by_shard(self.unique):
            marks[part] = np.frombuffer(flags[shard], np.uint8)
        mark = marks[self.which]
        once = np.flatnonzero(mark == 1)
        starts, ends, keys = [self.starts[once]], [self.ends[once]], [self.keys[once]]
        hot = np.flatnonzero(mark == 2)
        for p in range(0, len(hot), 20_000):
            part = hot[p : p + 20_000]
            s, e = self.starts[part], self.ends[part]
            # the stretches one after the other, as documents of their own
            lengths = e - s + self.length - 1
            cut = np.concatenate([[0], np.cumsum(lengths)])
            index = np.arange(cut[-1]) + np.repeat(s - cut[:-1], lengths)
            a, b, k = window_runs(self.data[index], cut, SPLIT_BYTES * self.length // LENGTH, self.length)
            starts.append(index[a])
            ends.append(index[a] + b - a)
            keys.append(k)
        self.starts, self.ends, self.keys = (np.concatenate(x) for x in (starts, ends, keys))
        order = np.argsort(self.starts, kind="stable")
        self.starts, self.ends, self.keys = self.starts[order], self.ends[order], self.keys[order]
        self.doc_ids = self.ids[owner(self.starts, self.offsets)] if len(self.starts) else np.zeros(0, np.int64)
        hashes = span_hashes(self.data, self.starts, self.ends + self.length - 1)
        self.first, self.which = distinct(*hashes)
        self.least = least_of(self.which, self.doc_ids, len(self.first))[0] if len(self.first) else np.zeros(0, np.int64)

    def stretches(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """For each shard the distinct stretches: lengths, least document ids, compressed text."""
        for shard, part in self.by_shard(self.keys[self.first]):
            s, e = self.starts[self.first[part]], self.ends[self.first[part]] + self.length - 1
            cut = np.concatenate([[0], np.cumsum(e - s)])
            text = self.data[np.arange(cut[-1]) + np.repeat(s - cut[:-1], e - s)]
            squeeze = zstandard.ZstdCompressor(level=1).compress
            yield shard, (e - s).astype(np.uint16).tobytes(), squeeze(self.least[part].tobytes()), squeeze(text.tobytes())

    def covered(self, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Which bytes a document with a smaller id has as well, from the shards' answers."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        everywhere = np.zeros(len(self.first), bool)
        spans = []
        for shard, part in self.by_shard(self.keys[self.first]):
            bits, some = answers[shard]
            everywhere[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
            rel = np.frombuffer(some, np.int32).reshape(-1, 3)
            spans.append(np.stack([part[rel[:, 0]], rel[:, 1], rel[:, 2]], 1))
        whole = everywhere[self.which] | (self.doc_ids != self.least[self.which])
        at = np.flatnonzero(whole)
        np.add.at(edge, self.starts[at], 1)
        np.add.at(edge, self.ends[at] + self.length - 1, -1)
        spans = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
        if len(spans):
            rest = np.flatnonzero(~whole)
            order = rest[np.argsort(self.which[rest], kind="stable")]
            low = np.searchsorted(self.which[order], spans[:, 0])
            n = np.searchsorted(self.which[order], spans[:, 0], side="right") - low
            pick = np.repeat(np.arange(len(spans)), n)
            run = order[np.repeat(low, n) + np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)]
            np.add.at(edge, self.starts[run] + spans[pick, 1], 1)
            np.add.at(edge, self.starts[run] + spans[pick, 2], -1)
        return np.cumsum(edge)[:-1] > 0


    def occurrences(self, answers: dict[int, bytes]) -> pa.Table:
        """``repeat, length, doc_id, start`` of every occurrence in this group, from the shards' answers."""
        out = []
        order = np.argsort(self.which, kind="stable")
        sorted_which = self.which[order]
        for shard, part in self.by_shard(self.keys[self.first]):
            rows = np.frombuffer(answers[shard], np.int64).reshape(-1, 4)
            cls = part[rows[:, 1]]
            low = np.searchsorted(sorted_which, cls)
            n = np.searchsorted(sorted_which, cls, side="right") - low
            pick = np.repeat(np.arange(len(rows)), n)
            run = order[np.repeat(low, n) + np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)]
            at = self.starts[run] + rows[pick, 2]
            out.append(np.stack([rows[pick, 0], rows[pick, 3], self.doc_ids[run], at - self.offsets[owner(at, self.offsets)]], 1))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        ids = pa.array(found[:, 2], mask=found[:, 2] == NO_ID)
        return pa.table([found[:, 0], found[:, 1], ids, found[:, 3]], names=["repeat", "length", "doc_id", "start"])


def mark_fingerprints(prints: np.ndarray, multiple: np.ndarray, hot: int) -> np.ndarray:
    """1 for fingerprints of two documents or groups at least, 2 for those of ``hot`` groups at least, else 0."""
    order = np.argsort(prints, kind="stable")
    s = prints[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(s)))
    several = np.logical_or.reduceat(multiple[order], head) if len(head) else np.zeros(0, bool)
    mark = np.where(n >= hot, 2, ((n > 1) | several).astype(np.uint8)).astype(np.uint8)
    out = np.zeros(len(prints), np.uint8)
    out[order] = np.repeat(mark, n)
    return out


def interval_tree(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """Common-prefix intervals ``(first, last, length, parent)`` of a suffix array by a scan with a stack.

    ``lcp[i]`` is the common prefix of suffixes ``i`` and ``i + 1``; intervals of length 0 are left out. A parent is an index
    into the result, or -1.
    """
    done: list[list[int]] = []
    stack: list[list] = [[0, 0, []]]  # length, first suffix, closed children
    for i, length in enumerate([*lcp, 0]):
        first, children = i, []
        while stack and stack[-1][0] > length:
            top_length, first, inner = stack.pop()
            inner = inner + children if children else inner
            done.append([first, i, top_length, -1])
            for c in inner:
                done[c][3] = len(done) - 1
            children = [len(done) - 1]
        if stack and stack[-1][0] == length:
            stack[-1][2].extend(children)
        else:
            stack.append([length, first, children])
    return [tuple(x) for x in done]


class Shard:
    """Stretches of one shard from all groups: classes of equal ones, and the repeats that different ones share."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, length: int):
        self.length, self.data = length, data
        self.cut = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        self.first, self.which = distinct(*span_hashes(data, self.cut[:-1], self.cut[1:]))
        self.least = least_of(self.which, ids, len(self.first))[0] if len(self.first) else np.zeros(0, np.int64)

    def shared_suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of at least ``length`` bytes that begin like one of another class, in order: class, place, rest, block.

        A block holds those with equal first ``length`` bytes, sorted by the rest; ``rest`` has the bytes beyond and, last,
        their number. Blocks whose suffixes all have the same byte before them are left out.
        """
        starts = self.cut[self.first]
        n = self.cut[self.first + 1] - starts - self.length + 1
        cls = np.repeat(np.arange(len(starts)), n)
        place = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[cls] + place
        order = np.argsort(at, kind="stable")
        keys, check = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        keys[order], check[order] = span_hashes(self.data, at[order], at[order] + self.length)
        _, block = distinct(keys, check)
        common = np.flatnonzero(np.bincount(block)[block] > 1)
        # where all have the same byte before them, the block of the suffixes that begin there says all that this one does
        before, some = self.before(at[common], place[common]), np.zeros(len(block), np.int64)
        some[block[common]] = before
        open_ = np.zeros(len(block), bool)
        open_[block[common][(before < 0) | (before != some[block[common]])]] = True
        common = common[open_[block[common]]]
        cls, place, at, block = cls[common], place[common], at[common], block[common]
        left = (n[cls] - 1 - place).astype(np.int64)  # bytes beyond the first ``length``
        widest = -(-max(int(left.max()) if len(left) else 0, 1) // 8) * 8
        reach = np.arange(widest)
        rest = np.zeros((len(at), widest), np.uint8)
        for p in range(0, len(at), 100_000):
            inside = reach < left[p : p + 100_000, None]
            index = np.where(inside, at[p : p + 100_000, None] + self.length + reach, 0)
            rest[p : p + 100_000] = np.where(inside, self.data[index], 0)
        words = rest.view(">u8").astype(np.uint64)
        order = np.lexsort((left, *words.T[::-1], block))
        return cls[order], place[order], np.concatenate([rest, left.astype(np.uint8)[:, None]], 1)[order], block[order]

    def before(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The byte before each suffix; -1: none."""
        return np.where(place > 0, self.data[np.maximum(at - 1, 0)].astype(np.int64), -1)

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]]:
        """For each block with more than one class: classes, places, left bytes (-1: none) and its interval tree."""
        cls, place, rest, block = self.shared_suffixes()
        if not len(cls):
            return
        left, width = rest[:, -1].astype(np.int64), rest.shape[1] - 1
        same = rest[1:, :width] == rest[:-1, :width]
        beyond = np.where(same.all(1), width, np.argmin(same, 1))
        lcp = self.length + np.minimum(beyond, np.minimum(left[1:], left[:-1]))
        before = self.before(self.cut[self.first[cls]] + place, place)
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield cls[a:b], place[a:b], before[a:b], interval_tree(lcp[a : b - 1].tolist())

    def covered_heads(self) -> list[tuple[int, int, int]]:
        """Spans ``(class, start, end)`` that documents below the class's least one have as well.

        For each suffix that is the end of the longest interval around it in which a class has a smaller id. An interval
        with one and the same byte before all its suffixes is skipped: the one a byte to the left says more.
        """
        out = []
        for cls, place, before, tree in self.repeats():
            ids = self.least[cls].tolist()
            lows, ways, inner = [], [], [-1] * len(ids)
            for k, (a, b, _, _) in enumerate(tree):  # children come before their parents
                lows.append(min(ids[a : b + 1]))
                ways.append(before[a] < 0 or bool((before[a : b + 1] != before[a]).any()))
                for i in range(a, b + 1):
                    if inner[i] < 0:
                        inner[i] = k
            for i, k in enumerate(inner):
                while k >= 0 and not (lows[k] < ids[i] and ways[k]):
                    k = tree[k][3]
                if k >= 0:
                    out.append((int(cls[i]), int(place[i]), int(place[i]) + tree[k][2]))
        return out

    def groups(self, owners: np.ndarray, shard: int) -> Iterator[tuple[int, bytes]]:
        """For each group of documents its stretches' repeats: number, place among its stretches, start, length.

        A repeat is an interval that is not always extended by one byte to the left, with all its suffixes, or a class of
        equal stretches.
        """
        n = np.diff(self.cut)[self.first]
        found, number, alone = [], len(n), np.ones(len(n), bool)
        for cls, place, before, tree in self.repeats():
            for a, b, length, _ in tree:
                part = cls[a : b + 1]
                alone[part[(place[a : b + 1] == 0) & (n[part] == length)]] = False  # the interval has these as well
                if before[a] < 0 or (before[a : b + 1] != before[a]).any():
                    part = np.stack([np.full(b - a + 1, number), cls[a : b + 1], place[a : b + 1], np.full(b - a + 1, length)], 1)
                    found.append(part)
                    number += 1
        own = np.flatnonzero(alone)
        found.append(np.stack([own, own, np.zeros(len(own), np.int64), n[own]], 1))
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        low = np.searchsorted(rows[:, 1], self.which)
        n = np.searchsorted(rows[:, 1], self.which, side="right") - low
        order = np.argsort(owners, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owners[order])) + 1) if len(order) else []:
            own = np.repeat(np.arange(len(part)), n[part])
            pick = np.repeat(low[part], n[part]) + np.arange(len(own)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            yield int(owners[part[0]]), np.stack([rows[pick, 0] + (shard << 40), own, rows[pick, 2], rows[pick, 3]], 1).tobytes()

    def answers(self, owners: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """For each group whose stretches these are: which are covered in all its documents, and spans of the others."""
        spans = np.array(sorted(self.covered_heads()), np.int64).reshape(-1, 3)
        below = self.least[self.which] < ids
        order = np.argsort(owners, kind="stable")
        low = np.searchsorted(spans[:, 0], self.which)
        n = np.where(below, 0, np.searchsorted(spans[:, 0], self.which, side="right") - low)
        for part in np.split(order, np.flatnonzero(np.diff(owners[order])) + 1) if len(order) else []:
            many = n[part]
            own = np.repeat(np.arange(len(part)), many)
            pick = np.repeat(low[part], many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            rel = np.stack([own, spans[pick, 1], spans[pick, 2]], 1).astype(np.int32)
            yield int(owners[part[0]]), np.packbits(below[part]).tobytes(), rel.tobytes()


def _emit(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])


SIDE = [("group", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
SIDE_SCHEMA = "group long, shard long, kind int, a binary, b binary"


def _shipments(docs: DataFrame, length: int, group_bytes: int | None, shard_bytes: int, hot: int, groups: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The grouped documents, and what each group gets back: marks of its fingerprints and answers to its stretches."""
    size, seed = size_hint(docs), SEED_BYTES * length // LENGTH
    per_group = group_bytes or min(max(size // 1000, GROUP_BYTES[0]), GROUP_BYTES[1])
    n_groups, n_shards = max(1, -(-size // per_group)), max(1, -(-size // shard_bytes))
    hot = max(hot, n_groups // 8)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal rows get equal numbers, which is all the order within a group needs
    row = F.xxhash64("doc_id", "text")
    grouped = texts.select(F.pmod(F.when(F.col("doc_id").isNull(), row).otherwise(F.xxhash64("doc_id")), F.lit(n_groups)).cast("long").alias("group"), row.alias("row"), "doc_id", "text")

    def fingerprints(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        return _emit([(s, g, a, b) for s, a, b in Group(table, n_shards, length, seed).fingerprints()], [("shard", pa.int64()), ("group", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, np.uint32) for x in table["a"].to_pylist()]
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)).astype(bool) for p, b in zip(prints, table["b"].to_pylist())]
        marks = mark_fingerprints(np.concatenate(prints), np.concatenate(bits), hot)
        cuts = np.cumsum([0, *map(len, prints)])
        return _emit([(g, key[0].as_py(), 0, marks[a:b].tobytes(), b"") for g, a, b in zip(table["group"].to_pylist(), cuts, cuts[1:])], SIDE)

    def stretches(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        group = Group(table, n_shards, length, seed)
        group.select(dict(zip(side["shard"].to_pylist(), side["a"].to_pylist())))
        types = [("shard", pa.int64()), ("group", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary()), ("text", pa.binary())]
        return _emit([(s, key[0].as_py(), a, b, c) for s, a, b, c in group.stretches()], types)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        lengths = [np.frombuffer(x, np.uint16) for x in table["lengths"].to_pylist()]
        ids = np.concatenate([np.frombuffer(expand(x), np.int64) for x in table["ids"].to_pylist()])
        data = np.frombuffer(b"".join(expand(x) for x in table["text"].to_pylist()), np.uint8)
        owners = np.repeat(np.asarray(table["group"]), [len(x) for x in lengths])
        shard = Shard(data, np.concatenate(lengths), ids, length)
        if groups:
            return _emit([(g, key[0].as_py(), 1, a, b"") for g, a in shard.groups(owners, key[0].as_py())], SIDE)
        return _emit([(g, key[0].as_py(), 1, a, b) for g, a, b in shard.answers(owners, ids)], SIDE)

    marks = grouped.groupBy("group").applyInArrow(fingerprints, "shard long, group long, a binary, b binary")
    marks = marks.groupBy("shard").applyInArrow(mark, SIDE_SCHEMA)
    shipped = grouped.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(stretches, "shard long, group long, lengths binary, ids binary, text binary")
    return grouped, marks.unionByName(shipped.groupBy("shard").applyInArrow(answer, SIDE_SCHEMA)), n_shards


def _with_answers(docs: DataFrame, schema: str, rows, *, length: int, group_bytes: int | None, shard_bytes: int, hot: int, groups: bool = False) -> DataFrame:
    """Rows that ``rows(group, answers)`` makes of each group of documents."""
    grouped, side, n_shards = _shipments(docs, length, group_bytes, shard_bytes, hot, groups)
    seed = SEED_BYTES * length // LENGTH

    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        group = Group(table, n_shards, length, seed)
        marks, answers = {}, {}
        for shard, kind, a, b in zip(*(back[c].to_pylist() for c in ("shard", "kind", "a", "b"))):
            if kind:
                answers[shard] = (a, b)
            else:
                marks[shard] = a
        group.select(marks)
        return rows(group, answers)

    return grouped.groupBy("group").cogroup(side.groupBy("group")).applyInArrow(run, schema)


def removal_digests(docs: DataFrame, *, length: int = LENGTH, group_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, hot: int = HOT_GROUPS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Bytes go that lie in a string of ``length`` bytes which also starts in a document with a smaller id; a null id is the
    smallest, rows with one id are one document in this respect. A null or empty text has no bytes; other columns are
    ignored; an empty table gives no rows.
    """

    def rows(group: Group, answers: dict[int, tuple[bytes, bytes]]) -> pa.Table:
        covered, offsets = group.covered(answers), group.offsets
        begin = covered.copy()
        begin[1:] &= ~covered[:-1]
        inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(covered))]
        begin[inner] = covered[inner]
        kept, cut = group.data[~covered], np.concatenate([[0], np.cumsum(sums(~covered, offsets))])
        coded = [sha256(kept[a:b]).hexdigest() for a, b in zip(cut.tolist(), cut[1:].tolist())]
        ids = pa.array(group.ids, mask=group.ids == NO_ID)
        return pa.table([ids, pa.array(np.diff(offsets)), pa.array(sums(covered, offsets)), pa.array(sums(begin, offsets)), pa.array(coded, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_answers(docs, schema, rows, length=length, group_bytes=group_bytes, shard_bytes=shard_bytes, hot=hot)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, group_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, hot: int = HOT_GROUPS) -> DataFrame:
    """The removed runs themselves: ``doc_id, start, end, passage`` in bytes, in the terms of ``removal_digests``."""

    def rows(group: Group, answers: dict[int, tuple[bytes, bytes]]) -> pa.Table:
        covered = group.covered(answers)
        edge = np.zeros(len(covered) + 1, bool)
        edge[group.offsets] = True
        first = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]])[: len(covered)]))
        last = np.flatnonzero(covered & (edge[1:] | ~np.concatenate([covered[1:], [False]])[: len(covered)])) + 1
        doc = owner(first, group.offsets)
        ids = group.ids[doc]
        text = [group.data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(first - group.offsets[doc]), pa.array(last - group.offsets[doc]), pa.array(text, pa.binary())], names=["doc_id", "start", "end", "passage"])

    return _with_answers(docs, "doc_id long, start long, end long, passage binary", rows, length=length, group_bytes=group_bytes, shard_bytes=shard_bytes, hot=hot)


def maximal_repeats(docs: DataFrame, *, length: int = LENGTH, group_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, hot: int = HOT_GROUPS) -> DataFrame:
    """Repeat groups with all their occurrences: ``repeat, length, n_docs, doc_id, start`` in bytes.

    Each group has at least two different documents, and its occurrences have the same ``length`` bytes. A passage
    longer than a stretch (up to ``2 * length`` bytes) shows as overlapping groups with the same documents, which
    ``repeated_spans`` unites; periodic text is cut into stretches by its place. Nulls, empty texts and repeated rows are as in ``removal_digests``.
    """
    rows = lambda group, answers: group.occurrences({s: a for s, (a, _) in answers.items()})
    schema = "repeat long, length long, doc_id long, start long"
    found = _with_answers(docs, schema, rows, length=length, group_bytes=group_bytes, shard_bytes=shard_bytes, hot=hot, groups=True)
    # documents of a group are counted before occurrences meet their count
    docs_of = found.select("repeat", "doc_id").distinct().groupBy("repeat").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return found.join(docs_of, "repeat").select("repeat", "length", "n_docs", "doc_id", "start")
