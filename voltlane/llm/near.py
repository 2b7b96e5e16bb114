"""Near duplicates by DartMinHash signatures of word shingles, banded joining and an exact check.

Every shingle with weight ``w`` owns ``w`` unit regions. Each region has a Poisson stream of darts at times fixed by hashing
the region, so the same region of two documents gets the same darts. A document throws all darts up to a time that
yields a set number in total, each dart falls on one coordinate, and the earliest dart of a coordinate is its value:
two documents agree on a coordinate with the probability of their weighted Jaccard similarity. The work is about the
number of shingles plus the number of darts, whatever the weights.

Equal shingle multisets become one class first. Classes that agree on a band are compared: all of them in small
buckets, in large ones each with the bucket's least first, which is linear. In large buckets that stay apart those that are
not with the least then meet all others, a block with a block, by their sketches and then by their shingles. Each class is
first compared with one other only, and pairs that are by then in one group are never compared. A pair passes on the
exact similarity of its shingles. Groups are connected components, found by stars that shrink, so no group is gathered.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import flat, fresh, mix, owner, pieces, prefix_hash, slice_hash, sums, word_bounds
from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS, SIMILARITY, BANDS, ROWS, SMALL_BUCKET = 5, 0.8, 20, 4, 16
#: members and shingles, about, of one block of a large bucket
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 21


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of ``size`` words, by document; a shorter text is one shingle, one without words none."""
    starts, ends = word_bounds(data, offsets)
    doc = owner(starts, offsets)
    words = slice_hash(prefix_hash(data), starts, ends)
    n_docs = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(per_doc) - per_doc
    # running hash over word hashes; the two constants keep order and length apart
    hashes = np.zeros(len(words), np.uint64)
    for k in range(size):
        inside = np.arange(len(words)) + k < (first + per_doc)[doc]
        ahead = np.minimum(np.arange(len(words)) + k, max(len(words) - 1, 0))
        hashes = np.where(inside, mix(hashes * np.uint64(0x9FB21C651E98DF25) + words[ahead]), hashes)
    place = np.arange(len(words)) - first[doc]
    keep = place <= np.maximum(per_doc[doc] - size, 0)
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n_docs))])


def weighted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, element and weight (its count) of the distinct shingles, in order of document and element."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """``k`` values per document: the earliest dart of each coordinate. A document without elements keeps zeros."""
    region = np.repeat(np.arange(len(element)), weight)
    part = np.arange(len(region)) - np.repeat(np.cumsum(weight) - weight, weight)
    seed = mix(element[region] + mix(part.astype(np.uint64) + np.uint64(1)))
    own = doc[region]
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    values, times = np.zeros((n_docs, k), np.uint64), np.full((n_docs, k), np.inf)
    # so many darts leave a coordinate empty once in e**2 documents times k; those throw on
    high = (k * np.log(k) + 2 * k) / np.maximum(total, 1)
    open_docs = total > 0
    clock, turn = np.zeros(len(region)), np.zeros(len(region), np.uint64)
    pending = np.arange(len(region))  # regions whose next dart is not yet thrown
    upcoming = np.full(len(region), -1.0)
    while open_docs.any():
        active = pending[open_docs[own[pending]]]
        while len(active):
            new = active[upcoming[active] < 0]
            u = (mix(seed[new] + turn[new] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5
            upcoming[new] = clock[new] - np.log(u / float(1 << 53))
            hit = active[upcoming[active] < high[own[active]]]
            if not len(hit):
                break
            value = mix(seed[hit] ^ mix(turn[hit] + np.uint64(0xD1B54A32D192ED03)))
            coordinate = ((value >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            at = upcoming[hit]
            cell = own[hit] * k + coordinate
            order = np.lexsort((value, at, cell))
            firsts = order[np.concatenate([[True], cell[order][1:] != cell[order][:-1]])]
            better = firsts[at[firsts] < times.reshape(-1)[cell[firsts]]]
            times.reshape(-1)[cell[better]] = at[better]
            values.reshape(-1)[cell[better]] = value[better]
            clock[hit], turn[hit], upcoming[hit] = at, turn[hit] + np.uint64(1), -1.0
            active = hit
        # a document is done when each coordinate has a dart; later darts can only be later
        open_docs = open_docs & np.isinf(times).any(1)
        high = np.where(open_docs, 2 * high, high)
    return values


def signature_bands(docs: DataFrame, *, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest, weight, sketch, bands``: a hash of the shingle multiset, its total weight, one byte of each
    coordinate, and one key per band.

    Without words the digest is null and there are no bands.
    """
    schema = "doc_id long, digest binary, weight long, sketch binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            n = piece.num_rows
            doc, element, weight = weighted(*shingles(*flat(piece.column(1)), size))
            total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
            # an order-free sum of scrambled elements, twice: equal multisets have equal digests
            both = []
            for salt in (0x8CB92BA72F3D8DD7, 0xDB4F0B9175AE2165):
                terms = mix(element ^ np.uint64(salt)) * weight.astype(np.uint64)
                sums = np.zeros(n, np.uint64)
                np.add.at(sums, doc, terms)
                both.append(sums)
            digest = np.stack(both, 1).tobytes()
            values = dart_signatures(doc, element, weight, n, bands * rows).reshape(n, bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + values[:, :, r])
            some = total > 0
            cells = pa.array([digest[16 * i : 16 * i + 16] if some[i] else None for i in range(n)], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)), pa.array(keys[some].reshape(-1).view(np.int64)))
            low = np.ascontiguousarray((values & np.uint64(255)).astype(np.uint8)).reshape(n, -1)
            sketch = pa.array([x.tobytes() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), cells, pa.array(total), sketch, listed], ["doc_id", "digest", "weight", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def bucket_pairs(keys: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``a < b`` of ``key, node`` rows, and the large buckets ``key, hub``.

    Up to ``small`` members of a bucket all meet; in a larger one each meets the least, its hub.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    sizes = materialise(sizes, "buckets")
    line = Window.partitionBy("key").orderBy("node")  # of small buckets
    few = keys.join(sizes.where(F.col("n") <= small).select("key"), "key")
    others = F.array_compact(F.array(*[F.lag("node", i).over(line) for i in range(1, small)]))
    few = few.select("node", others.alias("others")).select("node", F.explode("others").alias("other"))
    large = sizes.where(F.col("n") > small).select("key", "hub", "n")
    many = keys.join(large, "key").select("node", F.col("hub").alias("other"))
    pairs = few.unionByName(many).where("node <> other")
    return pairs.select(*_ordered(F.col("node"), F.col("other"))).distinct(), large


def likely(pairs: DataFrame, heads: DataFrame, similarity: float, coordinates: int) -> DataFrame:
    """Pairs whose weights allow the similarity and whose sketches are within six deviations of it."""
    side = lambda n: heads.select(F.col("node").alias(n), F.col("weight").alias(f"w{n}"), F.col("sketch").alias(f"s{n}"))
    weights = F.least("wa", "wb") >= similarity * F.greatest("wa", "wb") - 1e-9
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(weights).select("a", "b", "sa", "sb")
    least = int(similarity * coordinates - 6 * np.sqrt(similarity * (1 - similarity) * coordinates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (flat(batch.column(c))[0].reshape(batch.num_rows, -1) for c in (2, 3))
            mask = pa.array((left == right).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` whose weighted Jaccard similarity, computed from their shingle sets, reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                ea, eb = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32) for c in (2, 4))
                ca, cb = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in (3, 5))
                ca, cb = (np.ones(len(e), np.int64) if not len(c) else c for e, c in ((ea, ca), (eb, cb)))
                _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                common = int(np.minimum(ca[ia], cb[ib]).sum())
                keep.append(common >= similarity * (int(ca.sum()) + int(cb.sum()) - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], ["a", "b"])

    return both.select("a", "b", "ea", "ca", "eb", "cb").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, elements, counts`` for the wanted nodes: their distinct shingles, hashed to 32 bits, in order, and how
    often each occurs (empty: once). Of rows with one id but different texts the same one is always taken.

    The one place where texts are moved: by sorting, however few are wanted, so the plan is the same at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, ends = shingles(*flat(piece.column(1)), size)
            doc, element, weight = weighted(hashes >> np.uint64(32), ends)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=piece.num_rows))]).tolist()
            cells = [element[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:])]
            counts = [weight[a:b].astype(np.uint32).tobytes() if (weight[a:b] > 1).any() else b"" for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["node", "elements", "counts"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL").join(wanted.hint("merge"), "node", "left_semi")
    sets = chosen.mapInArrow(run, "node long, elements binary, counts binary")
    return sets.groupBy("node").agg(F.min(F.struct("elements", "counts")).alias("s")).select("node", "s.*")


def _settled(links: DataFrame) -> bool:
    """Whether ``a < b`` links are stars: every ``b`` has one ``a``, which is no ``b`` itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))).alias("e"))
    roles = ends.groupBy("e.node").agg(F.sum("e.leaf").alias("parents"), F.min("e.leaf").alias("role"))
    return not roles.where("parents > 1 OR (parents = 1 AND role = 0)").take(1)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for the nodes of ``a, b`` edges other than the components' smallest nodes, which name them.

    Large-star and small-star steps in turn: every node is linked to the least node it knows of, until only stars are left.
    """
    links = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        if _settled(links):
            return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = materialise(large, "links").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        links = materialise(small.select(F.col("m").alias("a"), "b").distinct(), "links")
    raise RuntimeError("components did not settle")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that are not yet in one component."""
    side = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _with(links: DataFrame, found: DataFrame) -> DataFrame:
    """Components after more links between nodes that were apart: the links join components as wholes."""
    links = materialise(links, "links")
    if not links.take(1):
        return found
    side = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    whole = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(whole)  # of components, none of which is a node of ``found``
    moved = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialise(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(joined), "components")


def _open_pairs(table: pa.Table, similarity: float, least: int, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and a mask of the pairs of two blocks to compare, in pieces of about ``cells``: in different components, of weights and
    sketches that allow the similarity, and without an earlier band in common, in whose bucket they meet as well.
    """
    component, weight, block = (np.asarray(table[c]) for c in ("component", "weight", "block"))
    sketch, earlier = (flat(table[c])[0] for c in ("sketch", "earlier"))
    sketch = sketch.reshape(table.num_rows, -1)
    earlier = earlier.view(np.int64).reshape(table.num_rows, -1)
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    step = max(1, cells // max(len(right), 1))
    for p in range(0, len(left), step):
        rows = left[p : p + step]
        cols = right if x != y else right[p:]
        mask = component[rows, None] != component[None, cols]
        if x == y:
            mask &= rows[:, None] < cols[None, :]
        mask &= np.minimum(weight[rows, None], weight[None, cols]) >= similarity * np.maximum(weight[rows, None], weight[None, cols]) - 1e-9
        for c in range(earlier.shape[1]):
            mask &= earlier[rows, c, None] != earlier[None, cols, c]
        some, any_ = mask.any(1), mask.any(0)
        rows, cols, mask = rows[some], cols[any_], mask[np.ix_(some, any_)]
        if not len(rows):
            continue
        agree = np.zeros(mask.shape, np.uint8 if sketch.shape[1] < 256 else np.uint16)
        for c in range(sketch.shape[1]):
            agree += sketch[rows, c, None] == sketch[None, cols, c]
        mask &= agree >= least
        if mask.any():
            yield rows, cols, mask


def _likely_members(similarity: float, least: int):
    """Members of two blocks that have a pair to compare there."""

    def run(table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, bool)
        for rows, cols, mask in _open_pairs(table, similarity, least):
            keep[rows[mask.any(1)]] = True
            keep[cols[mask.any(0)]] = True
        return table.select(["key", "x", "y", "block", "band", "node", "component"]).filter(pa.array(keep))

    return run


def _block_links(similarity: float, least: int):
    """Links between two blocks, by the exact similarity of every pair to compare that no link found before joins."""

    def run(table: pa.Table) -> pa.Table:
        node, n = np.asarray(table["node"]), table.num_rows
        label = np.unique(np.asarray(table["component"]), return_inverse=True)[1]
        data, ends = flat(table["elements"])
        element, ends = data.view(np.uint32), ends // 4
        times, stops = flat(table["counts"])
        count = np.ones(len(element), np.int64)
        count[np.repeat(np.diff(stops) > 0, np.diff(ends))] = times.view(np.uint32)
        # the k-th occurrence of an element is a token of its own, so the common ones are the sum of the lesser counts
        turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        token = np.unique(np.repeat(element, count).astype(np.uint64) | turn.astype(np.uint64) << np.uint64(32), return_inverse=True)[1].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(count)])[ends]
        length = np.diff(ends)
        mine = np.zeros(int(token.max(initial=-1)) + 1, bool)

        def tokens_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            offsets = np.concatenate([[0], np.cumsum(length[which])])
            return token[np.repeat(ends[which] - offsets[:-1], length[which]) + np.arange(offsets[-1])], offsets

        a, b = [], []
        for rows, cols, mask in _open_pairs(table, similarity, least):
            whole = tokens_of(cols)
            for r, row in enumerate(rows):
                at = np.flatnonzero(mask[r] & (label[cols] != label[row]))
                if not len(at):
                    continue
                mine[token[ends[row] : ends[row + 1]]] = True
                if 4 * len(at) > len(cols):
                    common = sums(mine[whole[0]], whole[1])[at]
                else:
                    listed, offsets = tokens_of(cols[at])
                    common = sums(mine[listed], offsets)
                mine[token[ends[row] : ends[row + 1]]] = False
                for c in cols[at[common >= similarity * (length[row] + length[cols[at]] - common) - 1e-9]]:
                    if label[c] != label[row]:
                        a.append(node[row])
                        b.append(node[c])
                        label[label == label[c]] = label[row]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    return run


def _settle_large(heads: DataFrame, large: DataFrame, found: DataFrame, sets: DataFrame, *, similarity: float, bands: int, rows: int) -> DataFrame:
    """Components after all pairs of large buckets whose members are still apart are compared.

    The members outside the component of the bucket's least, and those in it, are dealt to blocks of bounded rows and shingles. Every
    block of outsiders meets every block, itself included, in a group of its own. A pair is compared in its first common bucket
    only. Sketches go first, alone; the shingles of members that have a likely pair follow.
    """
    least = int(similarity * bands * rows - 6 * np.sqrt(similarity * (1 - similarity) * bands * rows))
    side = lambda n, c: found.select(F.col("node").alias(n), F.col("component").alias(c))
    members = heads.select("node", "weight", F.posexplode("bands").alias("band", "key")).join(large.select("key", "hub"), "key")
    named = members.join(side("node", "component"), "node", "left").join(side("hub", "with"), "hub", "left")
    named = named.withColumns({"component": F.coalesce("component", "node"), "with": F.coalesce("with", "hub")})
    named = named.select("key", "node", "weight", "band", "component", (F.col("component") != F.col("with")).alias("outside"))
    named = materialise(named, "members")

    blocks = lambda where: F.greatest(F.ceil(F.count_if(where) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(where, F.col("weight"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = named.groupBy("key").agg(blocks(F.col("outside")).alias("o"), blocks(~F.col("outside")).alias("i")).where("o > 0")
    dealt = named.join(materialise(sizes, "sizes"), "key")
    dealt = dealt.withColumn("block", F.expr("CAST(IF(outside, pmod(xxhash64(node), o), o + pmod(xxhash64(node), i)) AS INT)"))
    meets = F.expr("transform(sequence(0, IF(outside, o + i, o) - 1), m -> struct(least(m, block) AS x, greatest(m, block) AS y))")
    dealt = dealt.select("key", F.explode(meets).alias("of"), "block", "band", "node", "component").select("key", "of.*", "block", "band", "node", "component")

    packed = heads.select("node", "weight", "sketch", "bands")
    earlier = F.expr("unhex(concat_ws('', transform(slice(bands, 1, band), k -> lpad(hex(k), 16, '0'))))").alias("earlier")
    columns = ("key", "x", "y", "block", "band", "node", "component")
    full = dealt.join(packed, "node").select(*columns, "weight", "sketch", earlier)
    schema = "key long, x int, y int, block int, band int, node long, component long"
    some = materialise(full.groupBy("key", "x", "y").applyInArrow(_likely_members(similarity, least), schema), "likely")
    full = some.join(packed, "node").hint("merge").join(sets, "node").select(*columns, "weight", "sketch", earlier, "elements", "counts")
    links = full.groupBy("key", "x", "y").applyInArrow(_block_links(similarity, least), "a long, b long")
    return _with(links.distinct(), found)


def near_components(docs: DataFrame, marked: DataFrame, *, size: int, similarity: float, bands: int, rows: int, small: int) -> tuple[DataFrame, DataFrame]:
    """The classes ``digest, node`` and the ``node, component`` rows of nodes that have a partner."""
    usable = marked.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    of_class = (usable["digest"] == classes["digest"]) & (usable["doc_id"] == classes["node"])
    heads = usable.join(classes, of_class).select("node", "weight", "sketch", "bands").dropDuplicates(["node"])
    heads = materialise(heads, "heads")
    keys = heads.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    pairs, large = bucket_pairs(keys, small)
    pairs = materialise(likely(pairs, heads, similarity, bands * rows), "pairs")
    large = materialise(large, "large")
    gathered = keys.join(large.select("key"), "key").select("node")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(gathered).distinct()
    sets = materialise(shingle_sets(docs, wanted, size), "sets")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = materialise(components(verified(first, sets, similarity)), "components")
    found = _with(verified(_apart(pairs, found), sets, similarity), found)
    found = _settle_large(heads, large, found, sets, similarity=similarity, bands=bands, rows=rows)
    return classes, found


def near_groups(docs: DataFrame, *, size: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: ``doc_id, class_id, group_id, group_size, kept``.

    ``class_id`` is the least id with the same shingles, ``group_id`` the least id of the near-duplicate group, which stays.
    Texts of fewer words than a shingle are compared whole; texts without words, null included, are groups of their
    own. Rows with a null id are kept and left out of grouping. An empty table gives no rows.
    """
    marked = materialise(signature_bands(docs, size=size, bands=bands, rows=rows), "bands")
    classes, found = near_components(docs, marked, size=size, similarity=similarity, bands=bands, rows=rows, small=small)
    named = classes.join(found, "node", "left").select("digest", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("group_id"))
    known = F.col("doc_id").isNotNull()
    grouped = marked.select("doc_id", "digest").join(named, "digest", "left").select(
        "doc_id", F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("group_id", "doc_id")).alias("group_id"),
    )
    grouped = materialise(grouped, "grouped")
    sizes = grouped.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    out = grouped.join(sizes, "group_id", "left")
    return out.select("doc_id", "class_id", "group_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all columns, of which each near-duplicate group keeps one."""
    (gone,) = fresh(docs, "_gone")
    dropped = near_groups(docs, **settings).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col(gone), "left_anti")
