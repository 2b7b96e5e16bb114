"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors of one label that are equal become one class first. A label with more classes than a leaf holds is split by every
tree: a node's vectors are cut at the median of their projections onto a random direction, and those near the cut, by a
share of how far apart the projections of a just linked pair lie, go to both sides. Cuts are fitted on bounded samples of
the projections of a node's vectors, eight levels in a round; nodes that are still large are split again. The cuts are all
that a round keeps: every scan sends vectors down the trees anew, and none is written again until the trees are done.

Vectors are compared inside leaves, sixteen neighbouring leaves in a task. A node that no cut makes smaller is a dense group
and stays a large leaf. In one tree its hubs are looked for: vectors within half of the linking angle of a hub are all linked with
each other, whatever their number, and are counted instead of compared. What else a large leaf holds is dealt to blocks, and a
task compares two of them. A pair that shares several leaves is counted in the first, so the numbers of links are sums and
no pairs are written. Leaves give stars of linked vectors, whose union are the components.

A vector goes to some leaves of every tree, so leaves are compared in portions that hold a share of the table's bytes each, and
tables and shuffle files that are done with go at once: the disk in use stays a small multiple of the input.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.llm.common import flat, mix
from voltlane.llm.near import components
from voltlane.llm.vectors import as_width, matrix
from voltlane.session import discard, materialise, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY, TREES, MARGIN = 0.93, 8, 0.3
#: classes that a split aims at and that a leaf may hold; levels fitted at a time, on so many projections for each lowest node
LEAF, LARGEST, LEVELS, DRAWN = 512, 1024, 8, 64
#: rounds of splitting; a node whose children keep so much of it on average is a dense group: beyond 0.71, cuts add to the comparisons
ROUNDS, STUCK = 8, 0.65
HUBS, HUB_SAMPLE, HUB_LEAST = 16, 1024, 64
#: binary digits of the number of neighbouring leaves that a task compares
NEIGHBOURS = 4
AMONG = (1 << NEIGHBOURS) - 1
#: bytes of vectors that are moved at once: a share of those of the table, and so many at least
PORTION, PORTION_LEAST = 0.75, 256 << 20
#: bytes of hubs that are sent to every task
HUB_BYTES = 32 << 20
SEED = 13
LINKS = "u long, links long, root long"


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size; rows of zeros stay."""
    top = np.abs(m).max(1, initial=0.0, keepdims=True)
    m = m / np.where(top == 0, 1.0, top)
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def _packed(kind: str):
    """Vectors as bytes with the digest of their values; null for rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            column = batch.column("vector")
            ends, there = np.asarray(column.offsets).astype(np.int64), np.asarray(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("label"))))
            cells = np.asarray(column.values).astype(kind) if len(column.values) else np.zeros(0, kind)
            upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])[ends]
            there = there & np.asarray(column.is_valid()) & (np.diff(upto(~np.isfinite(cells))) == 0) & (np.diff(upto(cells != 0)) > 0)
            wide = cells.astype(np.float64) + 0.0  # no negative zero
            spans = list(zip(ends.tolist(), ends[1:].tolist(), there.tolist()))
            digest = [sha256(wide[a:b]).digest() if ok else None for a, b, ok in spans]
            packed = [cells[a:b].tobytes() if ok else None for a, b, ok in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], ["row", "vec_id", "label", "digest", "vector"])

    return run


def points_of(column: pa.ChunkedArray | pa.Array, kind: str, dims: int = 0) -> np.ndarray:
    """Packed vectors as rows of length one, shorter ones with zeros behind; at least ``dims`` columns."""
    data, ends = flat(column)
    cells, ends = data.view(kind), ends // np.dtype(kind).itemsize
    lengths = np.diff(ends)
    width = max(int(lengths.max(initial=0)), dims)
    if len(lengths) and (lengths == width).all():
        return unit(cells.reshape(len(lengths), width).astype(np.float64))
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(cells)) - np.repeat(ends[:-1], lengths)] = cells
    return unit(out)


def directions(tree: int, levels: int, dims: int) -> np.ndarray:
    """The directions that a tree cuts along at its first levels, as columns."""
    out = np.zeros((dims, levels))
    for depth in range(levels):
        out[:, depth] = np.random.default_rng([SEED, tree, depth]).standard_normal(dims)
    return out / np.sqrt(max(dims, 1))


def overlap(similarity: float, margin: float, dims: int) -> float:
    """Distance from the cut within which a vector goes to both sides."""
    return margin * float(np.sqrt((2 - 2 * similarity) / max(dims, 1)))


def ranges(ends: np.ndarray, kind: pa.DataType, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


class Forest:
    """Trees of cuts, one for each label that is split and each number, as arrays over their nodes.

    The second child of a node follows its first; a leaf has -1. Sizes are estimates from the samples. ``number`` orders the leaves once
    the trees are done: by tree, label and place, and the large ones (dense groups) behind all others.
    """

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, trees: int, dims: int, kind: str, similarity: float, margin: float):
        order = np.argsort(labels)
        self.labels, self.trees, self.dims, self.kind, self.width = labels[order], trees, dims, kind, overlap(similarity, margin, dims)
        n = len(labels) * trees
        self.tree, self.label = np.repeat(np.arange(trees, dtype=np.int16), len(labels)), np.tile(np.arange(len(labels), dtype=np.int32), trees)
        self.size = np.tile(sizes[order].astype(np.float64), trees)
        self.cut, self.child, self.path, self.depth = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.int16)
        self.open, self.dense = np.ones(n, bool), np.zeros(n, bool)
        self.halves = 2 / (1 + margin * np.sqrt((2 - 2 * similarity) * 2 / np.pi))  # a child's share, with what goes to both
        self.levels, self.share, self.number, self.ordinary = np.zeros(n, np.int16), np.zeros(n), None, 0

    def plan(self, leaf: int) -> None:
        """How many levels each open node gets next, and the share of its vectors to fit them on."""
        levels = np.ceil(np.log(np.maximum(self.size / (1.6 * leaf), 1.0)) / np.log(self.halves))
        self.levels = np.where(self.open, np.clip(levels, 1, LEVELS), 0).astype(np.int16)
        self.share = np.where(self.open, DRAWN * 2.0**self.levels / np.maximum(self.size, 1), 0.0)

    def grow(self, fitted: pa.Table, largest: int) -> None:
        """Split nodes by their fitted cuts; open ones without are leaves from now on."""
        node, ends = np.asarray(fitted["node"]), fitted["cut"]
        if (rest := np.setdiff1d(np.flatnonzero(self.open), node)).size:
            self.open[rest], self.dense[rest] = False, True
        cuts, held = (np.asarray(fitted[c].combine_chunks().flatten()) for c in ("cut", "held"))
        first = np.cumsum(length := np.asarray(pc.list_value_length(ends))) - length
        for levels in np.unique(self.levels[node]).tolist():
            which = np.flatnonzero(self.levels[node] == levels)
            at, inner, all_ = node[which], (1 << levels) - 1, (2 << levels) - 1
            cut = cuts[first[which][:, None] + np.arange(inner)]
            held_ = held[(2 * first + np.arange(len(first)))[which][:, None] + np.arange(all_)]  # one for each cut, and one more than cuts
            ids = len(self.cut) + (np.arange(len(at)) * (all_ - 1))[:, None] + np.arange(-1, all_ - 1)
            ids[:, 0] = at
            path, depth = np.zeros(ids.shape, np.uint64), np.zeros(ids.shape, np.int16)
            path[:, 0], depth[:, 0] = self.path[at], self.depth[at]
            for i in range(inner):  # by places in the heap
                bit = np.left_shift(np.uint64(1), np.maximum(62 - depth[:, i], 0).astype(np.uint64))
                path[:, 2 * i + 1], path[:, 2 * i + 2] = path[:, i], path[:, i] | bit
                depth[:, 2 * i + 1] = depth[:, 2 * i + 2] = depth[:, i] + 1
            size = np.where(held_ < 0, -1, held_ * (self.size[at] / np.maximum(np.asarray(fitted["drawn"])[which], 1))[:, None])
            cut_, child = np.full(ids.shape, np.nan), np.full(ids.shape, -1, np.int32)
            cut_[:, :inner] = cut
            child[:, :inner] = np.where(np.isnan(cut), -1, ids[:, 1 : 2 * inner : 2])
            over = (size > largest) & (child < 0)
            dense, open_ = over.copy(), over.copy()
            dense[:, inner:], open_[:, :inner] = False, False
            self.cut[at], self.child[at], self.open[at], self.dense[at] = cut_[:, 0], child[:, 0], False, child[:, 0] < 0
            below = lambda a: a[:, 1:].reshape(-1)
            new = {"tree": np.repeat(self.tree[at], all_ - 1), "label": np.repeat(self.label[at], all_ - 1), "size": below(size), "cut": below(cut_), "child": below(child)}
            new |= {"path": below(path), "depth": below(depth), "open": below(open_), "dense": below(dense)}
            for name, values in new.items():
                setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.levels, self.share = np.zeros(len(self.cut), np.int16), np.zeros(len(self.cut))

    def finish(self) -> None:
        """Number the leaves."""
        self.dense |= self.open
        leaf = np.flatnonzero((self.child < 0) & (self.size >= 0))
        order = leaf[np.lexsort((self.path[leaf], self.label[leaf], self.tree[leaf], self.dense[leaf]))]
        small, large = order[~self.dense[order]], order[self.dense[order]]
        n = np.bincount(self.tree[small], minlength=self.trees)
        room = n + -n % (AMONG + 1)  # neighbours are of one tree
        first = np.cumsum(room) - room
        self.ordinary, self.number = int(room.sum()), np.full(len(self.cut), -1, np.int32)
        self.number[small] = np.arange(len(small)) + (first - (np.cumsum(n) - n))[self.tree[small]]
        self.number[large] = self.ordinary + np.arange(len(large))
        self.tree_of = np.concatenate([np.repeat(np.arange(self.trees), room), self.tree[large]])
        for name in ("label", "size", "path", "open", "levels", "share"):
            delattr(self, name)

    def down(self, labels: np.ndarray, points: np.ndarray, tree: int, ahead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and the nodes of one tree without children that they come to, by depth, and the rows' projections from that depth on."""
        n = len(self.labels)
        where = np.minimum(np.searchsorted(self.labels, labels), max(n - 1, 0))
        rows = np.flatnonzero(self.labels[where] == labels) if n else np.zeros(0, np.int64)
        nodes = where[rows] + tree * n  # roots are the first nodes
        if not len(rows):
            return
        along = points @ directions(tree, int(self.depth[self.tree == tree].max()) + ahead, self.dims)
        depth = 0
        while len(rows):
            child = self.child[nodes]
            ended = child < 0
            if ended.any():
                yield rows[ended], nodes[ended], along[rows[ended], depth:]
                rows, nodes, child = rows[~ended], nodes[~ended], child[~ended]
            if len(rows):
                x = along[rows, depth] - self.cut[nodes]
                left, right = x <= self.width, x >= -self.width
                rows, nodes, depth = np.concatenate([rows[left], rows[right]]), np.concatenate([child[left], child[right] + 1]), depth + 1


def _draw(forest: Forest):
    """Projections of a sample of each open node's vectors, for the levels it gets; the draw is a hash of the row and the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, labels, points = np.asarray(batch.column("u")).astype(np.uint64), np.asarray(batch.column("label")), points_of(batch.column("vector"), forest.kind, forest.dims)
            for tree in range(forest.trees):
                for rows, nodes, along in forest.down(labels, points, tree, ahead=LEVELS):
                    drawn = mix(mix(u[rows]) + nodes.astype(np.uint64)) >> np.uint64(34)
                    keep = drawn < forest.share[nodes] * (1 << 30)
                    levels = forest.levels[nodes]
                    for n in np.unique(levels[keep]).tolist():
                        some = keep & (levels == n)
                        values = np.ascontiguousarray(along[some, :n])
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int32()), ranges(np.arange(len(values) + 1) * n, pa.float64(), values.reshape(-1))], ["node", "along"])

    return run


def _fit(width: float):
    """The cuts of a node's next levels from a sample of its vectors' projections, and how many of the sample each node holds.

    Both in heap order; a node that cuts make hardly smaller has none (NaN), and nothing below it.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        along, cut, held = matrix(table["along"]), [], []
        rows = [np.arange(len(along))]
        for level in range(along.shape[1]):
            below = []
            for inside in rows:
                x = along[inside, level] if inside is not None else np.zeros(0)
                at = float(np.median(x)) if len(x) else 0.0
                sides = x <= at + width, x >= at - width
                stuck = inside is None or sum(map(np.count_nonzero, sides)) > 2 * STUCK * len(x)
                cut.append(np.nan if stuck else at)
                below += [None, None] if stuck else [inside[side] for side in sides]
            held += [-1 if r is None else len(r) for r in rows]
            rows = below
        held += [-1 if r is None else len(r) for r in rows]
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([len(along)], pa.int64())]
        return pa.table([*columns, pa.array([cut], pa.list_(pa.float64())), pa.array([held], pa.list_(pa.int64()))], names=["node", "drawn", "cut", "held"])

    return run


def _place(forest: Forest, spread: int):
    """Each class with the ordinary leaves it is in, by tree, and the dense ones. A label that is not split is a leaf below zero, by its hash.

    Neighbouring leaves are one number: their common one, and in the low digits a bit for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, trees = batch.num_rows, forest.trees
            labels, points = np.asarray(batch.column("label")), points_of(batch.column("vector"), forest.kind, forest.dims)
            rows, found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for tree in range(trees):
                for inside, nodes, _ in forest.down(labels, points, tree):
                    rows, found, of = [*rows, inside], [*found, forest.number[nodes]], [*of, np.full(len(inside), tree)]
            rows, found, of = np.concatenate(rows), np.concatenate(found), np.concatenate(of)
            whole = np.flatnonzero(~np.isin(labels, forest.labels))
            least = -((mix(labels[whole].astype(np.uint64)) % np.uint64(spread)).astype(np.int64) + 1) << NEIGHBOURS
            rows, found, of = np.concatenate([rows, whole]), np.concatenate([found, least.astype(np.int32)]), np.concatenate([of, np.zeros(len(whole), np.int64)])
            order = np.lexsort((found, of, rows))
            rows, found, of = rows[order], found[order], of[order]
            dense = found >= forest.ordinary
            ends = lambda place, size: np.concatenate([[0], np.cumsum(np.bincount(place, minlength=size))])
            list_, leaf = (rows * trees + of)[~dense], found[~dense].astype(np.int64)
            first = np.flatnonzero(np.diff(list_, prepend=-1) | np.diff(leaf >> NEIGHBOURS, prepend=0))
            bits = np.add.reduceat(1 << (leaf & AMONG), first) if len(first) else leaf
            leaves = ranges(ends(list_[first], n * trees), pa.int64(), (leaf[first] >> NEIGHBOURS << (1 << NEIGHBOURS)) + bits)
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * trees, pa.int32()), leaves)
            columns = [*(batch.column(c) for c in ("u", "label", "copies", "vector")), leaves, ranges(ends(rows[dense], n), pa.int32(), found[dense])]
            yield pa.RecordBatch.from_arrays(columns, ["u", "label", "copies", "vector", "leaves", "dense"])

    return run


def grown(classes: DataFrame, kind: str, *, similarity: float, trees: int, margin: float, leaf: int, largest: int) -> tuple[Forest, int]:
    """The fitted trees of all labels with more than ``largest`` of the classes ``u, label, copies, vector``, and the number of classes in others."""
    sizes = materialise(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("bytes")), "sizes")
    large = sizes.where(F.col("n") > largest).toArrow()
    rest, size = sizes.agg(F.sum(F.when(F.col("n") <= largest, F.col("n"))), F.max("bytes")).first()
    forest = Forest(np.asarray(large["label"]), np.asarray(large["n"]), trees, (size or 0) // np.dtype(kind).itemsize, kind, similarity, margin)
    for _ in range(ROUNDS):
        if not forest.open.any():
            break
        forest.plan(leaf)
        drawn = classes.select("u", "label", "vector").mapInArrow(_draw(forest), "node int, along array<double>")
        cuts = materialise(drawn.groupBy("node").applyInArrow(_fit(forest.width), "node int, drawn long, cut array<double>, held array<long>"), "cuts")
        forest.grow(cuts.toArrow(), largest)
        discard(cuts)
    forest.finish()
    discard(sizes)
    return forest, rest or 0


def _hubs(cosine: float, kind: str):
    """Vectors of a sample that have many others around them, one after the other among what the earlier ones leave."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        points, u = points_of(table["vector"], kind), np.asarray(table["u"])
        near = points @ points.T >= cosine
        left, found = np.ones(len(points), bool), []
        for _ in range(HUBS):
            around = (near & left).sum(1) * left
            best = int(around.argmax()) if len(around) else 0
            if not len(around) or around[best] < HUB_LEAST:
                break
            found.append(int(best))
            left &= ~near[best]
        at = pa.array(found, pa.int64())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int32()), table["u"].take(at), table["vector"].take(at)], names=["leaf", "hub", "hub_vector"])

    return run


def _nearest_hub(cosine: float, kind: str):
    """The hubs within reach of each vector, of those that its rows list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = points_of(batch.column("vector"), kind)
            hubs = points_of(batch.column("hub_vector"), kind, points.shape[1])
            points = as_width(points, hubs.shape[1])
            keep = pa.array((points * hubs).sum(1) >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("hub").filter(keep)], ["u", "hub"])

    return run


def cores(placed: DataFrame, upto: int, *, similarity: float, kind: str) -> DataFrame:
    """``u, core``: classes within half of the linking angle of a hub, so that any two of one core are linked.

    Hubs come from samples of the large leaves of one tree, numbered below ``upto``; a class within reach of several belongs to the least.
    """
    half = float(np.cos(np.arccos(similarity) / 2 - 1e-7))
    within = placed.select("u", F.explode("dense").alias("leaf"), "vector").where(F.col("leaf") < upto)
    sizes = materialise(within.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")), "dense")
    drawn = F.pmod(F.xxhash64("u", "leaf"), F.lit(1 << 30)) / float(1 << 30) < HUB_SAMPLE / F.col("size")
    sample = within.join(sizes, "leaf").where(drawn).select("leaf", "u", "vector")
    hubs = materialise(sample.groupBy("leaf").applyInArrow(_hubs(half, kind), "leaf int, hub long, hub_vector binary"), "hubs")
    bytes_, = hubs.agg(F.sum(F.octet_length("hub_vector") + 64)).first()
    hubs = F.broadcast(hubs) if (bytes_ or 0) <= HUB_BYTES else hubs
    near = within.join(hubs, "leaf").select("u", "vector", "hub", "hub_vector").mapInArrow(_nearest_hub(half, kind), "u long, hub long")
    out = materialise(near.groupBy("u").agg(F.min("hub").alias("core")), "cores")
    discard(sizes)
    return out


def _pairs(points: np.ndarray, block: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of points, or those between two blocks. Products in single precision leave out the others; near the limit doubles decide."""
    short, error = points.astype(np.float32), (points.shape[1] + 8) * 2.0**-22
    if block is None:
        score = short @ short.T
        i, j = np.divmod(np.flatnonzero(score >= similarity - error), max(len(points), 1))
        i, j = i[i < j], j[i < j]
        sure = score[i, j] >= similarity + error
    else:
        rows, cols = np.flatnonzero(block), np.flatnonzero(~block)
        score = short[rows] @ short[cols].T
        i, j = np.divmod(np.flatnonzero(score >= similarity - error), max(len(cols), 1))
        sure = score[i, j] >= similarity + error
        i, j = rows[i], cols[j]
    close = np.flatnonzero(~sure)
    for part in np.split(close, range(1 << 15, len(close), 1 << 15)):
        sure[part] = (points[i[part]] * points[j[part]]).sum(1) >= similarity
    return i[sure], j[sure]


def _first_met(i: np.ndarray, j: np.ndarray, leaves: np.ndarray, here: int, dense: np.ndarray | None = None) -> np.ndarray:
    """Which pairs have no leaf before this one in common. ``leaves`` has the numbers and bits of each row's, -1 behind; ``dense`` its large ones."""
    shift = 1 << NEIGHBOURS
    if dense is None:
        same, among = here >> NEIGHBOURS, (1 << (here & AMONG)) - 1
        group = leaves >> shift
        earlier = np.where((leaves >= 0) & (group < same), leaves, np.where(group == same, (group << shift) + (leaves & among), 0))
    else:
        earlier = np.maximum(leaves, 0)
        large = np.where((dense >= 0) & (dense < here), (dense + (1 << 28) << shift) + 1, 0)  # behind all neighbours' numbers, with one bit
        earlier = np.concatenate([earlier, large], 1)
    low = (1 << shift) - 1
    earlier = earlier[:, (earlier & low).any(0)]
    new = np.ones(len(i), bool)
    for first in range(0, len(i), 1 << 16):
        left = np.arange(first, min(first + (1 << 16), len(i)))
        for c in range(earlier.shape[1]):
            a, b = earlier[i[left], c][:, None], earlier[j[left]]
            met = ((a >> shift == b >> shift) & (a & b & low != 0)).any(1)
            new[left[met]] = False
            left = left[~met]
            if not len(left):
                break
    return new


def _stars(i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that each row reaches by links."""
    best = names.copy()
    while True:
        least = np.minimum(best[i], best[j])
        before = best.copy()
        np.minimum.at(best, i, least)
        np.minimum.at(best, j, least)
        if (best == before).all():
            return best


def _links(u: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Rows ``u, links, root`` of the classes that pairs link."""
    links = np.bincount(i, copies[j], len(u)) + np.bincount(j, copies[i], len(u))
    some = links > 0
    return pa.table([u[some], links[some].astype(np.int64), _stars(i, j, u)[some]], names=["u", "links", "root"])


def _listed(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists as rows, -1 behind."""
    column = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = np.asarray(column.flatten())
    out = np.full((n, int(lengths.max(initial=0))), -1, np.int64)
    out[np.repeat(np.arange(n), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _compare(similarity: float, kind: str):
    """Links of each class inside neighbouring leaves, and the least class it reaches in each; rows without a vector name a class's core."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        note = table["vector"].is_null()
        notes, table = table.filter(note), table.filter(pc.invert(note))
        u, label, copies = (np.asarray(table[c]) for c in ("u", "label", "copies"))
        points, leaves = points_of(table["vector"], kind), _listed(table["leaves"], len(u))
        core = np.full(len(u), -1, np.int64)
        if notes.num_rows:
            order = np.argsort(names := np.asarray(notes["u"]))
            at = np.minimum(np.searchsorted(names[order], u), len(names) - 1)
            core = np.where(names[order][at] == u, np.asarray(notes["core"])[order][at], -1)
        out = []
        if bucket < 0:
            order = np.argsort(label, kind="stable")
            groups = [(0, part) for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)]
        else:
            row, place = np.nonzero(leaves >> (1 << NEIGHBOURS) == bucket)
            bits = leaves[row, place]
            groups = [((bucket << NEIGHBOURS) + k, row[bits >> k & 1 == 1]) for k in range(1 << NEIGHBOURS)]
        for leaf, members in groups:
            i, j = _pairs(points[members], None, similarity)
            inside = core[members]
            apart = (inside[i] != inside[j]) | (inside[i] < 0)
            i, j = i[apart], j[apart]
            if bucket >= 0 and len(i):
                new = _first_met(i, j, leaves[members], leaf)
                i, j = i[new], j[new]
            if len(i):
                out.append(_links(u[members], copies[members], i, j))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["u", "links", "root"])

    return run


def _compare_blocks(similarity: float, kind: str):
    """Links of each class between two blocks of a large leaf, or inside one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, x, y = (k.as_py() for k in key)
        u, copies, core, block = (np.asarray(table[c]) for c in ("u", "copies", "core", "block"))
        points, leaves, dense = points_of(table["vector"], kind), _listed(table["leaves"], len(u)), _listed(table["dense"], len(u))
        i, j = _pairs(points, None if x == y else block == x, similarity)
        apart = (core[i] != core[j]) | (core[i] < 0)
        i, j = i[apart], j[apart]
        new = _first_met(i, j, leaves, leaf, dense)
        return _links(u, copies, i[new], j[new])

    return run


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def portions(rows: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Ranges of places whose rows add up to about ``limit`` each."""
    part = (np.cumsum(rows) - 1) // max(int(limit), 1)
    edge = np.flatnonzero(np.diff(part, prepend=-1)) if len(rows) else np.zeros(0, int)
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(rows)]))


def leaf_links(placed: DataFrame, forest: Forest, noted: DataFrame | None, *, similarity: float, limit: float, write: Callable[[DataFrame], None]) -> None:
    """``u, links, root`` inside the ordinary leaves, without those inside a core, in portions of about ``limit`` rows."""
    shift = 1 << NEIGHBOURS
    near = placed.select(F.explode(F.flatten("leaves")).alias("leaf")).groupBy(F.shiftright("leaf", shift).alias("bucket"))
    counts = near.agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("bucket")
    bucket = np.asarray(counts["bucket"])
    for first, end in portions(np.asarray(counts["n"]), limit):
        low, high = int(bucket[first]), int(bucket[end - 1])
        ordinary = [min(max(x, 0), forest.ordinary - 1) for x in (low << NEIGHBOURS, (high << NEIGHBOURS) + AMONG)]
        a, b = (int(forest.tree_of[x]) for x in ordinary) if forest.ordinary else (0, 0)
        these = F.col("leaves")[a] if a == b else F.flatten(F.slice("leaves", a + 1, b - a + 1))
        inside = lambda rows, *names: rows.select(*names, F.explode(these).alias("leaf")).withColumn("bucket", F.shiftright("leaf", shift)).where(F.col("bucket").between(low, high)).drop("leaf")  # noqa: B023, E731
        upto = F.flatten(F.slice("leaves", 1, b + 1)).alias("upto")
        rows = inside(placed, "u", "label", "copies", "vector", upto).withColumnRenamed("upto", "leaves")
        rows = rows.withColumn("core", F.lit(None).cast("long"))
        if noted is not None:
            rows = rows.unionByName(inside(noted, "u", "core"), allowMissingColumns=True)
        write(rows.groupBy("bucket").applyInArrow(_compare(similarity, forest.kind), LINKS))


def block_links(placed: DataFrame, core: DataFrame, *, similarity: float, kind: str, largest: int, limit: float, write: Callable[[DataFrame], None]) -> None:
    """The same inside the large leaves, by pairs of blocks."""
    dense = placed.where(F.size("dense") > 0)
    members = dense.select("u", F.explode("dense").alias("leaf")).join(core, "u", "left").withColumn("core", F.coalesce("core", F.lit(-1).cast("long")))
    parts = members.groupBy("leaf", "core").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / largest).cast("int").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("core"))
    whole = F.sum("n").over(Window.partitionBy("leaf"))
    # numbers of blocks: each core of a leaf has its own, so that blocks of one core need not meet
    parts = materialise(parts.select("leaf", "core", "size", "n", (upto - F.col("n")).alias("first"), whole.alias("all")), "parts")
    dealt = members.join(parts, ["leaf", "core"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("u"), F.col("n"))).cast("int"))
    dealt = materialise(dealt, "dealt")
    total, = parts.agg(F.sum(F.col("size") * (F.col("all") - F.when(F.col("core") < 0, 0).otherwise(F.col("n"))))).first()
    others = F.expr("filter(sequence(0, CAST(`all` AS INT) - 1), m -> core < 0 OR m < first OR m >= first + n)")
    met = dealt.withColumn("m", F.explode(others)).select("u", "leaf", "core", "block", F.least("block", "m").alias("x"), F.greatest("block", "m").alias("y"))
    number = -(-(total or 0) // max(int(limit), 1))
    for k in range(number):
        rows = met.where(F.pmod(F.xxhash64("leaf", "x", "y"), F.lit(number)) == k)
        rows = rows.join(dense.select("u", "copies", "vector", F.flatten("leaves").alias("leaves"), "dense"), "u")
        write(rows.groupBy("leaf", "x", "y").applyInArrow(_compare_blocks(similarity, kind), LINKS))
    discard(dealt)
    discard(parts)


def near_vectors(embeddings: DataFrame, *, similarity: float = SIMILARITY, trees: int = TREES, margin: float = MARGIN, largest: int = LARGEST) -> DataFrame:
    """One row per row of ``embeddings``: ``vec_id, n_links, component_id, kept``.

    Links join rows of one label with a cosine of ``similarity`` or more; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id that links lead to, and a row is kept if that is its own. Pairs are found in the leaves of the
    forest and never linked below ``similarity``; labels with up to ``largest`` different vectors are compared whole.

    Rows with a null id or label, or a vector that is null, all zeros, empty, or holds a null or a component that isn't finite,
    link with nothing and are kept. Repeated rows link with each other. An empty table gives no rows; other columns are ignored.
    """
    with _shuffles_end(embeddings.sparkSession):
        return _near_vectors(embeddings, similarity, trees, margin, largest)


def _near_vectors(embeddings: DataFrame, similarity: float, trees: int, margin: float, largest: int) -> DataFrame:
    spark = embeddings.sparkSession
    short = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, vector = ("<f4", F.col("embedding")) if short else ("<f8", F.col("embedding").cast("array<double>"))
    wide = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    wide = materialise(wide.mapInArrow(_packed(kind), "row long, vec_id long, label long, digest binary, vector binary"), "rows")
    marked = materialise(wide.drop("vector"), "marked")
    known = marked.where("digest IS NOT NULL")
    equal = known.groupBy("label", "digest").agg(F.min("row").alias("u"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    equal = materialise(equal, "equal")
    count, = equal.agg(F.count(F.lit(1))).first()
    n, size = wide.agg(F.count(F.lit(1)), F.avg(F.octet_length("vector"))).first()
    row_bytes = 16 * trees + 48 + (size or 0)
    limit = max(PORTION * count, PORTION_LEAST / row_bytes)

    path, parts = shared_path(spark, "classes"), 1 if n * row_bytes <= PORTION_LEAST else 4
    for k in range(parts):
        share = lambda rows: rows.where(F.pmod(F.xxhash64("u"), F.lit(parts)) == k)  # noqa: B023, E731
        kept = share(wide.select(F.col("row").alias("u"), "vector")).join(share(equal.select("u", "label", "copies")), "u")
        kept.write.mode("append").parquet(path)
    classes = spark.read.schema(kept.schema).parquet(path)
    discard(wide)

    forest, rest = grown(classes, kind, similarity=similarity, trees=trees, margin=margin, leaf=LEAF, largest=largest)
    placed = classes.mapInArrow(_place(forest, max(1, rest // (4 * largest))), "u long, label long, copies long, vector binary, leaves array<array<long>>, dense array<int>")
    placed = materialise(placed, "placed")
    discard(classes)

    found, n_found = shared_path(spark, "links"), 0

    def write(links: DataFrame) -> None:
        nonlocal n_found
        links.write.mode("append").parquet(found)
        n_found += 1

    core = noted = spark.createDataFrame([], "u long, core long")
    some = len(forest.tree_of) > forest.ordinary
    if some:
        first = forest.ordinary + int((forest.tree_of[forest.ordinary :] == 0).sum())
        core = cores(placed, first, similarity=similarity, kind=kind)
        noted = materialise(placed.select("u", "leaves").join(core, "u"), "noted")
        block_links(placed, core, similarity=similarity, kind=kind, largest=largest, limit=limit, write=write)
    leaf_links(placed, forest, noted if some else None, similarity=similarity, limit=limit, write=write)
    links = spark.read.schema(LINKS).parquet(found) if n_found else spark.createDataFrame([], LINKS)
    discard(placed)

    tight = core.join(equal.select("u", "copies"), "u").groupBy("core").agg(F.sum("copies").alias("inside"))
    edges = links.select(F.col("u").alias("a"), F.col("root").alias("b")).unionByName(core.select(F.col("u").alias("a"), F.col("core").alias("b")))
    joined = components(edges)

    totals = links.groupBy("u").agg(F.sum("links").alias("links"))
    named = equal.join(joined.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    named = named.join(totals, "u", "left").join(core.join(tight, "core"), "u", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("inside", F.col("copies")) - 1
    named = materialise(named.select("label", "digest", "component", "least_id", n_links.cast("long").alias("n_links")), "named")
    discard(equal)
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.select("row", "label", "digest").join(named.join(ids, "component"), ["label", "digest"]).select("row", "n_links", "component_id")
    out = marked.select("row", "vec_id").join(known, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
