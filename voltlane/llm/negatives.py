"""Hard negatives by threshold joins over an inverted index of vectors, after L2AP.

Vectors are dealt to blocks. Inside a block the dimensions are put in order of weight and each is a list of the vectors that
are indexed in it. The last dimensions of a vector, whose norm times the longest query's cannot reach the lowest threshold, are
left out of its lists: a pair that meets nowhere else is below the threshold. Lists are read for a group of queries at a
time and partial scores added up; a pair goes as soon as its partial score and the product of the two remaining norms
stay below the query's threshold. What is left of the surviving pairs is then added, so every score that comes back is exact.

A search starts with a high threshold. Windows that have ``k`` partners at or above it are filled, and these are their first;
the others go on with a lower threshold, the last of which is the window's end. A block returns no more than its first ``k`` of a
window, so what is moved follows the number of windows.

Queries and vectors meet in a grid of blocks: a task holds one block of each, whatever the size of the tables.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm import vectors
from voltlane.llm.vectors import as_width, matrix
from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
BLOCK_ROWS, QUERY_ROWS, TOGETHER = 16_384, 16_384, 256
#: thresholds for positives as shares of the longest product, and for windows as shares of their width below their upper end
POSITIVE_STEPS, WINDOW_STEPS = (0.5, 0.35, 0.2), (1 / 64, 1 / 8)
EXACT = 2.0**53
LONG = (1 << 63) - 1


def scaled(raw: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: doubles that hold integers, or Python integers where a score could pass 2**53."""
    with np.errstate(over="ignore"):
        out = np.floor(raw * float(scale))
        longest = (out**2).sum(1).max(initial=0.0)
    if longest < EXACT:
        return out
    cells = [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in raw.ravel().tolist()]
    return np.array(cells, object).reshape(raw.shape)


def _segments(dims: int) -> list[tuple[int, int]]:
    step = max(8, -(-dims // 4))
    return [(a, min(a + step, dims)) for a in range(0, dims, step)]


def _rest(values: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """Norm of what lies behind each segment, with a little to spare for rounding; ``[segment, row]``, the first with all dimensions."""
    squares = np.array([(values[:, a:b] ** 2).sum(1) for a, b in segments]).reshape(len(segments), len(values))
    return np.sqrt(np.vstack([np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, len(values)))])) * (1 + 1e-9)


class InvertedIndex:
    """One block of vectors: dimensions by weight, and for each segment of them the vectors that are listed there."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(-(values**2).sum(0), kind="stable")
        self.values = np.ascontiguousarray(values[:, self.order])
        self.segments = _segments(values.shape[1])
        self.rest = _rest(self.values, self.segments)

    def above(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and score of all pairs whose score is at least the query's threshold."""
        queries = np.ascontiguousarray(queries[:, self.order])
        ahead = _rest(queries, self.segments)
        lowest, longest = least.min(initial=np.inf), ahead[0].max(initial=0.0)
        # dimensions from here on are not listed: alone they stay below every threshold
        listed = (self.rest[:-1] * longest >= lowest).sum(0) if lowest > 0 else np.full(len(self.values), len(self.segments))
        live = np.flatnonzero(listed > 0)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(live) or not len(queries):
            return nothing
        partial = np.zeros((len(queries), len(live)))
        for s, (a, b) in enumerate(self.segments):
            here = listed[live] > s
            if here.all():
                partial += queries[:, a:b] @ self.values[live, a:b].T
            elif here.any():
                partial[:, here] += queries[:, a:b] @ self.values[live[here], a:b].T
            else:
                break
            done = np.minimum(listed[live], s + 1)  # behind this segment, or behind what is listed, nothing is added yet
            if done.min() == done.max():
                bound = np.outer(ahead[done[0]], self.rest[done[0], live])
            else:
                bound = ahead[done].T * self.rest[done, live]
            bound += partial
            alive = bound >= least[:, None]
            some = alive.any(0)
            if not some.all():
                live, partial, alive = live[some], partial[:, some], alive[:, some]
            if not len(live) or alive.mean() < 0.05:
                break
        else:
            if len(live) and listed[live].min() == len(self.segments):  # sums of whole numbers: exact in any order
                q, at = np.nonzero(partial >= least[:, None])
                return q, live[at], partial[q, at]
        if not len(live):
            return nothing
        q, at = np.nonzero(alive)
        score = np.empty(len(q))
        for begin in range(0, len(q), 1 << 16):  # all dimensions again: surviving pairs are few
            part = slice(begin, begin + (1 << 16))
            score[part] = np.einsum("ij,ij->i", queries[q[part]], self.values[live[at[part]]])
        keep = score >= least[q]
        return q[keep], live[at[keep]], score[keep]


def _all_scores(queries: np.ndarray, values: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with Python integers, for components whose products pass 2**53."""
    scores = [[min(max(int(x), -LONG), LONG) for x in row] for row in queries.astype(object) @ values.astype(object).T]
    q, v = np.nonzero([[x >= t for x in row] for row, t in zip(scores, least.tolist())])
    return q, v, np.array([scores[i][j] for i, j in zip(q, v)], np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, ties by id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search_block(k: int, same: bool, scale: int):
    """The first ``k`` of each window among one block of vectors."""

    def run(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if block.num_rows and asked.num_rows:
            values, queries = matrix(block["vector"]), matrix(asked["vector"])
            dims = max(values.shape[1], queries.shape[1])
            values, queries = scaled(as_width(values, dims), scale), scaled(as_width(queries, dims), scale)
            plain = values.dtype != object and queries.dtype != object
            index = InvertedIndex(values) if plain and dims else None
            rows, ids, labels = (np.asarray(block[c]) for c in ("row", "id", "label"))
            q_rows, q_labels = np.asarray(asked["query"]), np.asarray(asked["label"])
            windows = asked["windows"].to_pylist()
            least = np.array([min(w["least"] for w in ws) for ws in windows], np.int64)
            for begin in range(0, len(queries), TOGETHER):
                group = np.argsort(least, kind="stable")[begin : begin + TOGETHER]
                if index is not None:
                    q, v, score = index.above(queries[group], least[group].astype(float))
                else:
                    q, v, score = _all_scores(queries[group], values, least[group])
                mine = group[q]
                keep = ((labels[v] == q_labels[mine]) == same) & (rows[v] != q_rows[mine])
                mine, v, score = mine[keep], v[keep], score[keep].astype(np.int64)
                ends = np.searchsorted(q[keep], np.arange(len(group) + 1))
                for g, one in enumerate(group):
                    part = slice(ends[g], ends[g + 1])
                    for w in windows[one]:
                        inside = np.flatnonzero((score[part] >= w["least"]) & (score[part] <= w["high"])) + ends[g]
                        inside = inside[_first(score[inside], ids[v[inside]], k)]
                        for column, cells in zip(out, (np.full(len(inside), q_rows[one]), np.full(len(inside), w["window"]), rows[v[inside]], ids[v[inside]], score[inside])):
                            column.append(cells)
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        columns[1] = columns[1].astype(np.int32)
        return pa.table(columns, names=["query", "window", "row", "id", "score"])

    return run


def _dealt(index: DataFrame, queries: DataFrame, same: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block, chunk``: each query meets every block, or with ``same`` those that may hold its label."""
    spark = index.sparkSession
    rows, asked = index.count(), queries.count()
    blocks = max(-(-rows // BLOCK_ROWS), spark.sparkContext.defaultParallelism)
    chunks = max(1, -(-asked // QUERY_ROWS))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    if same:  # a label with more rows than a block has several of its own, the others share blocks
        salts = F.ceil(F.count(F.lit(1)) * blocks / max(rows, 1)).cast("int")
        sizes = materialise(index.groupBy("label").agg(salts.alias("salts")), "labels")
        block = lambda salt: F.when(F.col("salts") > 1, F.xxhash64("label", salt)).otherwise(place("label", blocks)).alias("block")
        left = index.join(sizes, "label").select("*", block(place("row", F.col("salts")).cast("int"))).drop("salts")
        right = queries.join(sizes, "label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        right = right.select("*", block(F.col("salt"))).drop("salts", "salt")
    else:
        left = index.withColumn("block", place("row", blocks))
        right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    return left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), right.withColumn("chunk", place("query", chunks).cast("int"))


def first_in_windows(index: DataFrame, queries: DataFrame, windows: DataFrame, thresholds: list[Column], *, k: int, same: bool, scale: int = SCALE) -> DataFrame:
    """``query, window, place, row, id, score``: the first ``k`` rows of each window ``query, window, low, high`` by score.

    ``thresholds`` are expressions over the columns of ``windows``, tried in turn until a window is filled; ``low`` comes last.
    Partners have the query's label with ``same`` and another one without; a row is no partner of itself.
    """
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id", "row")
    filled, open_ = [], windows
    for step, threshold in enumerate([*thresholds, F.col("low")]):
        asked = open_.withColumn("least", F.greatest("low", threshold.cast("long")))
        asked = asked.groupBy("query").agg(F.collect_list(F.struct("window", "least", "high")).alias("windows"))
        left, right = _dealt(index, materialise(queries.join(asked, "query"), "queries"), same)
        pairs = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
        found = pairs.applyInArrow(_search_block(k, same, scale), "query long, window int, row long, id long, score long")
        ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        ranked = materialise(ranked, "found")
        if step == len(thresholds):
            filled.append(ranked)
            break
        enough = ranked.where(F.col("place") == k).select("query", "window")
        filled.append(ranked.join(enough, ["query", "window"], "left_semi"))
        open_ = materialise(open_.join(enough, ["query", "window"], "left_anti"), "open")
        if not open_.take(1):
            break
    out = filled[0]
    for more in filled[1:]:
        out = out.unionByName(more)
    return out.select("query", "window", "place", "row", "id", "score")


def hard_negatives(
    embeddings: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of ``floor(scale * x)``; higher ones come first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of the same label, its negatives for a positive the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` per cent of the positive's. ``anchors`` is a condition on ``id``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as zero in
    the missing components, a score beyond 64 bits as the largest one. Repeated rows are rows of their own, so each is a
    positive of the other. Fewer partners than asked for give fewer rows, an empty table none; other columns are ignored.
    """
    index = materialise(vectors.numbered(embeddings), "vectors")
    queries = index.where(anchors).select(F.col("row").alias("query"), F.col("id").alias("anchor_id"), "label", "vector")
    asked = queries.drop("anchor_id")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") * scale) * (x.cast("double") * scale)))
    longest = index.agg(F.max(norm(F.col("vector")))).first()[0] or 0.0
    reach = F.least(norm(F.col("vector")) * longest, F.lit(1e18))
    everything = queries.select("query", F.lit(1).alias("window"), F.lit(-LONG).alias("low"), F.lit(LONG).alias("high"), reach.alias("reach"))
    steps = [F.col("reach") * share for share in POSITIVE_STEPS]
    near = first_in_windows(index, asked, everything, steps, k=positives, same=True, scale=scale)
    near = materialise(near.select("query", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    part = lambda percent, side: side(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    windows = near.select("query", "window", part(low, F.ceil).alias("low"), part(high, F.floor).alias("high")).where("low <= high")
    steps = [F.col("high") - (F.col("high") - F.col("low")) * share for share in WINDOW_STEPS]
    found = first_in_windows(index, asked, windows, steps, k=negatives, same=False, scale=scale)
    out = found.join(near, ["query", "window"]).join(queries.select("query", "anchor_id"), "query")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
