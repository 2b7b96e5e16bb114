"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words, hence every document of it the same expected number of copies. The whole part is
taken; the fraction is decided by pivotal rounding: two fractional documents trade mass, in words, in a random
direction chosen so that expectations stay, until one of them is integral. Each bounded chunk of a source leaves at most
one fractional document, and a tree of further rounds over these residuals leaves one per source. The words a source
yields therefore miss its target by less than one document, whatever the sizes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import count_words, fresh, mix
from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS, FAN_IN, SEED = 20_000, 1_000, 42
STATE = "row long, doc_id long, rank long, chunk long, size long, base long, p double"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``source, rank, n_docs, source_size, target``: ``share`` of all words by weight, at most ``limit`` times a source.

    Weights repeat along the sources by code point, null last. Filled like water: sources that reach their limit
    first do so for every level above, so running sums in that order tell which ones are full.
    """
    # one row per source from here on
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    each = each.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("w", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    cap, everything = F.lit(float(limit)) * F.col("source_size"), Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    each = each.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("cap", cap)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    each = each.withColumn("full", level * F.col("w") >= F.col("cap"))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - spent) / open_w * F.col("w"))
    return each.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pivotal rounding along the given order; at most one entry of the result is fractional.

    Of two fractional entries either the first gains and the second loses mass or the other way round, by as many
    words as make one of them 0 or 1; the odds are those that keep both expectations.
    """
    out, s, draws = p.tolist(), size.tolist(), u.tolist()
    i = -1
    for j, b in enumerate(out):
        if b <= 0.0 or b >= 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, si, sj = out[i], s[i], s[j]
        up, down = min((1.0 - a) * si, b * sj), min(a * si, (1.0 - b) * sj)
        if draws[j] * (up + down) < down:
            first = (1.0 - a) * si <= b * sj
            out[i], out[j] = (1.0, b - up / sj) if first else (a + up / si, 0.0)
        else:
            first = a * si <= (1.0 - b) * sj
            out[i], out[j] = (0.0, b + down / sj) if first else (a - down / si, 1.0)
        at_i, at_j = not 1e-12 < out[i] < 1 - 1e-12, not 1e-12 < out[j] < 1 - 1e-12
        if at_i:
            out[i] = float(round(out[i]))
        if at_j:
            out[j] = float(round(out[j]))
        i = j if at_i and not at_j else -1 if at_i else i
    return np.array(out)


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.full(1, seed, np.uint64))) >> np.uint64(11)) / float(1 << 53)


def _round_group(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["doc_id"].combine_chunks().fill_null(-1))
        size, p = np.asarray(table["size"]), np.asarray(table["p"])
        draws = _uniform(ids, seed)
        order = np.lexsort((size, ids, draws))
        out = np.empty(len(p))
        empty = size == 0  # nothing to trade: an independent draw
        order = order[~empty[order]]
        out[empty] = draws[empty] < p[empty]
        out[order] = pivot(p[order], size[order], _uniform(ids[order], seed + 1))
        if last:
            left = (out > 0) & (out < 1)
            out[left] = _uniform(ids[left], seed + 2) < out[left]
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return run


def copies(rows: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = SEED, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """For written ``row, doc_id, source, size, mark`` rows: their number of copies, and the source table.

    ``mark`` deals rows without an id, or with one id, to chunks as well. The result has ``row, doc_id, rank, size, n`` with ``n`` between 0 and ``ceil(limit)``. Equal input gives equal output:
    all draws are hashes of the ids.
    """
    targets = materialise(source_targets(rows, weights, share, limit), "targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a rate within rounding of a whole number is that number
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    n_chunks = F.ceil(F.col("n_docs") / F.lit(chunk_rows))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "row", F.col("doc_id").cast("long").alias("doc_id"), "rank",
        F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), n_chunks).cast("long").alias("chunk"),
        "size", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("p"),
    )
    done, chunks, step = [], -(-most // chunk_rows), 0
    while True:
        last = chunks <= 1
        state = materialise(joined.groupBy("rank", "chunk").applyInArrow(_round_group(seed + 10 * step, last), STATE), "rounded")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(state.where(whole))
        if last:
            break
        joined = state.where(~whole).withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
        chunks, step = -(-chunks // fan_in), step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row", "doc_id", "rank", "size", (F.col("base") + F.col("p").cast("long")).alias("n")), targets


def _sized(docs: DataFrame, row) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    A null or empty text has size 0 and yields no words; null sources form the last source; repeated rows are documents of
    their own. Other columns are ignored; an empty table gives no rows. See ``copies`` for the settings.
    """
    sized = materialise(_sized(docs, F.lit(0).cast("long")), "sizes")
    taken, targets = copies(sized, **settings)
    side = targets.select("rank", "source_size", "target")
    return taken.join(side, "rank").select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows are numbered and written once to keep equal rows apart."""
    row, times, copy = fresh(docs, "_row", "_times", "_copy")
    staged = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    sized = materialise(_sized(staged, F.col(row)), "sizes")
    taken, _ = copies(sized, **settings)
    often = taken.where("n > 0").select(F.col("row").alias(row), F.col("n").cast("int").alias(times))
    repeated = staged.join(often, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])
