"""Prefix trie of conversations by van Emde Boas cuts.

A range of depths is cut in half. The prefixes that reach the cut get names; they are the ends of the upper trie and the
roots of the lower forests, so upper and lower halves need nothing else of each other and are cut on in the same way.
All ranges of one width are worked on in the same job: a conversation of n turns takes part in about 2 n cuts, and there
are as many jobs as the longest conversation has bits in its length, however many conversations there are.

Names are built from pieces of 2**k turns that start at multiples of 2**k: a piece is named by the SHA-256 of the names of
its halves, a cut prefix by that of the prefix at the start of its range and the piece up to the cut. Once named, every
node goes by its smallest member, which with the depth is a key of two integers. Totals come back in the opposite order:
the totals of the lower forests' roots are grafted onto their ancestors in the upper trie, from ranges of one depth to
the whole, so a node adds to as many ancestors as a range is wide and not to all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.plans.ordering import chunked, plain, with_index
from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILY, MOST_SHARED = 100, 6


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, name, tokens``: turns by ``turn`` (null first), equal ones by role and text, with the SHA-256 of role and text.

    Null role or text is empty; rows without a conv_id are left out. Only names and sizes are written, no texts.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    size = F.octet_length("role").cast("string")
    name = _digest(*[F.encode(c, "UTF-8") for c in (size, F.lit(":"), F.col("role"), F.col("text"))])
    kept = {"conv_id": F.col("conv_id"), "name": name, "tokens": F.length("text").cast("long")}
    return plain(with_index(chunked(rows, ["conv_id"], ["turn", "role", "text"], keep=kept), ["conv_id"], "place"))


def with_shared_heads(turns: DataFrame, *, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, place, name, tokens`` and their conversations ``conv_id, n``, turnless ones included.

    The first ``crc32(conv_id) % most`` turns come from the conversation whose id is the next multiple of ``family`` towards
    zero (all it has, if fewer; none if there is none), the others are the conversation's own.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    own = own.select("conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    own = materialise(own, "conversations")
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    known = own.join(bases, "base", "left").withColumn("shared", F.least("head", F.coalesce("there", F.lit(0))))
    known = materialise(known.withColumn("n", F.col("shared") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "conversations")
    first = turns.where((F.col("place") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    heads = known.select("conv_id", "base", "shared").join(first, "base").where("place < shared").select("conv_id", "place", "name", "tokens")
    tails = turns.join(known.select("conv_id", "shared", "head"), "conv_id").where("place >= head")
    tails = tails.select("conv_id", (F.col("place") - F.col("head") + F.col("shared")).alias("place"), "name", "tokens")
    return materialise(heads.unionByName(tails), "turns"), known.select("conv_id", "n")


def _widths(longest: int) -> range:
    """Exponents of the ranges' widths: the widest covers every depth."""
    return range(max(1, longest.bit_length()))


def cut_names(turns: DataFrame, conversations: DataFrame, longest: int) -> DataFrame:
    """``conv_id, depth, name`` for every prefix of every conversation, the empty one included."""
    pieces = [turns.select("conv_id", F.col("place").alias("piece"), "name")]
    for _ in _widths(longest)[1:]:
        odd = F.col("piece") % 2 == 1
        halves = [F.max(F.when(side, F.col("name"))) for side in (~odd, odd)]
        joined = pieces[-1].groupBy("conv_id", F.shiftright("piece", 1).alias("piece")).agg(_digest(*halves).alias("name"))
        pieces.append(materialise(joined.where("name IS NOT NULL"), "pieces"))
    named = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("name"))
    for k in reversed(_widths(longest)):
        width = 1 << k
        upper = pieces[k].where("piece % 2 = 0").select("conv_id", (F.col("piece") * width).alias("depth"), F.col("name").alias("_piece"))
        roots = named if width > longest // 2 else named.where(F.col("depth") % (2 * width) == 0)
        cut = roots.join(upper, ["conv_id", "depth"])
        cut = cut.select("conv_id", (F.col("depth") + width).alias("depth"), _digest(F.col("name"), F.col("_piece")).alias("name"))
        named = named.unionByName(materialise(cut, "cuts"))
    return named


def _sum_totals(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def graft_totals(values: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Sums of ``n_leaves`` and ``saved_tokens`` over the subtree of each node ``conv_id, depth``.

    ``paths`` names the node (its smallest member) of every conversation at every depth.
    """
    parts = [values]
    for k in _widths(longest):
        width = 1 << k
        roots = [p.where((F.col("depth") % (2 * width)) == width) for p in parts]  # of the lower forests
        lower = _sum_totals(roots).withColumn("range", F.shiftright("depth", k) - 1).drop("depth")
        upper = paths.select("conv_id", "depth", "node", F.shiftright("depth", k).alias("range")).where("range % 2 = 0")
        grafted = upper.join(lower, ["conv_id", "range"]).groupBy(F.col("node").alias("conv_id"), "depth")
        parts.append(materialise(grafted.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "grafts"))
    return _sum_totals(parts)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal ``node, depth``, read as a stream: a run of any length is never held."""
    current, running, done = None, None, []
    for batch in batches:
        for node, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) != current:
                if current is not None:
                    done.append((*current, running.hexdigest()))
                current, running = (node, depth), sha256(str(member).encode())
            else:
                running.update(f",{member}".encode())
        if len(done) > 10_000:
            yield _run_rows(done)
            done = []
    if current is not None:
        yield _run_rows([*done, (*current, running.hexdigest())])


def _run_rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done), kinds)], [n for n, _ in kinds])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of the members ``member`` that end at a node, ids ascending and joined by commas.

    The digest is sequential by its definition: the ids of one node are hashed in one task, as a sorted stream.
    """
    dealt = ends.select("conv_id", "depth", "member").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return dealt.mapInArrow(_hash_runs, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns (role, text) of the rebuilt conversations, named by its smallest member; the
    root is the empty one, whose parent is null. Null role or text is empty, turns that are equal are ordered by role and text
    and repeated rows are turns of their own; rows without a conv_id take no part; other columns are ignored. An empty table has no
    nodes. Equal conversations become one path with their number before nodes are counted.
    """
    turns, known = with_shared_heads(materialise(ordered_turns(conversations), "turns"), family=family, most=most)
    longest = known.agg(F.max("n")).first()[0] or 0
    names = cut_names(turns, known, longest)

    ends = materialise(known.select("conv_id", F.col("n").alias("depth")).join(names, ["conv_id", "depth"]), "ends")
    paths = materialise(ends.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "paths")
    steps = materialise(names.join(paths.select("conv_id", "weight"), "conv_id"), "steps")
    nodes = materialise(steps.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.sum("weight").alias("n_convs")), "nodes")
    on_path = materialise(steps.join(nodes.drop("n_convs"), ["depth", "name"]).select("conv_id", "depth", "node"), "on_path")

    node = nodes.select(F.col("node").alias("conv_id"), "depth", "n_convs")
    above = on_path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    last = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "tokens")
    node = materialise(node.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"), "nodes")
    children = node.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    node = materialise(node.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "tokens"]), "nodes")
    values = node.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens"))
    totals = graft_totals(values, on_path, longest)

    at = nodes.select("depth", "name", F.col("node").alias("_node"))
    ended = ends.withColumnRenamed("conv_id", "member").join(at, ["depth", "name"]).withColumnRenamed("_node", "conv_id")
    out = node.join(totals, ["conv_id", "depth"]).join(ends_digests(ended), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).alias("ends_sha256"),
    )
