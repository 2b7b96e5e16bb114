"""Range joins between points and intervals by a tree of time ranges, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.functions.columns import floor_to
from voltlane.plans.ordering import input_bytes
from voltlane.session import materialise

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: a node of the tree has 2**FAN_BITS children; so many levels of hours reach beyond any timestamp
FAN_BITS, LEVELS = 4, 9
HOT_ROWS = 1_000_000


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most ``max_rows`` rows in files of at most ``max_bytes``."""
    return input_bytes(df) <= max_bytes and df.count() <= max_rows


def scalar_join(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(row))


def time_bucket(ts: Column, seconds: int) -> Column:
    step = seconds * 1_000_000
    return (floor_to(F.unix_micros(ts), step) / step).cast("long")


def unused(prefix: str, columns: Iterable[str]) -> str:
    """``prefix`` with as many underscores in front that no column starts with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return prefix


def _nodes(first: str, last: str, level: str) -> Column:
    """Nodes of one level in the cover of the buckets ``first..last``: what the level above cannot take whole.

    A level takes the nodes that lie inside the interval; those of the level above leave at most a node's children less one
    on either side, so an interval of n buckets has O(log n) nodes.
    """
    up = lambda x, lv: f"shiftright({x}, {FAN_BITS} * ({lv}))"
    a, b = f"-{up(f'-{first}', level)}", up(f"({last} + 1)", level)
    wide = 1 << FAN_BITS
    c, d = f"(-{up(f'-{first}', f'{level} + 1')} * {wide})", f"({up(f'({last} + 1)', f'{level} + 1')} * {wide})"
    run = lambda x, y: f"IF({x} < {y}, sequence({x}, {y} - 1), CAST(array() AS ARRAY<BIGINT>))"
    return F.expr(f"IF({c} >= {d}, {run(a, b)}, concat({run(a, c)}, {run(d, b)}))")


class IntervalTree:
    """Intervals by the nodes of their covers, written once, with the numbers of rows on each level that occurs.

    The columns begin with ``prefix``, which no column of the points does: ``station, level, node``, and the interval's own.
    """

    def __init__(self, points: DataFrame, intervals: DataFrame, station: str, start: str, end: str, bucket_seconds: int):
        p = self.prefix = unused("_iv", [*points.columns, *intervals.columns])
        self.names = {c: f"{p}_of_{c}" for c in intervals.columns if c != station}
        self.start, self.end, self.bucket_seconds = self.names[start], self.names[end], bucket_seconds
        rows = intervals.where(F.col(end) >= F.col(start)).select(F.col(station).alias(f"{p}_station"), *[F.col(c).alias(n) for c, n in self.names.items()])
        rows = rows.withColumns({f"{p}_a": time_bucket(F.col(self.start), bucket_seconds), f"{p}_b": time_bucket(F.col(self.end), bucket_seconds)})
        rows = rows.withColumn(f"{p}_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        rows = rows.withColumn(f"{p}_node", F.explode(_nodes(f"{p}_a", f"{p}_b", f"{p}_level"))).drop(f"{p}_a", f"{p}_b")
        self.rows = materialise(rows, "spans")
        counts = {r[0]: r[1] for r in self.rows.groupBy(f"{p}_level").count().collect()}  # one row per level
        self.levels, self.count = sorted(counts) or [0], sum(counts.values())

    def place(self, ts: str, level: int) -> Column:
        """The node of a level that holds a point."""
        return F.shiftright(time_bucket(F.col(ts), self.bucket_seconds), FAN_BITS * level)

    def at(self, level: int) -> DataFrame:
        return self.rows.where(F.col(f"{self.prefix}_level") == level)


def _hot_nodes(points: DataFrame, tree: IntervalTree, station: str, ts: str, hot_rows: int) -> DataFrame:
    """``station, level, node, salts`` of the nodes with more than ``hot_rows`` points: at most levels x points / hot_rows rows."""
    p = tree.prefix
    buckets = points.groupBy(F.col(station).alias(f"{p}_s"), time_bucket(F.col(ts), tree.bucket_seconds).alias(f"{p}_b")).count()
    ups = F.array(*[F.struct(F.lit(lv).alias("lv"), F.shiftright(f"{p}_b", FAN_BITS * lv).alias("n")) for lv in tree.levels])
    each = buckets.select(f"{p}_s", "count", F.explode(ups).alias("u")).groupBy(f"{p}_s", F.col("u.lv").alias(f"{p}_l"), F.col("u.n").alias(f"{p}_n"))
    hot = each.agg(F.ceil(F.sum("count") / hot_rows).cast("int").alias(f"{p}_salts")).where(F.col(f"{p}_salts") > 1)
    return materialise(hot, "hot")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    how: str = "inner",
    *,
    station: str = "station",
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    bucket_seconds: int = 3600,
    hot_rows: int = HOT_ROWS,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join points to the closed intervals of the same station that contain them.

    Time is a tree whose leaves are buckets. An interval stands at the few nodes that cover it, a point at its ancestors
    on the levels that occur, so the match is an equi join on ``(station, level, node)`` with the exact bounds as residual
    condition, and an interval of a century costs little more than one of an hour. Covers of up to ``max_broadcast_rows`` rows
    and ``BROADCAST_BYTES`` are broadcast and the points are not shuffled; beyond that both sides are, and the points of
    a node that holds more than ``hot_rows`` of them are dealt to several copies of its intervals.

    ``how`` is inner, left, left_semi or left_anti. Interval columns keep their names, one that the points have too
    becomes ``interval_<name>``; the station comes from the points.
    """
    tree = IntervalTree(points, intervals, station, start, end, bucket_seconds)
    p = tree.prefix
    few = tree.count <= max_broadcast_rows and input_bytes(tree.rows) <= BROADCAST_BYTES
    salt = F.lit(0)
    if not few:
        hot = _hot_nodes(points, tree, station, ts, hot_rows)
        salt = F.coalesce(F.pmod(F.xxhash64(*points.columns), F.col(f"{p}_salts")).cast("int"), F.lit(0))

    def of_node(side: DataFrame, level: str, node: str, key: str) -> DataFrame:
        names = {f"{p}_s": key, f"{p}_l": level, f"{p}_n": node}
        return side.join(hot, reduce(and_, [F.col(a) == F.col(b) for a, b in names.items()]), "left").drop(*names)

    def placed(side: DataFrame, levels: list[int]) -> DataFrame:
        """Points with the node they stand at, on every given level."""
        at = [F.struct(F.lit(lv).alias("level"), tree.place(ts, lv).alias("node")) for lv in levels]
        one = at[0] if len(at) == 1 else F.explode(F.array(*at))
        out = side.withColumn(f"{p}_at", one).select(*side.columns, F.col(f"{p}_at.level").alias(f"{p}_pl"), F.col(f"{p}_at.node").alias(f"{p}_pn"))
        if not few:
            out = of_node(out, f"{p}_pl", f"{p}_pn", station).withColumn(f"{p}_psalt", salt).drop(f"{p}_salts")
        return out

    def covers(levels: list[int]) -> DataFrame:
        rows = tree.rows if len(levels) > 1 else tree.at(levels[0])
        if few:
            return F.broadcast(rows)
        salted = of_node(rows, f"{p}_level", f"{p}_node", f"{p}_station")
        copies = F.sequence(F.lit(0), F.coalesce(F.col(f"{p}_salts"), F.lit(1)) - 1)
        return salted.withColumn(f"{p}_salt", F.explode(copies)).drop(f"{p}_salts")

    same = (
        (F.col(station) == F.col(f"{p}_station")) & (F.col(f"{p}_pl") == F.col(f"{p}_level")) & (F.col(f"{p}_pn") == F.col(f"{p}_node"))
        & (F.col(ts) >= F.col(tree.start)) & (F.col(ts) <= F.col(tree.end))
    )
    if not few:
        same = same & (F.col(f"{p}_psalt") == F.col(f"{p}_salt"))
    taken = set(points.columns)
    found = [F.col(n).alias(f"interval_{c}" if c in taken else c) for c, n in tree.names.items()]

    def joined(kind: str, side: DataFrame, levels: list[int]) -> DataFrame:
        out = placed(side, levels).join(covers(levels), same, kind)
        return out.select(*points.columns, *(found if kind in ("inner", "left") else []))

    if how == "inner" or len(tree.levels) == 1:
        return joined(how, points, tree.levels)
    rest, parts = points, []  # a point may match on several levels, but has to come out once
    for level in tree.levels:
        if how == "left_semi":
            parts.append(joined("left_semi", rest, [level]))
        rest = joined("left_anti", rest, [level])
    if how == "left_anti":
        return rest
    if how == "left":
        empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(f"interval_{c}" if c in taken else c) for c in tree.names]
        parts = [joined("inner", points, tree.levels), rest.select(*points.columns, *empty)]
    return reduce(DataFrame.unionByName, parts)


def inside_any(points: DataFrame, disjoint: DataFrame, flag: str, *, station: str = "station", ts: str = "ts", start: str = "start_ts", end: str = "end_ts", bucket_seconds: int = 3600) -> DataFrame:
    """Points, in the same number, with 1 where one of the disjoint intervals contains them, else 0.

    One lookup in the broadcast cover for each level that occurs; as intervals are disjoint no point is multiplied.
    """
    tree = IntervalTree(points, disjoint.select(station, start, end), station, start, end, bucket_seconds)
    p, out = tree.prefix, points
    small = tree.count <= BROADCAST_ROWS and input_bytes(tree.rows) <= BROADCAST_BYTES
    for level in tree.levels:
        side = tree.at(level).select(*[F.col(c).alias(f"{c}{level}") for c in (f"{p}_station", f"{p}_node", tree.start, tree.end)])
        same = (F.col(station) == F.col(f"{p}_station{level}")) & (tree.place(ts, level) == F.col(f"{p}_node{level}"))
        within = (F.col(ts) >= F.col(f"{tree.start}{level}")) & (F.col(ts) <= F.col(f"{tree.end}{level}"))
        out = out.join(F.broadcast(side) if small else side, same & within, "left")
    hits = [F.col(f"{tree.start}{level}") for level in tree.levels]
    return out.select(*points.columns, F.coalesce(*hits).isNotNull().cast("int").alias(flag))
