"""Order-dependent building blocks that never put a whole sequence on one task.

``chunked`` range-partitions a table by *all* its ordering columns, so Spark samples balanced bounds no matter
how the partition key or the time column is skewed, sorts each range, and writes the result once. A chunk is one
such range. Every sequence operation is then a window inside ``(part, chunk)`` plus a carry table with one row per
``(part, chunk)``, i.e. at most ``chunks + distinct parts`` rows. The number of chunks follows the input's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.session import materialise

CHUNK, SLOT = "_chunk", "_slot"
CHUNK_BYTES = 128 << 20


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that also matches null keys; keeps the left key columns only."""
    if not on:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def settled(df: DataFrame) -> DataFrame:
    """A side table, written first so that the planner knows its true size.

    It is broadcast when it is below ``spark.sql.autoBroadcastJoinThreshold``, and joined by shuffle beyond that;
    either way the large side is not moved just to find out.
    """
    return materialise(df, "side")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below a plan, as far as the planner knows them; joins and filters are not guessed at."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # more means that a leaf has no size


def chunk_count(df: DataFrame) -> int:
    """Chunks of about ``CHUNK_BYTES`` of input, at least as many as there are shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // CHUNK_BYTES))


def chunked(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """Cut ``df`` into balanced contiguous chunks of its ``(part, order)`` sequence.

    ``order`` should end in tie-breakers that make rows distinct; equal rows share a chunk. ``keep`` names what is written
    of a row, where the columns that order it are not all needed later.
    """
    keys = [*part, *order]
    ranged = df.repartitionByRange(chunk_count(df), *keys).sortWithinPartitions(*keys)
    if keep:
        ranged = ranged.select(*[expr.alias(name) for name, expr in keep.items()])
    slotted = ranged.withColumn(SLOT, F.monotonically_increasing_id())
    return materialise(slotted.withColumn(CHUNK, F.shiftright(SLOT, 33).cast("int")), "chunks")


def _inside(part: Sequence[str], backward: bool = False) -> Window:
    return Window.partitionBy(*part, CHUNK).orderBy(F.col(SLOT).desc() if backward else SLOT)


def _across(part: Sequence[str], backward: bool = False) -> Window:
    # over the carry table only: one row per (part, chunk)
    return Window.partitionBy(*part).orderBy(F.col(CHUNK).desc() if backward else CHUNK)


def with_index(cdf: DataFrame, part: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based position of each row in its part; no second shuffle of the rows."""
    carry = cdf.groupBy(*part, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min(SLOT).alias("_first"))
    before = _across(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *part, CHUNK, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    joined = null_safe_join(cdf, settled(carry), [*part, CHUNK], "inner")
    return joined.withColumn(name, F.col(SLOT) + F.col("_shift")).drop("_shift")


def with_count(cdf: DataFrame, part: Sequence[str], name: str = "n_rows") -> DataFrame:
    """Rows of the part, on every row."""
    totals = cdf.groupBy(*part).agg(F.count(F.lit(1)).alias(name))
    if not part:
        return cdf.crossJoin(F.broadcast(totals))  # one row
    return null_safe_join(cdf, settled(totals), part, "inner")


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def with_running(
    cdf: DataFrame, part: Sequence[str], values: dict[str, tuple[str, Column | str]], inclusive: bool = True, backward: bool = False
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` / ``last`` (last non-null) along the part.

    ``values`` maps the new column to ``(kind, expression)``; ``inclusive=False`` leaves the current row out, and
    ``backward`` runs from the end of the part.
    """
    staged = cdf
    for name, (_, expr) in values.items():
        staged = staged.withColumn(f"_v_{name}", F.col(expr) if isinstance(expr, str) else expr)
    end = Window.currentRow if inclusive else -1
    aggregates, carried, outs = [], [], []
    local = _inside(part, backward).rowsBetween(Window.unboundedPreceding, end)
    before = _across(part, backward).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.min_by if backward else F.max_by
    for name, (kind, _) in values.items():
        value = F.col(f"_v_{name}")
        if kind == "last":
            aggregates.append(nearest(value, F.when(value.isNotNull(), F.col(SLOT))).alias(f"_t_{name}"))
            carried.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
            out = F.coalesce(F.last(value, ignorenulls=True).over(local), F.col(f"_c_{name}"))
        else:
            fold = _FOLDS[kind]
            aggregates.append(fold(value).alias(f"_t_{name}"))
            carried.append(fold(f"_t_{name}").over(before).alias(f"_c_{name}"))
            inner = fold(value).over(local)
            if kind == "sum":
                zero = F.lit(0)
                out = F.coalesce(inner, zero) + F.coalesce(F.col(f"_c_{name}"), zero)
            else:
                both = F.greatest if kind == "max" else F.least
                out = both(inner, F.col(f"_c_{name}"))
        outs.append(out.alias(name))
    carry = staged.groupBy(*part, CHUNK).agg(*aggregates).select(*part, CHUNK, *carried)
    joined = null_safe_join(staged, settled(carry), [*part, CHUNK], "inner")
    return joined.select(*cdf.columns, *outs)


def with_neighbours(
    cdf: DataFrame, part: Sequence[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None
) -> DataFrame:
    """Values of the previous (``before``) and the next row (``after``) of the part; null at its ends.

    Both map the new column to its source.
    """
    sides = [(name, sources, back) for name, sources, back in (("_b", before, True), ("_a", after, False)) if sources]
    packed = {name: F.struct(*[F.col(c).alias(n) for n, c in sources.items()]) for name, sources, _ in sides}
    edges, shifted = [F.min(SLOT).alias("_head"), F.max(SLOT).alias("_tail")], []
    for name, _, back in sides:
        edges.append((F.max_by if back else F.min_by)(packed[name], F.col(SLOT)).alias(f"_e{name}"))
        shifted.append((F.lag if back else F.lead)(f"_e{name}").over(_across(part)).alias(f"_e{name}"))
    carry = cdf.groupBy(*part, CHUNK).agg(*edges).select(*part, CHUNK, "_head", "_tail", *shifted)
    joined = null_safe_join(cdf, settled(carry), [*part, CHUNK], "inner")
    outs = []
    for name, sources, back in sides:
        near = (F.lag if back else F.lead)(packed[name]).over(_inside(part))
        at_edge = F.col(SLOT) == F.col("_head" if back else "_tail")
        joined = joined.withColumn(f"_n{name}", F.when(at_edge, F.col(f"_e{name}")).otherwise(near))
        outs += [F.col(f"_n{name}.{n}").alias(n) for n in sources]
    return joined.select(*cdf.columns, *outs)


def with_run_max(cdf: DataFrame, part: Sequence[str], run_of: str, value: str, name: str) -> DataFrame:
    """Max of ``value`` over each run of equal ``run_of``, on every row, however many chunks a run spans.

    Runs are numbered and folded inside their chunk, in the one shuffle of the rows. Only the first and last run of
    a chunk can go on elsewhere; those are put together in a table with one row per ``(part, chunk)``.
    """
    line = _inside(part)
    change = F.coalesce((~F.col(run_of).eqNullSafe(F.lag(run_of).over(line))).cast("long"), F.lit(0))
    change = F.when(F.row_number().over(line) == 1, 0).otherwise(change)
    numbered = cdf.withColumn("_change", change).withColumn(
        "_run", F.sum("_change").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    local = F.max(value).over(Window.partitionBy(*part, CHUNK, "_run"))
    staged = materialise(numbered.withColumn("_local", local).drop("_change"), "runs")
    chunks = staged.groupBy(*part, CHUNK).agg(
        F.min_by(run_of, SLOT).alias("_head"), F.max_by(run_of, SLOT).alias("_tail"), F.max("_run").alias("_last"),
        F.min_by("_local", SLOT).alias("_first_max"), F.max_by("_local", SLOT).alias("_last_max"),
    )
    order = _across(part)
    joins = F.lag("_tail").over(order).eqNullSafe(F.col("_head")) & (F.row_number().over(order) > 1)
    # number of the chunk's first run along the whole part
    chunks = chunks.withColumn("_step", F.when(joins, 0).otherwise(1))
    ends = F.sum(F.col("_step") + F.col("_last")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chunks = settled(chunks.withColumn("_end", ends).withColumn("_start", F.col("_end") - F.col("_last")))
    pieces = chunks.select(*part, F.col("_start").alias("_id"), F.col("_first_max").alias("_m")).unionByName(
        chunks.select(*part, F.col("_end").alias("_id"), F.col("_last_max").alias("_m"))
    )
    whole = pieces.groupBy(*part, "_id").agg(F.max("_m").alias("_whole"))
    at = lambda column, out: whole.select(*part, F.col("_id").alias(column), F.col("_whole").alias(out))
    chunks = null_safe_join(chunks, at("_start", "_first_whole"), [*part, "_start"])
    chunks = null_safe_join(chunks, at("_end", "_last_whole"), [*part, "_end"])
    table = settled(chunks.select(*part, CHUNK, "_last", "_first_whole", "_last_whole"))
    joined = null_safe_join(staged, table, [*part, CHUNK], "inner")
    found = (
        F.when(F.col("_run") == 0, F.col("_first_whole")).when(F.col("_run") == F.col("_last"), F.col("_last_whole"))
        .otherwise(F.col("_local"))
    )
    return joined.select(*cdf.columns, found.alias(name))


def plain(df: DataFrame) -> DataFrame:
    """Drop the bookkeeping columns."""
    return df.drop(CHUNK, SLOT)


def ordered_index(
    df: DataFrame, part: Sequence[str], order: Sequence[str | Column], name: str = "idx"
) -> DataFrame:
    """Global 0-based row number per part."""
    return plain(with_index(chunked(df, part, order), part, name))


SKETCH_ACCURACY, EXACT_BELOW = 10_000, 20_000


def _collapsed(df: DataFrame, part: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Counted values ``part, value, _n`` in which only the neighbourhoods of the wanted positions are kept apart.

    A sketch with a guaranteed rank error gives a bracket around each position; values between two brackets become
    one row with their count. Parts with few rows keep every value.
    """
    margin = 3.0 / SKETCH_ACCURACY  # twice the sketch error, and one rank of at least EXACT_BELOW
    cuts = [x for s in shares for x in (max(s - margin, 0.0), min(s + margin, 1.0))]
    v = F.col(value)
    sketch = df.groupBy(*part).agg(
        F.count(v).alias("_rows"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        F.percentile_approx(v, cuts, SKETCH_ACCURACY).alias("_cuts"),
    )
    few = F.col("_rows") < EXACT_BELOW
    ends = []
    for i, share in enumerate(shares):
        low = F.col("_lo") if share - margin <= 0 else F.get("_cuts", F.lit(2 * i))
        high = F.col("_hi") if share + margin >= 1 else F.get("_cuts", F.lit(2 * i + 1))
        ends += [F.when(few, F.col("_lo")).otherwise(low).alias(f"_a{i}"), F.when(few, F.col("_hi")).otherwise(high).alias(f"_b{i}")]
    placed = null_safe_join(df, settled(sketch.select(*part, "_rows", *ends)), part, "inner")
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(shares))])
    # the number of brackets that lie entirely below a value tells the stretches between brackets apart
    passed = reduce(lambda a, b: a + b, [(v > F.col(f"_b{i}")).cast("int") for i in range(len(shares))])
    grouped = placed.groupBy(*part, F.when(inside, v).alias("_kept"), F.when(~inside, passed).alias("_stretch"))
    counts = grouped.agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias(value), F.max("_rows").alias("_total"))
    return counts.drop("_kept", "_stretch")


def quantiles(df: DataFrame, part: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per part with linear interpolation at ``(n - 1) q``; nulls ignored.

    Two scans with map-side aggregation find the few values near the wanted positions and how many rows lie below
    them; a running count over those finds the two neighbours of each position. No part is gathered or sorted whole.
    """
    known = df.where(F.col(value).isNotNull()).select(*part, value)
    cdf = chunked(_collapsed(known, part, value, list(shares.values())), part, [value])
    run = with_running(cdf, part, {"_upto": ("sum", F.col("_n"))})
    covers = lambda pos: (pos >= F.col("_upto") - F.col("_n")) & (pos < F.col("_upto"))
    picks, finals = [], []
    for i, (name, share) in enumerate(shares.items()):
        at = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when(covers(low), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when(covers(high), F.col(value))).alias(f"_hi{i}"),
            F.max(at - low).alias(f"_w{i}"),
        ]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        finals.append((lo + (hi - lo) * F.col(f"_w{i}")).alias(name))
    return run.groupBy(*part).agg(*picks).select(*part, *finals)


def hash_key(*columns: str, seed: int = 42) -> Column:
    """A reproducible pseudo-random ordering key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def shuffled(index: Column, n: int, seed: Column | int, rounds: int = 4) -> Column:
    """A reproducible pseudo-random permutation of ``0 .. n - 1``, row by row and without a sort.

    A number is a place in a table of about root of n rows and columns; each round moves the row by a hash of the column and then
    the column by one of the row, which can be undone, so no two places meet. Places beyond ``n`` are sent on until they are
    inside; there are fewer of them than columns.
    """
    wide = max(1, int(n**0.5))
    high = max(1, -(-n // wide))
    key = seed if isinstance(seed, Column) else F.lit(seed)

    def step(x: Column) -> Column:
        state = F.struct(F.floor(x / wide).cast("long").alias("a"), (x % wide).cast("long").alias("b"))
        for r in range(rounds):
            state = F.transform(F.array(state), lambda s, r=r: F.struct(F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], key, F.lit(2 * r)), F.lit(high)), F.lit(high)).alias("a"), s["b"].alias("b")))[0]
            state = F.transform(F.array(state), lambda s, r=r: F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(F.xxhash64(s["a"], key, F.lit(2 * r + 1)), F.lit(wide)), F.lit(wide)).alias("b")))[0]
        return F.transform(F.array(state), lambda s: s["a"] * wide + s["b"])[0].cast("long")

    walk = lambda x, _: F.when(x < n, x).otherwise(step(x))
    # from a place inside, the walk comes back inside; each step leaves with a chance of at most one in the number of rows, so that few go on
    on = lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(38)), x, walk))
    ended = lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))
    # arrays of one entry, so that each step is computed once
    return F.transform(F.transform(F.array(step(index.cast("long"))), on), ended)[0]
