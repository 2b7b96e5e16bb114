"""Sorts, limits, splits, samples and set operations. Random choice is a hash order, so it repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions.columns import column_intersection
from voltlane.plans.joins import scalar_join
from voltlane.plans.ordering import chunked, hash_key, null_safe_join, plain, with_count, with_index

LABEL = "label"


def sort_by_time(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned global sort."""
    return df.orderBy(*order)


def first_last_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First and last ``n`` rows in order, by two top-k scans, marked by ``side``."""
    first = df.orderBy(*order).limit(n).withColumn("side", F.lit("first"))
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("side", F.lit("last"))
    return first.unionByName(last)


def first_n_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_features(scores: DataFrame, n: int, by: str = "score", descending: bool = True) -> DataFrame:
    """Best ``n`` features, ties by name."""
    return scores.orderBy(F.col(by).desc() if descending else F.col(by), "feature").limit(n)


def sequential_split(
    df: DataFrame, order: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), part: tuple[str, ...] = (),
    keep: list[str] | None = None,
) -> DataFrame:
    """Time-ordered ``train`` / ``val`` / ``test`` with cuts at ``int(n a)`` and ``int(n (a + b))``; adds ``idx``.

    ``keep`` names the columns that are wanted beside the part's; those that only order the rows are then not written.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    kept = None if keep is None else {c: F.col(c) for c in dict.fromkeys([*part, *keep])}
    cdf = chunked(df, list(part), order, kept)
    rows = with_count(with_index(cdf, list(part)), list(part), "_n")
    first = F.floor(F.col("_n") * F.lit(ratios[0]))
    second = F.floor(F.col("_n") * F.lit(ratios[0] + ratios[1]))
    split = F.when(F.col("idx") < first, "train").when(F.col("idx") < second, "val").otherwise("test")
    return plain(rows).withColumn("split", split).drop("_n")


def class_positions(df: DataFrame, key: list[str], label: str = LABEL, seed: int = 42, part: tuple[str, ...] = ()) -> DataFrame:
    """Hash-ordered position of each row in its class (``_pos``) and the class size (``_size``).

    The position comes from balanced chunks, so a class with most of the rows is no single task.
    """
    groups = [*part, label]
    cdf = chunked(df.withColumn("_hash", hash_key(*key, seed=seed)), groups, ["_hash", *key])
    return plain(with_count(with_index(cdf, groups, "_pos"), groups, "_size")).drop("_hash")


def stratified_split(
    df: DataFrame, key: list[str], label: str = LABEL, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42
) -> DataFrame:
    """Class-preserving random split; per class the cuts are at ``floor(n a)`` and ``floor(n (a + b))``."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    rows = class_positions(df, key, label, seed)
    first = F.floor(F.col("_size") * F.lit(ratios[0]))
    second = F.floor(F.col("_size") * F.lit(ratios[0] + ratios[1]))
    split = F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "val").otherwise("test")
    return rows.withColumn("split", split).drop("_pos", "_size")


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 1).alias("_pos_total"), F.count_if(F.col(label) == 0).alias("_neg_total")
    )


def balance_training(
    df: DataFrame, key: list[str], ratio: float, label: str = LABEL, seed: int = 42
) -> DataFrame:
    """All anomalies and ``int(a (1 - r) / r)`` normals; unchanged if the share is reached or normals are too few."""
    if not 0 < ratio < 1:
        return df
    rows = scalar_join(class_positions(df, key, label, seed), _class_counts(df, label))
    keep = F.floor(F.col("_pos_total") * F.lit(1 - ratio) / F.lit(ratio))
    share = F.col("_pos_total") / (F.col("_pos_total") + F.col("_neg_total"))
    untouched = (share >= ratio) | (keep >= F.col("_neg_total"))
    return rows.where((F.col(label) == 1) | untouched | (F.col("_pos") < keep)).select(*df.columns)


def _first_of_class(df: DataFrame, key: list[str], label: str, value: int, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of a class in hash order: a top-k, not a sort of the table."""
    return random_sample(df.where(F.col(label) == value), key, n, seed)


def balanced_sample(
    df: DataFrame, key: list[str], size: int, ratio: float = 0.5, label: str = LABEL, seed: int = 42
) -> DataFrame:
    """``int(size r)`` anomalies and the rest normals, each capped at what the class has; rows of no class are left out."""
    anomalies = int(size * ratio)
    taken = _first_of_class(df, key, label, 1, anomalies, seed)
    return taken.unionByName(_first_of_class(df, key, label, 0, size - anomalies, seed))


def minority_equal_sample(df: DataFrame, key: list[str], label: str = LABEL, seed: int = 42) -> DataFrame:
    """Both classes down to the size of the smaller one."""
    rows = scalar_join(class_positions(df, key, label, seed), _class_counts(df, label))
    return rows.where(F.col("_pos") < F.least("_pos_total", "_neg_total")).select(*df.columns)


def random_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: a top-k over the hash order."""
    return df.withColumn("_hash", hash_key(*key, seed=seed)).orderBy("_hash", *key).limit(n).drop("_hash")


def balanced_oversample(
    df: DataFrame, key: list[str], size: int, label: str = LABEL, seed: int = 42, strategy: str = "balanced"
) -> DataFrame:
    """Half anomalies, repeated in hash order if there are too few, and half normals; other strategies are random.

    Adds ``copy``, the number of the repetition.
    """
    if strategy != "balanced":
        return random_sample(df, key, size, seed).withColumn("copy", F.lit(0).cast("long"))
    half = size // 2
    anomalies = _first_of_class(df, key, label, 1, half, seed).withColumn("_hash", hash_key(*key, seed=seed))
    placed = anomalies.withColumn("_pos", F.row_number().over(Window.orderBy("_hash", *key)) - 1)  # at most ``half`` rows
    placed = placed.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy()))
    # position p is taken for p, p + n, p + 2n, … below half
    copies = F.floor((F.lit(half - 1) - F.col("_pos")) / F.col("_size")).cast("long")
    repeated = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).select(*df.columns, "copy")
    return repeated.unionByName(_first_of_class(df, key, label, 0, half, seed).withColumn("copy", F.lit(0).cast("long")))


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def difference_timestamps(all_rows: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of the first frame that the second lacks, whose copies are dropped before they are moved."""
    return all_rows.select(*key).distinct().join(removed.select(*key).distinct(), key, "left_anti")


def union_index(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union of two row sets by key."""
    return first.select(*key).unionByName(second.select(*key)).distinct()


def column_report(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted columns and whether they exist."""
    present = set(column_intersection(df, wanted)[0])
    return df.sparkSession.createDataFrame([(c, c in present) for c in wanted], "column string, present boolean")
