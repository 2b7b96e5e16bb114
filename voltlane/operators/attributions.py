"""Contributions of features to single predictions of tree ensembles, exact for the path-dependent expectation.

A leaf is reached if every feature on its path lies in an interval. Where a feature is unknown, rows go on by the shares of
training weight, so a leaf weighs the product of its known features' hits and its unknown ones' shares, and a feature's
contribution is its mean effect over all orders in which features become known (its Shapley value). For one leaf with the
distinct features 1..u that mean needs only how many known features there are: the coefficients of the polynomial
``prod (share_k + hit_k t)`` over the other features, weighted by ``s! (u - s - 1)! / u!``.

Trees are read from the stored model as a table and flattened into leaves. Rows of an Arrow batch that hit the same features of
a leaf have the same contributions from it, so a leaf's polynomials are computed once per pattern of hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from voltlane.operators.cells import binned, inside
from voltlane.plans.joins import unused
from voltlane.plans.ordering import settled
from voltlane.session import materialise, release, shared_path

CELLS_IN_TASK = 2048


def stored_nodes(model: Model, spark: SparkSession) -> pd.DataFrame:
    """The nodes of all trees of a fitted ensemble, one row each; as many as the model has, whatever the data."""
    path = shared_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    out = nodes.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories"
    ).toPandas()
    release(spark, path)
    if (out["numCategories"] >= 0).any():
        raise ValueError("splits on categories have no intervals")
    return out.sort_values(["treeID", "id"], ignore_index=True)


class Leaf:
    """The features on a leaf's path with the interval ``(low, high]`` and the share of weight of each, and the leaf's value."""

    def __init__(self, bounds: dict[int, tuple[float, float, float]], value: float):
        self.features = np.array(sorted(bounds), np.int64)
        self.low, self.high, self.share = (np.array([bounds[f][i] for f in self.features]) for i in range(3))
        self.value = value

    @property
    def expected(self) -> float:
        return self.value * float(self.share.prod())

    def contributions(self, hits: np.ndarray) -> np.ndarray:
        """One row per pattern of ``hits`` (pattern x feature): what each feature adds."""
        u = len(self.features)
        out = np.empty(hits.shape)
        weight = np.array([factorial(s) * factorial(u - s - 1) / factorial(u) for s in range(u)])
        for j in range(u):
            known = np.zeros((len(hits), u))  # by the number of known features among the others
            known[:, 0] = 1.0
            for k in range(u):
                if k != j:
                    moved = np.roll(known, 1, axis=1) * hits[:, k, None]
                    known = known * self.share[k] + moved
            out[:, j] = self.value * (hits[:, j] - self.share[j]) * (known @ weight)
        return out


def tree_cuts(model: Model, spark: SparkSession, features: list[str]) -> dict[str, list[float]]:
    """All places where a tree of the ensemble cuts each feature, ascending."""
    nodes = stored_nodes(model, spark)
    nodes = nodes[nodes["leftChild"] >= 0]
    places = nodes["leftCategoriesOrThreshold"].map(lambda x: float(x[0]))
    return {f: sorted(set(places[nodes["featureIndex"] == i])) for i, f in enumerate(features)}


def flattened(model: Model, spark: SparkSession) -> list[Leaf]:
    """All leaves: of boosted trees with their part of the margin, of a forest with their part of the probability of class 1."""
    nodes, leaves = stored_nodes(model, spark), []
    boosted = isinstance(model, GBTClassificationModel)
    scale = model.treeWeights if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    for tree, rows in nodes.groupby("treeID"):
        rows = rows.set_index("id")
        # boosted trees keep count, sum and squares of what they predict, forests the weight of each class
        cover = {i: s[0] if boosted else sum(s) for i, s in rows["impurityStats"].items()}
        todo = [(int(rows.index[0]), {})]
        while todo:
            at, bounds = todo.pop()
            r = rows.loc[at]
            if r["leftChild"] < 0:
                stats = r["impurityStats"]
                value = r["prediction"] if boosted else stats[1] / sum(stats)
                leaves.append(Leaf(bounds, float(value) * scale[tree]))
                continue
            f, cut = int(r["featureIndex"]), float(r["leftCategoriesOrThreshold"][0])
            low, high, share = bounds.get(f, (-np.inf, np.inf, 1.0))
            for child, a, b in ((int(r["leftChild"]), low, min(high, cut)), (int(r["rightChild"]), max(low, cut), high)):
                todo.append((child, {**bounds, f: (a, b, share * cover[child] / cover[at])}))
    return leaves


def leaf_cuts(leaves: list[Leaf], feature: int) -> Iterator[float]:
    for leaf in leaves:
        at = leaf.features == feature
        yield from (float(x) for x in (*leaf.low[at], *leaf.high[at]) if np.isfinite(x))


def explained(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (row x feature) to the ensemble's output, and what it is expected to be without any feature."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        u = len(leaf.features)
        if not u:
            continue
        v = x[:, leaf.features]
        hits = np.where(np.isnan(v), leaf.high == np.inf, (v > leaf.low) & (v <= leaf.high))  # a missing value goes right
        if u < 63:
            code = hits @ (1 << np.arange(u, dtype=np.int64))
            _, first, which = np.unique(code, return_index=True, return_inverse=True)
        else:
            _, first, which = np.unique(hits, axis=0, return_index=True, return_inverse=True)
        out[:, leaf.features] += leaf.contributions(hits[first].astype(float))[which.ravel()]
    return out, float(sum(leaf.expected for leaf in leaves))


def tree_attributions(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """``<feature>_contribution`` for every feature, and ``base``; together they are the model's output for the row.

    The output is the margin (raw prediction of class 1) of boosted trees, and the probability of class 1 of a forest. Missing
    values are explained as the trees treat them. Rows between the same cuts of the trees have the same contributions, so these are
    computed once for every such cell that occurs, and joined to the rows.
    """
    leaves = flattened(model, df.sparkSession)
    names = [f"{f}_contribution" for f in features]
    cuts = {f: sorted(set(leaf_cuts(leaves, i))) for i, f in enumerate(features)}
    prefix = unused("_cell_", df.columns)
    bins = [f"{prefix}{i}" for i in range(len(features))]
    placed = binned(df, cuts, prefix)
    found = materialise(placed.select(*bins).distinct(), "cells")
    parts = -(-found.count() // CELLS_IN_TASK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            worth, base = explained(leaves, frame[features].to_numpy())
            yield frame[bins].assign(**{n: worth[:, i] for i, n in enumerate(names)}, base=base)

    fields = ", ".join(f"`{n}` double" for n in [*bins, *names, "base"])
    values = found.repartition(max(parts, 1), *bins).select(*bins, *inside(cuts, prefix))
    worth = settled(values.mapInPandas(run, fields))
    return placed.join(worth, bins).select(*df.columns, *names, "base")
