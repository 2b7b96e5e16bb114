"""Operators on embeddings against brute force: whole tables, and rows that take no part."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlane.llm import forest, negatives

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int"
ODD = [
    (100, [1.0, 0.0, 0.5], 1), (100, [1.0, 0.0, 0.5], 1), (101, [1.0, 0.01, 0.5], 1), (102, [0.5, 0.2, 0.1], 2), (103, [0.4, 0.2, 0.1], 2),
    (104, [0.4, 0.2, 0.1], 2), (105, [-1.0, 0.0, 0.0], 1), (200, None, 1), (201, [], 1), (300, [0.0, 0.0, 0.0], 1), (106, [NAN, 1.0, 0.0], 1),
    (107, [INF, 1.0, 0.0], 2), (108, [None, 1.0, 0.0], 2), (400, [0.3, 0.3, 0.3], None), (None, [1.0, 0.0, 0.5], 1), (500, [0.2], 3),
    (109, [0.9, -0.0, 0.4], 1), (110, [0.9, 0.0, 0.4], 1), (600, [1e12, 2e12, -3e12], 2), (601, [1e12, 2e12, -3e12], 2), (602, [1e11, 3e11, -2e11], 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    clashes = ("row", "id", "u", "tree", "path", "size", "query", "window", "block", "chunk", "score", "core", "vector", "n_links", "component")
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in clashes]).repartition(3)


def clusters(seed: int, n: int, spread: float, dims: int = 16) -> list[tuple]:
    """Vectors around a few centres, one of which has most of them, in two labels."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dims))
    which = np.where(r.random(n) < 0.4, 0, r.integers(0, 12, n))
    points = centres[which] + spread * r.standard_normal((n, dims))
    points[r.random(n) < 0.05] = points[0]
    return [(i, p, int(w % 2)) for i, (p, w) in enumerate(zip(points.round(6).tolist(), which))]


def usable(rows):
    return [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def mined(rows):
    rows = [(i, [math.floor(256 * x) for x in v.tolist()], lab) for i, v, lab in usable(rows)]
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i % 100:
            continue
        scores = [(min(sum(x * y for x, y in zip(v, w)), negatives.LONG), j, other == lab) for b, (j, w, other) in enumerate(rows) if b != a]
        for p, pid, _ in sorted((s for s in scores if s[2]), key=lambda s: (-s[0], s[1]))[:5]:
            found = sorted((s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=lambda s: (-s[0], s[1]))[:10]
            out += [(i, pid, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def linked(rows, similarity):
    at = {k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(rows[k][1]) for k in at}
    links = {k: [j for j in at if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= similarity] for k in at}
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = i if k not in at else min(rows[j][0] for j in seen)
        out.append((i, len(links.get(k, [])), least, i == least))
    return sorted(out, key=str)


def links_of(frame):
    assert [f.dataType.simpleString() for f in frame.schema] == ["bigint", "bigint", "bigint", "boolean"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def beside(odd, rows):
    """The odd rows and others of labels of their own, as a frame and as rows."""
    rows = [(i + 1000, [*v], lab + 10) for i, v, lab in rows]
    return odd.unionByName(odd.sparkSession.createDataFrame(rows, SCHEMA), allowMissingColumns=True), ODD + rows


def test_hard_negatives(odd):
    frame, rows = beside(odd, clusters(3, 700, 0.7))
    got = negatives.hard_negatives(frame, F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want


def test_index_leaves_out_what_cannot_reach():
    r = np.random.default_rng(5)
    values = np.floor(256 * r.standard_normal((3000, 24)) * 0.7 ** np.arange(24))
    index = negatives.InvertedIndex(values)
    for share in (0.9, 0.5, 0.1, -1.0):
        queries = values[:40]
        least = share * (queries**2).sum(1)
        q, v, score = index.above(queries, least)
        true = queries @ values.T
        assert sorted(zip(q, v, score)) == sorted((i, j, true[i, j]) for i, j in zip(*np.nonzero(true >= least[:, None])))


def test_near_vectors(odd):
    frame, rows = beside(odd, clusters(7, 600, 0.25))
    assert links_of(forest.near_vectors(frame)) == linked(rows, 0.93)


def test_near_vectors_by_leaves_blocks_and_cores(spark, monkeypatch):
    """Small leaves, so that trees split, and a dense group in many blocks: no link is counted twice, and few are lost."""
    monkeypatch.setattr(forest, "LEAF", 64)
    rows = clusters(11, 600, 0.12)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: r for r in links_of(forest.near_vectors(frame, largest=128, trees=4))}
    want = {r[0]: r for r in linked(rows, 0.93)}
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values())
    assert sum(got[i][2:] == want[i][2:] for i in want) >= 0.99 * len(want)


def test_no_vectors(odd):
    assert forest.near_vectors(odd.where("false")).collect() == []
    assert negatives.hard_negatives(odd.where("false"), F.col("id") % 100 == 0).collect() == []


def test_near_vectors_moves_shares_of_the_table_and_leaves_little_behind(spark, monkeypatch):
    """Leaves in many portions give what one portion gives; tables of vectors go as soon as they are done with."""
    rows = clusters(13, 700, 0.6) + [(5000 + i, v, lab) for i, v, lab in clusters(17, 200, 0.05)]
    frame = spark.createDataFrame([*rows, *rows[:40]], SCHEMA).repartition(3)
    monkeypatch.setattr(forest, "LEAF", 32)
    want = links_of(forest.near_vectors(frame, largest=64, trees=4))
    folder = forest.shared_path(spark, "x").rpartition("/")[0].removeprefix("file:")
    monkeypatch.setattr(forest, "PORTION", 1.0)
    monkeypatch.setattr(forest, "PORTION_LEAST", 0)
    moved, before, compare = [], set(os.listdir(folder)), forest._compare
    monkeypatch.setattr(forest, "_compare", lambda *args: moved.append(1) or compare(*args))
    got = forest.near_vectors(frame, largest=64, trees=4)
    left = {name.partition("-")[0] for name in set(os.listdir(folder)) - before}
    assert links_of(got) == want and len(moved) > 1
    assert not left & {"rows", "classes", "placed", "routed", "children", "leaves", "large"}
