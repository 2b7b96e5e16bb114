"""Ordering blocks: independence of the cut, skew, nulls, and exact quantiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlane.plans import ordering as o
from voltlane.session import release, shared_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3000
    # one part holds two thirds of the rows, one instant a third of them
    part = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b"], n))
    ts = np.where(rng.random(n) < 0.33, 500, rng.integers(0, 1000, n))
    value = np.where(rng.random(n) < 0.1, None, rng.integers(-50, 50, n))
    data = [(str(p), int(t), int(i), None if v is None else float(v)) for i, (p, t, v) in enumerate(zip(part, ts, value))]
    return spark.createDataFrame(data, "part string, ts int, id int, value double").repartition(3), data


def _by_part(data):
    parts = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        parts.setdefault(row[0], []).append(row)
    return parts


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_index_running_and_neighbours(spark, rows, partitions):
    df, data = rows
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cdf = o.chunked(df, ["part"], ["ts", "id"])
        out = o.with_index(cdf, ["part"])
        out = o.with_running(out, ["part"], {"total": ("sum", "value"), "top": ("max", "value"), "seen": ("last", "value")})
        out = o.with_running(out, ["part"], {"low_before": ("min", "value")}, inclusive=False)
        out = o.with_neighbours(out, ["part"], {"previous": "value", "previous_id": "id"}, {"next_id": "id"})
        got = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(data)
    if partitions == "16":
        assert out.select("_chunk").distinct().count() > 8
    for part, items in _by_part(data).items():
        total, top, seen, low = 0.0, None, None, None
        for i, (_, _, rid, v) in enumerate(items):
            r = got[rid]
            assert r["low_before"] == low
            if v is not None:
                total, seen = total + v, v
                top = v if top is None else max(top, v)
                low = v if low is None else min(low, v)
            assert (r["idx"], r["total"], r["top"], r["seen"]) == (i, total, top, seen)
            assert r["previous_id"] == (items[i - 1][2] if i else None)
            assert r["previous"] == (items[i - 1][3] if i else None)
            assert r["next_id"] == (items[i + 1][2] if i + 1 < len(items) else None)


def test_quantiles_match_numpy(rows):
    df, data = rows
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {r["part"]: r for r in o.quantiles(df, ["part"], "value", shares).collect()}
    for part, items in _by_part(data).items():
        values = [r[3] for r in items if r[3] is not None]
        for name, share in shares.items():
            assert got[part][name] == pytest.approx(np.percentile(values, share * 100))


def test_null_part_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 1)], "part string, ts int")
    out = o.ordered_index(df, ["part"], ["ts"])
    assert sorted((r["part"] or "", r["ts"], r["idx"]) for r in out.collect()) == [("", 1, 0), ("", 2, 1), ("x", 1, 0)]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_run_max_spans_chunks(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(9)
        labels = [1] * 500 + [0] + list(rng.integers(0, 2, 60)) + [0] * 200 + [1] * 150
        values = [int(v) for v in rng.integers(0, 50, len(labels))]
        values[499] = 99
        data = [(p, i, int(a), v) for p in ("x", "y") for i, (a, v) in enumerate(zip(labels, values))]
        df = spark.createDataFrame(data, "part string, id int, label int, v int")
        out = o.with_run_max(o.chunked(df, ["part"], ["id"]), ["part"], "label", "v", "m")
        got = {(r["part"], r["id"]): r["m"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    start = 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[start]:
            for part in ("x", "y"):
                assert {got[part, j] for j in range(start, i)} == {max(values[start:i])}
            start = i


def test_quantiles_of_many_rows_keep_only_brackets(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25), rng.integers(0, 5, 30_000)])
    df = spark.createDataFrame(pd.DataFrame({"part": "a", "value": x}))
    shares = {"q1": 0.25, "q5": 0.5, "q7": 0.6180339, "q99": 0.999, "q0": 0.0, "q10": 1.0}
    kept = o._collapsed(df, ["part"], "value", list(shares.values()))
    assert kept.count() < 2000 and kept.agg(F.sum("_n")).first()[0] == len(x)
    got = o.quantiles(df, ["part"], "value", shares).first()
    for name, share in shares.items():
        assert got[name] == pytest.approx(np.percentile(x, share * 100), abs=1e-12)


def test_release_deletes_a_written_table(spark):
    path = shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert release(spark, path) and not release(spark, path)


def test_numbers_are_permuted_without_a_sort(spark):
    for n in (1, 2, 7, 100, 1023):
        rows = spark.range(n).select("id", *[o.shuffled(F.col("id"), n, seed).alias(f"s{seed}") for seed in (1, 2)]).collect()
        for seed in (1, 2):
            assert sorted(r[f"s{seed}"] for r in rows) == list(range(n))
        if n > 50:
            a, b = ([r[f"s{seed}"] for r in rows] for seed in (1, 2))
            assert a != b and sum(x == i for i, x in enumerate(a)) < 10
            assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.35
