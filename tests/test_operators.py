"""Hand-written frames for the quirks and edges of the operators."""

import itertools
import json
import math
import threading
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from voltlane.functions.columns import title_case
from voltlane.functions import signals
from voltlane.operators import attributions, cells, cleaning, intervals, metrics, models, profiles, ranking, sampling, series, spectra
from voltlane.plans.joins import IntervalTree, interval_join
from voltlane.session import side_by_side
from voltlane.sources import catalogue, readers
from voltlane.streaming import operators as streaming

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def spans(spark, rows):
    return frame(spark, [(s, at(a), at(b)) for s, a, b in rows], "station string, start_ts timestamp, end_ts timestamp")


def test_title_case_follows_every_non_letter(spark):
    got = spark.sql("select \"o'neil a-b x2y ÄRGER\" as s").select(title_case(F.col("s"))).first()[0]
    assert got == "o'neil a-b x2y ÄRGER".title()


def test_log_parsing_and_clock_change(spark):
    rows = [("01.07.2024, 12:00:00", "00:10:00"), ("31.03.2024, 02:30:00", "1:2"), ("27.10.2024, 02:30:00", None), ("bad", "x:1:2")]
    out = cleaning.clean_log(frame(spark, rows, "Date string, Downtime string")).collect()
    assert out[0]["StartTime"] == datetime(2024, 7, 1, 10) and out[0]["EndTime"] == datetime(2024, 7, 1, 10, 10)
    assert not out[0]["dst_ambiguous"] and out[1]["dst_ambiguous"] and out[2]["dst_ambiguous"]
    assert [r["DowntimeSeconds"] for r in out] == [600.0, None, None, None]
    assert out[3]["StartTime"] is None and out[3]["EndTime"] is None


def test_merge_touching_zero_length_and_nested(spark):
    df = spans(spark, [("a", 0, 10), ("a", 10, 20), ("a", 30, 30), ("a", 40, 90), ("a", 50, 60), ("b", 5, 6)])
    got = sorted((r["station"], r["start_ts"], r["end_ts"]) for r in intervals.merge_intervals(df).collect())
    assert got == [("a", at(0), at(20)), ("a", at(30), at(30)), ("a", at(40), at(90)), ("b", at(5), at(6))]


def test_labels_are_closed_on_both_ends(spark):
    points = frame(spark, [("a", at(m)) for m in (-1, 0, 5, 10, 11, 30)] + [("b", at(5))], "station string, ts timestamp")
    df = spans(spark, [("a", 0, 10), ("a", 2, 8), ("a", 30, 30)])
    got = {(r["station"], r["ts"]): r["anomaly_label"] for r in intervals.label_points_by_interval(points, df).collect()}
    assert got == {("a", at(-1)): 0, ("a", at(0)): 1, ("a", at(5)): 1, ("a", at(10)): 1, ("a", at(11)): 0, ("a", at(30)): 1, ("b", at(5)): 0}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_interval_join_paths_agree(spark, how):
    points = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("station"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id"
    )
    df = frame(
        spark, [("a", datetime(1970, 1, 1, h), datetime(1970, 1, 1, h, 50)) for h in range(20)]
        + [("b", datetime(1970, 1, 1, 3), datetime(1970, 1, 2, 3))], "station string, start_ts timestamp, end_ts timestamp",
    )
    results = []
    for settings in ({}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 0, "bucket_seconds": 86400, "hot_rows": 50}, {"bucket_seconds": 60}, {"max_broadcast_rows": 0, "bucket_seconds": 60, "hot_rows": 40}):
        out = interval_join(points, df, how, **settings)
        columns = ["id", "start_ts"] if "start_ts" in out.columns else ["id"]
        results.append(sorted(tuple(str(v) for v in r) for r in out.select(*columns).collect()))
    assert results[0] and all(r == results[0] for r in results)


def test_interval_covers_are_short_and_disjoint(spark):
    """Covers of any length: nodes that do not overlap, together just the interval's buckets, and O(log n) of them."""
    hour = lambda h: datetime(1970, 1, 1) + timedelta(hours=h)
    ranges = [(0, 0), (0, 15), (0, 16), (5, 300), (-40, 40), (255, 4097), (7, 7 + 24 * 365 * 100), (-500_000, 3_000_000)]
    df = frame(spark, [(str(i), hour(a), hour(b)) for i, (a, b) in enumerate(ranges)], "station string, start_ts timestamp, end_ts timestamp")
    points = frame(spark, [("0", T0)], "station string, ts timestamp")
    tree = IntervalTree(points, df, "station", "start_ts", "end_ts", 3600)
    covers = {}
    for r in tree.rows.collect():
        wide = 16 ** r[f"{tree.prefix}_level"]
        covers.setdefault(int(r[f"{tree.prefix}_station"]), []).append((r[f"{tree.prefix}_node"] * wide, (r[f"{tree.prefix}_node"] + 1) * wide))
    for i, (a, b) in enumerate(ranges):
        nodes = sorted(covers[i])
        assert nodes[0][0] == a and nodes[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(nodes, nodes[1:]))
        assert len(nodes) <= 30 * (1 + len(f"{b - a:x}"))


@pytest.mark.parametrize("limit", [0, 1000])
def test_wrong_end_dates_and_clashing_columns(spark, limit):
    """One downtime that never ends costs a few rows, and points may have the intervals' columns."""
    points = frame(
        spark, [(s, T0 + timedelta(days=400 * i), i, "x", T0, "y") for s in ("a", "b") for i in range(-5, 5)],
        "station string, ts timestamp, id int, start_ts string, end_ts timestamp, _kind string",
    )
    df = frame(spark, [("a", T0, datetime(9999, 1, 1)), ("b", T0, T0 + timedelta(hours=1)), ("b", T0 - timedelta(days=36500), T0 - timedelta(days=1500))], "station string, start_ts timestamp, end_ts timestamp")
    rows = intervals.label_points_by_interval(points, df, max_broadcast_rows=limit).collect()
    assert {(r.station, r.id) for r in rows if r.anomaly_label} == {("a", i) for i in range(5)} | {("b", 0), ("b", -5), ("b", -4)} and len(rows) == 20
    assert all(r.start_ts == "x" and r["_kind"] == "y" for r in rows)
    joined = intervals.readings_in_interval(points, df, max_broadcast_rows=limit).collect()
    assert {(r.station, r.id) for r in joined} == {(r.station, r.id) for r in rows if r.anomaly_label}
    assert all(r.interval_start_ts <= r.ts <= r.interval_end_ts and r.start_ts == "x" for r in joined)
    left = interval_join(points, df, "left", max_broadcast_rows=limit)
    assert left.count() == 20 and left.where("interval_end_ts IS NULL").count() == 20 - len(joined)
    assert IntervalTree(points, df, "station", "start_ts", "end_ts", 3600).count < 500


def test_zero_duration_is_outside_and_equal_durations_make_one_bin(spark):
    df = frame(spark, [("a", 0.0), ("a", 5.0), ("a", 5.5), ("a", 12.0), ("b", 7.0), ("b", 7.0)], "station string, m double")
    got = {(r["station"], r["bin"]): (r["events"], r["outside"]) for r in profiles.duration_distribution(df, "m").collect()}
    assert got == {("a", "0-5"): (1, 1), ("a", "5-10"): (1, 1), ("a", "10+"): (1, 1), ("b", "7.0"): (2, 0)}


def test_minutes_are_rounded_once(spark):
    rows = frame(spark, [("a", T0, T0 + timedelta(microseconds=m)) for m in (90_780_000, 60_060_000, 7)], "station string, start_ts timestamp, end_ts timestamp")
    assert [r.duration_minutes for r in intervals.interval_durations(rows).orderBy("end_ts").collect()] == [7 / 60e6, 1.001, 1.513]


def test_regular_grid_keeps_the_last_value(spark):
    df = frame(spark, [("a", at(0), 1.0), ("a", at(3), None), ("a", at(3.5), 4.0), ("a", at(5), 5.0)], "station string, ts timestamp, v double")
    got = [(r["slot"], r["v"]) for r in cleaning.regularise_ffill(df, ["v"], 60).orderBy("slot").collect()]
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0), (3, None), (4, 4.0), (5, 5.0)]


def test_standardise_constant_and_dropped_columns(spark):
    df = frame(spark, [(1.0, 2.0, None), (1.0, 4.0, None)], "flat double, x double, empty double")
    got = cleaning.standardise(df, ["flat", "x"]).collect()
    assert [(r["flat"], r["x"]) for r in got] == [(0.0, -1.0), (0.0, 1.0)]
    assert cleaning.drop_low_variance_columns(df).columns == ["x", "empty"]
    assert cleaning.drop_constant_columns(df).columns == ["x"]


def test_checks_raise(spark):
    df = frame(spark, [("a", 1)], "station string, ts int")
    with pytest.raises(ValueError):
        cleaning.require_columns(df, ["value"])
    with pytest.raises(ValueError):
        cleaning.filter_station(df, "z", ["ts"])
    with pytest.raises(ValueError):
        sampling.sequential_split(df, ["ts"], (0.5, 0.2, 0.2))


def test_split_sizes_of_the_published_tables():
    n = 538_798
    assert (int(n * 0.7), int(n * 0.85) - int(n * 0.7), n - int(n * 0.85)) == (377_158, 80_820, 80_820)


def _adjust_by_hand(labels, predicted):
    out, i = list(predicted), 0
    while i < len(labels):
        j = i
        while j < len(labels) and labels[j] == labels[i]:
            j += 1
        if labels[i] == 1 and any(predicted[i:j]):
            out[i:j] = [1] * (j - i)
        i = j
    return out


def test_point_adjustment(spark):
    rng = np.random.default_rng(3)
    labels = [1, 1, 1, 0] + list(rng.integers(0, 2, 300)) + [1] * 200 + [0]
    predicted = [0, 0, 1, 0] + list(rng.integers(0, 2, 300) * rng.integers(0, 2, 300)) + [0] * 199 + [1] + [0]
    df = frame(spark, [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(labels, predicted))], "i int, label int, predicted int")
    got = [r["adjusted"] for r in metrics.point_adjustment(df, ["i"]).orderBy("i").collect()]
    assert got == _adjust_by_hand(labels, predicted)
    kept = metrics.point_adjustment(df, ["i"], keep_first_row=True).orderBy("i").collect()
    assert [r["adjusted"] for r in kept] == [0] + got[1:]


def test_metrics_with_one_class(spark):
    df = frame(spark, [(0.2, 0), (0.9, 0)], "score double, label int")
    assert metrics.auroc(df).first()[0] == 0.0
    assert metrics.average_precision(df).first()[0] == 0.0
    assert metrics.threshold_all_scores(df).first()["threshold"] == 0.5
    row = metrics.binary_metrics(metrics.score_binary(df)).first()
    assert (row["precision"], row["recall"], row["f1"], row["fp"]) == (0.0, 0.0, 0.0, 1)


def test_threshold_of_zero_is_kept(spark):
    df = frame(spark, [(0.0, 1)], "score double, label int")
    assert metrics.score_binary(df, 0).first()["predicted"] == 1
    assert metrics.score_binary(df).first()["predicted"] == 0


def test_sequence_windows_match_slices(spark):
    n, size, step = 103, 10, 3
    df = spark.range(n).select("id", (F.col("id") * 2.0).alias("x"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    for block in (11, 32, 4096):
        out = series.sequence_windows(df, ["x"], ["id"], size, step, "y", block_rows=block).orderBy("window_id").collect()
        assert [r["window_id"] for r in out] == list(range((n - size) // step + 1))
        for r in out:
            ids = range(r["window_id"] * step, r["window_id"] * step + size)
            assert [f[0] for f in r["features"]] == [2.0 * i for i in ids]
            assert r["labels"] == [int(i % 7 == 0) for i in ids]
    share = series.sequence_label_share(df, ["id"], size, step, "y").first()
    every = [y for r in out for y in r["labels"]]
    assert (share["anomalies"], share["timesteps"]) == (sum(every), len(every))


@pytest.mark.parametrize("period", [5, 6])
def test_seasonal_decompose_against_numpy(spark, period):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 3, 97) + np.arange(97) * 0.1
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)], "station string, slot long, v double")
    weights = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    trend = np.full(97, np.nan)
    half = period // 2
    for i in range(half, 97 - half):
        trend[i] = (x[i - half : i + half + 1] * weights).sum() / period
    phases = np.array([np.nanmean((x - trend)[p::period]) for p in range(period)])
    seasonal = (phases - phases.mean())[np.arange(97) % period]
    for block in (7, 16, None):
        got = series.seasonal_decompose(df, "v", period, block_rows=block).orderBy("slot").collect()
        assert len(got) == 97
        np.testing.assert_allclose([np.nan if r["trend"] is None else r["trend"] for r in got], trend, rtol=1e-9)
        np.testing.assert_allclose([r["seasonal"] for r in got], seasonal, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 96, 97, 101, 360])
def test_series_fft_any_length(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.normal(size=60)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    out = spectra.series_fft(frame(spark, rows, "station string, i0 int, v double"), "v", ["i0"]).toPandas()
    for name, values in (("a", x), ("b", y)):
        got = out[out.station == name].sort_values("k")
        np.testing.assert_allclose(got.re + 1j * got.im, np.fft.fft(values), atol=1e-9)


def test_autocorrelation_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=75)
    d = x - x.mean()
    want = [(d[: 75 - k] * d[k:]).sum() / (d * d).sum() for k in range(75 // 4 + 1)]
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)], "station string, i0 int, v double")
    got = spectra.autocorrelation(df, "v", ["i0"]).orderBy("lag").collect()
    np.testing.assert_allclose([r["acf"] for r in got], want, atol=1e-10)
    few = spectra.autocorrelation_at(df, "v", ["i0"], [0, 3, 7]).orderBy("lag").collect()
    np.testing.assert_allclose([r["acf"] for r in few], [want[0], want[3], want[7]], atol=1e-10)


def test_flat_tops_count_once_at_their_middle(spark):
    x = [0, 1, 1, 1, 1, 0, 2, 1, 3, 3, 3, 4, 2, 2, 5]
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)], "station string, k long, v double")
    got = sorted(r["k"] for r in spectra.local_maxima(df, "v", "k", ("station",)).collect())
    assert got == [2, 6, 11]


def test_welch_and_window_functions_on_known_signals():
    x = np.sin(2 * np.pi * 0.25 * np.arange(64))
    freq, density = signals.welch(x, 16)
    assert freq[density.argmax()] == 0.25 and len(freq) == 9
    dominant, peak, flatness, _ = signals.magnitude_features(x)
    assert dominant == 0.25 and peak == pytest.approx(32) and 0 <= flatness < 0.01
    assert signals.magnitude_features(np.ones(3)) == (0.0, 0.0, 0.0, 0.0)
    assert signals.ks_distance(np.array([100.0, 200.0])) == pytest.approx(1.0)
    assert signals.ks_distance(np.array([0.0])) == pytest.approx(0.5)


def test_window_features_hold_the_single_statistics(spark):
    df = frame(
        spark, [("a", at(m), float((m * 7) % 13), int(m > 30)) for m in range(60)], "station string, ts timestamp, v double, anomaly_label int"
    )
    spec = series.SlidingWindows(1800, 600, expected=30)
    table = spectra.window_features(df, spec, ["v"]).orderBy("window_id").toPandas()
    assert len(table) == 3 and {"v_mean", "v_welch_total_power", "midpoint", "anomaly_label"} <= set(table.columns)
    for single in (series.window_mean_std, series.window_skew, series.window_trend_slope, series.window_change_point,
                   spectra.window_ks_normal, spectra.window_fft_features, spectra.window_welch_features):
        part = single(df, spec, ["v"]).orderBy("window_id").toPandas()
        for column in part.columns.drop(["station", "window_id", "window_start"]):
            np.testing.assert_allclose(part[column], table[column])
    assert list(table.anomaly_label) == [0, 1, 1]


def test_huge_windows_give_the_same_features(spark):
    rng = np.random.default_rng(12)
    rows = [("a", T0 + timedelta(seconds=int(i)), float(v), int(i > 700)) for i, v in enumerate(rng.normal(size=1300))]
    df = frame(spark, rows, "station string, ts timestamp, v double, anomaly_label int")
    small, huge = series.SlidingWindows(600, 300), series.SlidingWindows(600, 300, max_rows=10)
    a = spectra.window_features(df, small, ["v"]).orderBy("window_id").toPandas()
    b = spectra.window_features(df, huge, ["v"]).orderBy("window_id").toPandas()
    assert len(a) == 3
    for column in a.columns:
        if a[column].dtype == float:
            np.testing.assert_allclose(a[column], b[column], rtol=1e-8, err_msg=column)
        else:
            assert list(a[column]) == list(b[column]), column


def test_nearest_neighbour_information_equals_brute_force(spark):
    rng = np.random.default_rng(41)
    y = rng.integers(0, 3, 500)
    y[499] = 9  # a class of one row is left out
    x = {"near": y * 2 + rng.normal(size=500), "ties": rng.integers(0, 40, 500) + 3.0 * (y == 1), "noise": rng.normal(size=500), "same": np.ones(500)}
    x["near"][rng.random(500) < 0.05] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"label": y, **x})).repartition(3)

    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))

    want = {}
    for name, values in x.items():
        known = ~np.isnan(values)
        known &= np.array([(y[known] == c).sum() > 1 for c in y])
        v, c, terms = values[known], y[known], []
        for i in range(len(v)):
            mine = np.sort(np.abs(np.delete(v, i)[np.delete(c, i) == c[i]] - v[i]))
            k = min(3, len(mine))
            d = mine[k - 1]
            m = (np.abs(v - v[i]) < d - 1e-12).sum() if d > 0 else (v == v[i]).sum()
            terms.append(psi(k) - psi(len(mine) + 1) - psi(m))
        want[name] = max(0.0, psi(len(v)) + np.mean(terms))
    for block_rows in (4096, 16):
        got = {r.feature: r.mutual_info for r in ranking.mutual_information_nearest(df, list(x), block_rows=block_rows).collect()}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[f] for f in want], list(want.values()), atol=1e-9)
    assert want["near"] > 0.1 and want["same"] == 0


def brute_shapley(nodes, x):
    """Mean effect of each feature of one row over all orders, by the expectation of the trees with some features known."""
    n = len(x)

    def expected(rows, at, known):
        r = rows[at]
        if r["leftChild"] < 0:
            return r["value"]
        left, right = r["leftChild"], r["rightChild"]
        if r["featureIndex"] in known:
            return expected(rows, left if x[r["featureIndex"]] <= r["cut"] else right, known)
        return (rows[left]["cover"] * expected(rows, left, known) + rows[right]["cover"] * expected(rows, right, known)) / r["cover"]

    value = {s: sum(expected(rows, 0, set(s)) for rows in nodes) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = []
    for j in range(n):
        others = [i for i in range(n) if i != j]
        out.append(sum(
            math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value[tuple(sorted((*s, j)))] - value[s])
            for k in range(n) for s in itertools.combinations(others, k)
        ))
    return out, value[()]


def test_tree_attributions_equal_brute_force_and_add_up(spark):
    rng = np.random.default_rng(31)
    x = rng.integers(0, 8, (300, 4)).astype(float)
    x[rng.random(300) < 0.05, 3] = np.nan
    y = ((x[:, 0] > 3) & (x[:, 1] < 5)) ^ (rng.random(300) < 0.1)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), int(t), i) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, d double, label int, i int")
    whole = df.where("NOT isnan(d)")  # missing values are predicted, but not fitted
    for model in (models.fit_boosted_trees(whole, names, maxIter=6, maxDepth=4), models.fit_random_forest(whole, names, numTrees=5, maxDepth=5)):
        boosted = hasattr(model, "evaluateEachIteration")
        got = attributions.tree_attributions(model, df, names)
        out = models.predict(model, got, names).withColumn("margin", F.log(F.col("score") / (1 - F.col("score"))) / 2)
        rows = out.orderBy("i").toPandas()
        total = rows[[f"{f}_contribution" for f in names]].sum(axis=1) + rows["base"]
        np.testing.assert_allclose(total, rows["margin" if boosted else "score"], atol=1e-9)
        nodes = []
        for tree, part in attributions.stored_nodes(model, spark).groupby("treeID"):
            w = model.treeWeights[tree] if boosted else 1 / model.getNumTrees
            keep = {}
            for r in part.itertuples():
                s = r.impurityStats
                keep[r.id] = {"leftChild": r.leftChild, "rightChild": r.rightChild, "featureIndex": r.featureIndex, "cover": s[0] if boosted else sum(s),
                              "cut": r.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else None, "value": w * (r.prediction if boosted else s[1] / sum(s))}
            nodes.append(keep)
        for i in (0, 7, 100, int(np.flatnonzero(np.isnan(x[:, 3]))[0])):
            want, base = brute_shapley(nodes, x[i])
            np.testing.assert_allclose(rows.loc[i, [f"{f}_contribution" for f in names]].astype(float), want, atol=1e-9)
            np.testing.assert_allclose(rows.loc[i, "base"], base, atol=1e-9)


def repeated_rows(spark, copies, n=1500):
    rng = np.random.default_rng(41)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 5, n) / 4, rng.integers(0, 3, n)]).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 0.6)) ^ (rng.random(n) < 0.1)
    rows = [(*map(float, r), int(t), i) for i, (r, t) in enumerate(zip(x, y))]
    return frame(spark, rows, "a double, b double, c double, label int, i int").crossJoin(spark.range(copies).select(F.col("id").alias("copy")))


def test_predictions_are_made_once_before_they_are_put_in_order(spark, monkeypatch, tmp_path):
    seen, cut = [], models.chunked
    monkeypatch.setattr(models, "chunked", lambda df, *rest: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *rest))
    scored = frame(spark, [(i, i % 2, i / 10) for i in range(10)], "idx long, label int, score double")
    found = models.save_predictions(scored.withColumnRenamed("idx", "at"), 0.5, ["at"], f"file://{tmp_path}/out").orderBy("idx").collect()
    assert [(r.idx, r.true_label, r.predicted_label) for r in found] == [(i, i % 2, int(i >= 5)) for i in range(10)]
    assert len(seen) == 1 and seen[0].lstrip().startswith("Relation")


def test_jobs_side_by_side_have_their_own_properties(spark):
    sc, together = spark.sparkContext, threading.Barrier(3, timeout=60)

    def own(i):
        sc.setLocalProperty("test.own", str(i))
        together.wait()
        return sc.getLocalProperty("test.own")

    assert side_by_side(spark, own, range(3), 3) == ["0", "1", "2"]
    assert sc.getLocalProperty("test.own") is None


def test_fits_on_cells_take_as_many_rows_whatever_the_copies(spark):
    names = ["a", "b", "c"]
    sizes = [cells.cells(models.with_class_weight(repeated_rows(spark, n), "label"), names, "label").rows for n in (1, 8)]
    assert sizes[0].count() == sizes[1].count() <= 180
    assert sizes[1].agg(F.sum("_n")).first()[0] == 8 * sizes[0].agg(F.sum("_n")).first()[0] == 12_000
    missing = repeated_rows(spark, 2).withColumn("a", F.when(F.col("i") == 3, F.lit(None)).otherwise(F.col("a")))
    assert cells.cells(models.with_class_weight(missing, "label"), names, "label") is None


def test_boosting_on_cells_equals_boosting_on_rows(spark, monkeypatch):
    names, df = ["a", "b", "c"], repeated_rows(spark, 3)
    train, held = df.where("i % 3 > 0"), df.where("i % 3 = 0")
    settings = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 1.0}
    found = {}
    for fewer in (2, 1 << 40):
        monkeypatch.setattr(cells, "FEWER", fewer)
        model, losses = models.boost_with_patience(train, names, held, patience=4, positive_weight=2.0, **settings)
        found[fewer] = losses, [r.score for r in models.predict(model, held, names).orderBy("i", "copy").collect()], model.featureImportances.toArray()
    for a, b in zip(*found.values()):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_a_split_writes_the_wanted_columns_only(spark):
    df = frame(spark, [((7 * i) % 20, i % 2, 0.5 * i) for i in range(20)], "at int, s int, x double")
    whole, kept = sampling.sequential_split(df, ["at"]), sampling.sequential_split(df, ["at"], keep=["x"])
    assert kept.columns == ["x", "idx", "split"] and sorted(kept.collect()) == sorted(whole.select(*kept.columns).collect())
    assert all("at" not in spark.read.parquet(path).columns for path in kept.inputFiles())
    of_part = sampling.sequential_split(df, ["at"], part=("s",), keep=["x"])
    assert of_part.columns == ["s", "x", "idx", "split"] and of_part.where("idx = 0").count() == 2


def test_a_round_evaluates_the_newest_trees_only(spark, monkeypatch):
    names, df, sizes = ["a", "b", "c"], repeated_rows(spark, 3), []
    settings, ensemble = {"maxDepth": 2, "stepSize": 0.3, "subsamplingRate": 0.8}, models._ensemble
    monkeypatch.setattr(models, "_ensemble", lambda trees, *rest: sizes.append(len(trees)) or ensemble(trees, *rest))
    scores = {}
    for every in (2, 100):  # with 100 each round evaluates all trees
        monkeypatch.setattr(models.BoostingTable, "MARGINS", every)
        table = models.BoostingTable(models.with_class_weight(df, "label"), names, df, "label", 7, [settings])
        table.DRAWS = 5
        model = table.fit(10, settings, table.fit(7, settings))
        sizes.clear()
        model = table.fit(13, settings, model)
        scores[every], evaluated = table.losses(model), sorted(sizes)
        assert every == 100 or evaluated == [1, 2, 10, 13]  # three rounds: all known trees once, then those since, then the model
    np.testing.assert_allclose(scores[2], scores[100], rtol=1e-9)


def test_forests_on_cells_draw_rows_one_by_one(spark):
    names, df = ["a", "b", "c"], repeated_rows(spark, 4)
    one, two = (models.fit_random_forest(df, names, weights={0: 1.0, 1: 1.0}, numTrees=30, maxDepth=4) for _ in range(2))
    roots = attributions.stored_nodes(one, spark).query("id == 0")["impurityStats"].map(sum)
    assert abs(roots.mean() - 6000) < 80 and 30 < roots.std() < 140  # Poisson(6000), with a deviation of 77
    spark_own = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=30, maxDepth=4, featureSubsetStrategy="sqrt", seed=1).fit(models.assemble(df, names))
    a, b, c = ([r.score for r in models.predict(m, df.where("copy = 0"), names).orderBy("i").collect()] for m in (one, two, spark_own))
    assert a == b and np.abs(np.subtract(a, c)).max() < 0.12 and np.corrcoef(a, c)[0, 1] > 0.98


def test_bins_put_equal_values_below_a_cut_and_missing_ones_on_top(spark):
    rows = [(0, 0.5), (1, 0.75), (2, 0.7500001), (3, 9.0), (4, float("nan")), (5, None), (6, float("-inf"))]
    got = cells.binned(frame(spark, rows, "i int, x double"), {"x": [0.5, 0.75]}).orderBy("i").collect()
    assert [r["_bin_0"] for r in got] == [0, 1, 2, 2, 2, 2, 0]


def test_attributions_are_computed_once_for_rows_between_the_same_cuts(spark, monkeypatch):
    names, df = ["a", "b", "c"], repeated_rows(spark, 4)
    model, seen = models.fit_boosted_trees(df, names, maxIter=3, maxDepth=3), []
    monkeypatch.setattr(attributions, "settled", lambda t: seen.append(t.count()) or t)
    got = attributions.tree_attributions(model, df, names)
    assert got.count() == 6000 and len(seen) == 1 and seen[0] <= 90 and got.columns == [*df.columns, *[f"{n}_contribution" for n in names], "base"]


def test_boosting_goes_on_until_patience_ends_and_keeps_the_best_rounds(spark, monkeypatch):
    assert models.stopped([3, 2, 2.5, 2.4, 1.9, 2], 3) == (4, None)
    assert models.stopped([3, 2, 2.5, 2.4, 2.2, 1], 3) == (1, 4)
    rng = np.random.default_rng(33)
    x = rng.normal(size=(600, 2))
    y = x.sum(1) + 0.5 * rng.normal(size=600) > 0
    df = spark.createDataFrame([(float(a), float(b), int(t), i) for i, ((a, b), t) in enumerate(zip(x, y))], "a double, b double, label int, i int")
    train, held = df.where("i < 400"), df.where("i >= 400")
    monkeypatch.setattr(models, "FIRST_ROUNDS", 4)
    model, losses = models.boost_with_patience(train, ["a", "b"], held, patience=3, maxIter=20, maxDepth=2, stepSize=0.4, subsamplingRate=1.0)
    best = int(np.argmin(losses))
    assert model.getNumTrees == best + 1 and (len(losses) == best + 4 or len(losses) == 20) and len(losses) > 4
    whole = models.fit_boosted_trees(train, ["a", "b"], maxIter=best + 1, maxDepth=2, stepSize=0.4, subsamplingRate=1.0)
    a, b = ([r.score for r in models.predict(m, held, ["a", "b"]).orderBy("i").collect()] for m in (model, whole))
    assert a == b  # rounds do not depend on how many follow
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


@pytest.mark.parametrize("max_rows", [1_000_000, 10])
def test_windows_from_panes_equal_windows_from_rows(spark, max_rows):
    """Panes of gcd(600, 240) seconds: merged moments, co-moments with the row's place, and steps across panes."""
    rng = np.random.default_rng(21)
    at = np.sort(rng.choice(4000, 700, replace=False))
    value = 1e6 + np.cumsum(rng.normal(size=700)) ** 2
    value[rng.random(700) < 0.1] = np.nan
    value[300:420] = 5.0
    rows = [("a", T0 + timedelta(seconds=int(t)), None if np.isnan(v) else float(v)) for t, v in zip(at, value)]
    df = frame(spark, rows, "station string, ts timestamp, v double").repartition(5)
    spec = series.SlidingWindows(600, 240, expected=50, max_rows=max_rows)
    columns = {}
    for op in (series.window_mean_std, series.window_skew, series.window_change_point, series.window_trend_slope):
        got = op(df, spec, ["v"]).toPandas().set_index("window_id").sort_index()
        columns |= {c: got[c] for c in got.columns if c.startswith("v_")}
    seconds = at - at[0]
    starts = [k for k in range(100) if k * 240 + 600 <= seconds[-1] and ((seconds >= k * 240) & (seconds < k * 240 + 600)).sum() >= 40]
    assert list(columns["v_mean"].index) == starts and len(starts) > 10
    for k in starts:
        v = value[(seconds >= k * 240) & (seconds < k * 240 + 600)]
        place, x = np.flatnonzero(~np.isnan(v)), v[~np.isnan(v)]
        d = x - x.mean()
        skew = (d**3).mean() / (d**2).mean() ** 1.5 if x.std() > 1e-10 else 0.0
        slope = np.polyfit(place, x, 1)[0] if x.min() < x.max() else 0.0
        want = {"v_mean": x.mean(), "v_std": x.std(), "v_skew": skew, "v_trend_slope": slope, "v_change_point_score": np.nanmax(np.r_[0.0, np.abs(np.diff(v))])}
        for c, w in want.items():
            np.testing.assert_allclose(columns[c][k], w, rtol=1e-6, atol=1e-7, err_msg=f"{c} {k}")


def test_nulls_in_windows_are_left_out_on_both_paths(spark):
    rng = np.random.default_rng(13)
    values = [None if i % 7 == 3 or 600 <= i < 1200 else float("nan") if i % 50 == 1 else float(round(v, 1)) for i, v in enumerate(rng.normal(size=2500))]
    values[1800:2395] = [None] * 595  # a window with a handful of samples
    rows = [("a", T0 + timedelta(seconds=i), v, 1.0 * i) for i, v in enumerate(values)]
    df = frame(spark, rows, "station string, ts timestamp, v double, w double")
    for feature in (spectra.window_ks_normal, spectra.window_fft_features, spectra.window_welch_features):
        a, b = (feature(df, series.SlidingWindows(600, 600, max_rows=m), ["v", "w"]).orderBy("window_id").toPandas() for m in (10_000, 10))
        assert len(a) == 4
        for column in a.columns[3:]:
            np.testing.assert_allclose(a[column], b[column], rtol=1e-8, atol=1e-12, err_msg=column)
        assert a.filter(like="v_").iloc[1].isna().all() and a.filter(like="v_").iloc[0].notna().all()


def test_labels_ignore_broken_intervals_on_both_paths(spark):
    minute = timedelta(minutes=1)
    points = frame(spark, [(s, T0 + i * minute, i) for s in ("a", "b", None) for i in range(10)], "station string, ts timestamp, id int")
    broken = [("a", T0, T0 + 3 * minute), (None, T0, T0 + 9 * minute), ("b", T0 + 5 * minute, T0 + 2 * minute), ("b", None, T0), ("a", T0 + 2 * minute, None)]
    df = frame(spark, broken, "station string, start_ts timestamp, end_ts timestamp")
    for limit in (0, 1000):
        rows = intervals.label_points_by_interval(points, df, max_broadcast_rows=limit).collect()
        assert sorted((r.station, r.id) for r in rows if r.anomaly_label) == [("a", i) for i in range(4)] and len(rows) == 30


def test_files_are_chosen_by_their_schema(spark, tmp_path):
    root = str(tmp_path / "tree")
    frame(spark, [(1, None), (2, None)], "id int, kw double").write.parquet(f"{root}/nulls")
    frame(spark, [(3, 1.0)], "id int, kw double").write.parquet(f"{root}/a/b")
    frame(spark, [(4, "x")], "id int, other string").write.parquet(f"{root}/lacks")
    assert sorted(r.id for r in readers.scan_parquet_tree(spark, root, "kw").collect()) == [1, 2, 3]
    assert readers.scan_parquet_tree(spark, root, "absent").count() == 0


def test_months_are_looked_up_by_range(spark):
    """Readings of the event's station and month file between its ends; of an event that runs into the next month the first file only."""
    day = lambda m, d, h=0: datetime(2024, m, d, h)
    rows = [("a", day(1, 30, h), h) for h in range(24)] + [("a", day(2, 1), 90), ("b", day(1, 30, 3), 91), (None, day(1, 30, 3), 92)]
    monthly = frame(spark, rows, "station string, ts timestamp, id int").withColumns({"year": F.year("ts"), "month": F.month("ts"), "note": F.lit("r")})
    events = frame(
        spark, [("a", day(1, 30, 5), day(2, 3), "x"), ("a", day(1, 30, 2), day(1, 30, 3), "y"), (None, day(1, 30), day(1, 31), "z")],
        "station string, start_ts timestamp, end_ts timestamp, note string",
    )
    found = readers.month_partition_lookup(events, monthly, on=("station",), end="end_ts")
    assert found.columns == ["station", "year", "month", "start_ts", "end_ts", "interval_note", "file", "ts", "id", "note"]
    assert sorted((r.interval_note, r.id) for r in found.collect()) == [("x", h) for h in range(5, 24)] + [("y", 2), ("y", 3)]
    assert {r.file for r in found.collect()} == {"Januar_2024"}
    assert readers.month_partition_lookup(events.drop("note"), monthly, on=("station",)).count() == 2 * 24


def test_few_events_of_a_month_are_not_cut_into_pieces_of_time(spark, monkeypatch):
    """Events of a station's month that has few of them meet its readings as they are, only the others go through a range join; alike."""
    day = lambda d, h=0: datetime(2024, 1, d, h)
    monthly = frame(spark, [(s, day(d), 100 * s + d) for s in (1, 2) for d in range(1, 29)], "station long, ts timestamp, id int")
    monthly = monthly.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    rows = [(1, day(2), day(22))] + [(2, day(d), day(d + 4, 12)) for d in range(1, 13)] + [(2, day(9), day(8)), (3, day(1), day(9)), (1, day(3), None)]
    events = frame(spark, rows, "station int, start_ts timestamp, end_ts timestamp")
    joined, join = [], readers.interval_join
    monkeypatch.setattr(readers, "interval_join", lambda p, i, **k: joined.append(i.count()) or join(p, i, **k))
    look = lambda e: sorted((r.station, r.start_ts, r.id) for r in readers.month_partition_lookup(e, monthly, on=("station",), end="end_ts").collect())
    truth = sorted((s, a, 100 * s + d) for s, a, b in rows if s < 3 and b is not None for d in range(1, 29) if a <= day(d) <= b)
    assert look(events) == truth and joined == [13]
    assert look(events.where("station = 1")) == [t for t in truth if t[0] == 1] and joined == [13]


def test_scans_open_the_files_that_the_catalogue_chooses(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "daily")
    rows = [(s, f"2024-01-{d:02d}", T0 + timedelta(days=d), i) for i, (s, d) in enumerate([("a b", 3), ("a b", 4), ("c=d+", 2), ("c=d+", 9), (None, 5)])]
    df = frame(spark, rows, "station string, day string, ts timestamp, id int")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(1).write.partitionBy("station", "day").parquet(root)
    listed = {r.parts["day"]: r.parts["station"] for r in catalogue.list_files(spark, root).collect()}
    assert listed == {"2024-01-03": "a b", "2024-01-04": "a b", "2024-01-02": "c=d+", "2024-01-09": "c=d+", "2024-01-05": None}
    first, last = readers.scan_one_file_per_station(spark, root), readers.latest_snapshot(spark, root)
    assert sorted(r.id for r in first.collect()) == [0, 2] and sorted(r.id for r in last.collect()) == [1, 3]
    assert len(first.inputFiles()) == len(last.inputFiles()) == 2
    for direct in (catalogue.DIRECT, {}):  # in other stores Spark reads the files for the tasks
        monkeypatch.setattr(catalogue, "DIRECT", direct)
        found = catalogue.footers(spark, root, "ts").collect()
        assert sorted(r.low.replace(tzinfo=None) for r in found) == sorted(r[2].replace(tzinfo=None) for r in rows) and {tuple(r.columns) for r in found} == {("ts", "id")} and all(r.n_rows == 1 and r.low == r.high for r in found)
        low, high = (str(T0 + timedelta(days=d)) for d in (3, 5))
        between = catalogue.scan_between(spark, root, "ts", low, high)
        assert sorted(r.id for r in between.collect()) == [0, 1, 4] and len(between.inputFiles()) == 3
    assert catalogue.scan_between(spark, root, "ts", "1999-01-01", "1999-01-02").count() == 0
    with pytest.raises(ValueError):
        readers.latest_snapshot(spark, root, "line")


def test_streams_are_labelled_beyond_the_broadcast_limit(spark, tmp_path):
    points = frame(spark, [("a", T0 + timedelta(minutes=i), i) for i in range(10)], "station string, ts timestamp, id int")
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    labelled = intervals.label_points_by_interval(stream, spans(spark, [("a", 2, 4), ("a", 3, 6)]), max_broadcast_rows=0)
    out = streaming.run_available(labelled, str(tmp_path / "out"))
    assert sorted(r.id for r in out.where("anomaly_label = 1").collect()) == [2, 3, 4, 5, 6] and out.count() == 10


def test_batches_go_on_after_a_failure(spark, tmp_path):
    """Stopped in its third batch and run again, with a file that came in between: every row once."""
    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.range(1).schema
    failing = lambda rows: rows.select(F.when(F.col("id") == 25, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        streaming.scan_in_batches(spark, folder, schema, target, state, failing)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(20))
    spark.range(40, 50).coalesce(1).write.mode("append").parquet(folder)
    again = streaming.scan_in_batches(spark, folder, schema, target, state, lambda rows: rows.select("id"))
    assert sorted(r.id for r in again.collect()) == list(range(50))
    assert streaming.scan_in_batches(spark, folder, schema, target, state, lambda rows: rows.select("id")).count() == 50


def test_readings_at_the_same_time_are_kept_and_repeated_ones_are_not(spark, tmp_path):
    rows = frame(spark, [(1, "a", at(0), 1.0), (2, "a", at(0), 2.0), (3, "b", at(0), 1.0)], "event_id long, station string, ts timestamp, value double")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.stream_readings(spark, str(tmp_path / "in"), rows.schema)
    got = streaming.run_available(streaming.stream_dedup(stream, key=("event_id",)), str(tmp_path / "out"))
    assert sorted((r.event_id, r.value) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, 1.0)]


def test_intervals_that_come_between_two_batches_are_used(spark, tmp_path):
    folder, target, state, table = (str(tmp_path / n) for n in ("in", "out", "state", "intervals"))
    points = frame(spark, [("a", T0 + timedelta(minutes=i), i) for i in range(10)], "station string, ts timestamp, id int")
    spans(spark, [("a", 1, 2)]).write.parquet(table)
    known = lambda: spark.read.parquet(table)
    points.where("id < 5").write.parquet(folder)
    stream = streaming.stream_readings(spark, folder, points.schema)
    streaming.label_as_they_come(stream, known, target, state)
    spans(spark, [("a", 3, 7)]).write.mode("append").parquet(table)
    points.where("id >= 5").write.mode("append").parquet(folder)
    out = streaming.label_as_they_come(stream, known, target, state)
    assert sorted((r.id, r.anomaly_label) for r in out.collect()) == [(i, int(i in (1, 2, 5, 6, 7))) for i in range(10)]


def test_balanced_samples_take_the_first_of_each_class(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 10 < 9, 0).alias("label"))
    taken = sampling.balanced_sample(df, ["id"], 30, 0.2).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in taken} == {1: 6, 0: 24}
    repeated = sampling.balanced_oversample(df, ["id"], 50)
    assert repeated.where("label = 1").count() == 25 and repeated.where("label = 1").select("id").distinct().count() == 10
    assert repeated.where("label = 1").select("id", "copy").distinct().count() == 25 and repeated.where("label = 0").count() == 25


def test_wide_correlations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 372))
    x[:, 5] = x[:, 4] * 2 + 1
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"f{i}" for i in range(372)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).replace(float("nan"), None)
    got = profiles.correlation_matrix(df, names).toPandas().pivot(index="a", columns="b", values="r").loc[names, names]
    np.testing.assert_allclose(got.to_numpy(), pd.DataFrame(x).corr().to_numpy(), atol=1e-9)


def test_principal_components_keep_every_row(spark):
    df = frame(spark, [(i, float(i), float(i % 3) if i % 4 else None) for i in range(20)], "id int, x double, y double")
    assert ranking.pca_scores(df, ["x", "y"], 2, ["id"]).count() == 20
    assert ranking.finite(df, ["y"], "zero").where("id = 4").first().y == 0.0


def test_labels_by_order_equal_labels_by_join(spark):
    points = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("station"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), "id"
    )
    hour = timedelta(hours=1)
    df = frame(
        spark, [("a", datetime(1970, 1, 1) + h * hour, datetime(1970, 1, 1) + (h + 0.3) * hour) for h in range(24)]
        + [("b", datetime(1970, 1, 1, 5), datetime(1970, 1, 1, 9)), ("b", datetime(1970, 1, 1, 8), datetime(1970, 1, 1, 8, 10))],
        "station string, start_ts timestamp, end_ts timestamp",
    )
    joined = intervals.label_points_by_interval(points, df)
    ordered = intervals.label_points_by_interval(points, df, max_broadcast_rows=0)
    pick = lambda out: sorted((r["id"], r["anomaly_label"]) for r in out.collect())
    assert pick(joined) == pick(ordered) and 0 < sum(v for _, v in pick(joined)) < 3000


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = [0] * 20 + [1] * 39 + [2]
    df = frame(spark, [(i, [float(v) for v in row], y[i]) for i, row in enumerate(x)], "i long, x array<double>, label int")
    for power, fn in ((1, lambda: ranking.silhouette_by_label(df, "i", "x", block_rows=17)), (2, lambda: ranking.silhouette_squared(df, "i", "x"))):
        d = np.linalg.norm(x[:, None] - x[None], axis=2) ** power
        scores = []
        for i in range(60):
            own = [j for j in range(60) if y[j] == y[i] and j != i]
            if not own:
                scores.append(0.0)
                continue
            a = d[i, own].mean()
            b = min(d[i, [j for j in range(60) if y[j] == c]].mean() for c in {0, 1, 2} - {y[i]})
            scores.append((b - a) / max(a, b))
        assert fn().first()["silhouette"] == pytest.approx(np.mean(scores))
    assert ranking.silhouette_by_label(df.withColumn("label", F.lit(1)), "i", "x").first()["silhouette"] is None


def test_rows_of_distances_travel_to_few_tasks(spark, monkeypatch):
    """Groups are as large as a task can hold, so that what is shuffled follows the rows, and hold what they are told at most."""
    copies = lambda n, **sizes: sum(ranking._grid(n, n, **sizes))
    assert copies(120_000, most=65_536, block_rows=2048, tasks=48) == copies(240_000, most=65_536, block_rows=2048, tasks=48) <= 14
    assert copies(720_000, most=65_536, block_rows=2048, tasks=48) <= 22
    assert ranking._grid(2000, 720_000, most=65_536, block_rows=2048, tasks=48) == (1, 48)
    assert ranking._grid(0, 0, most=10, block_rows=10, tasks=48) == (1, 1)
    monkeypatch.setattr(ranking, "TASK_BYTES", 8 * 3 * 20)
    test_silhouette_in_blocks(spark)


def test_distances_of_float_vectors_leave_out_missing_labels(spark):
    rows = [(i, [float(i % 7), float(i % 5)], [0, 1, None][i % 3]) for i in range(50)]
    whole = frame(spark, rows, "i long, x array<double>, label int")
    known = whole.where("label IS NOT NULL")
    got = [ranking.silhouette_by_label(df, "i", "x", block_rows=8).first() for df in (whole, known, known.withColumn("x", F.col("x").cast("array<float>")))]
    assert got[0]["rows"] == got[1]["rows"] == 34
    assert got[0]["silhouette"] == pytest.approx(got[1]["silhouette"]) == pytest.approx(got[2]["silhouette"])


def test_ranks_share_ties_and_skip_missing(spark):
    rows = [("m", "a", 3.0), ("m", "b", 3.0), ("m", "c", 1.0), ("n", "a", 5.0), ("n", "b", None), ("n", "c", 9.0)]
    got = {r["feature"]: r for r in ranking.rank_and_mean_rank(frame(spark, rows, "method string, feature string, score double"), ["m", "n"]).collect()}
    assert (got["a"]["m_rank"], got["b"]["m_rank"], got["c"]["m_rank"]) == (1.5, 1.5, 3.0)
    assert got["b"]["n_rank"] is None and got["a"]["mean_rank"] == 1.75 and got["b"]["mean_rank"] == 1.5


def test_pca_against_numpy(spark):
    x = np.random.default_rng(6).normal(size=(200, 5))
    x[:, 1] += 2 * x[:, 0]
    names = [f"f{i}" for i in range(5)]
    df = frame(spark, [tuple(float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = ranking.standardised_pca_variance(df, names).orderBy("component").collect()
    np.testing.assert_allclose([r["ratio"] for r in got], values / values.sum(), atol=1e-9)
    loadings = ranking.pca_loadings(df, names).toPandas().pivot(index="feature", columns="component", values="loading")
    np.testing.assert_allclose(np.abs(loadings.to_numpy()), np.abs(vectors * np.sqrt(values)), atol=1e-6)
    assert ranking.pca_component_count(ranking.standardised_pca_variance(df, names)).first()[0] >= 4


def test_models_repeat_and_stay_in_range(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0.6)) for i, (a, b) in enumerate(rng.random((600, 2)))]
    df = frame(spark, rows, "i int, a double, b double, label int")
    features = ["a", "b"]
    train, rest = df.where("i < 400"), df.where("i >= 400")
    forest = models.fit_random_forest(train, features, numTrees=5, maxDepth=4)
    again = models.fit_random_forest(train, features, numTrees=5, maxDepth=4)
    scored = models.predict(forest, rest, features)
    first = [r["score"] for r in scored.orderBy("i").collect()]
    assert first == [r["score"] for r in models.predict(again, rest, features).orderBy("i").collect()]
    assert all(0 <= s <= 1 for s in first)
    importance = models.forest_importance(forest, features, spark).collect()
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0) and importance[0]["feature"] == "a"
    shuffled = models.permutation_importance(forest, rest, features, ["i"], repeats=2).collect()
    assert shuffled[0]["feature"] == "a" and shuffled[0]["importance"] > 0.05
    boosted = models.fit_boosted_trees(train, features, rest, maxIter=5, maxDepth=3)
    path = models.save_model(boosted, str(tmp_path), features, 0.3, {"maxIter": 5}, spark)
    loaded, meta = models.load_model(path, spark)
    assert meta["threshold"] == 0.3 and meta["features"] == features and meta["params"] == {"maxIter": 5}
    assert models.predict(loaded, rest, features).orderBy("i").collect() == models.predict(boosted, rest, features).orderBy("i").collect()
    trials, best = models.search_parameters(train, rest, features, ["i"], {"numTrees": ("int", 2, 4), "maxDepth": ("choice", [2, 3])}, 2)
    assert trials.count() == 2 and set(best) == {"numTrees", "maxDepth"}
    result = models.evaluate_saved_model(path, df, ["i"]).first()
    assert 0 <= result["f1"] <= 1 and result["adj_recall"] >= result["recall"]
    assert models.fit_linear(train, features)["a"] > 0


def test_halving_keeps_the_best_and_finds_what_the_full_search_finds(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), int((a + 0.5 * b > 0.7) != (c < 0.1))) for i, (a, b, c) in enumerate(rng.random((500, 3)))]
    df = frame(spark, rows, "i int, a double, b double, label int")
    train, rest, space = df.where("i < 350"), df.where("i >= 350"), {"maxDepth": ("int", 1, 4), "stepSize": ("log", 0.02, 0.4)}
    table, best, model = models.search_by_halving(train, rest, ["a", "b"], space, 4, rounds=8, factor=2)
    fits = table.collect()
    assert sorted((r.rung, r.rounds) for r in fits) == [(0, 2)] * 4 + [(1, 4)] * 2 + [(2, 8)]
    whole, truth = {}, []
    for trial, drawn in {r.trial: json.loads(r.params) for r in fits if r.rung == 0}.items():
        full, losses = models.boost_with_patience(train, ["a", "b"], rest, patience=8, maxIter=8, subsamplingRate=0.8, **drawn)
        whole[trial] = losses
        truth.append((min(losses), trial, full.getNumTrees, drawn))
    alive = set(whole)
    for rung, n in enumerate((2, 1, 1)):
        here = {r.trial: r for r in fits if r.rung == rung}
        assert set(here) == alive
        for trial, r in here.items():
            assert r.loss == pytest.approx(min(whole[trial][: r.rounds]), rel=1e-12) and whole[trial][r.best_round - 1] == pytest.approx(r.loss)
        alive = set(sorted(here, key=lambda trial: (here[trial].loss, trial))[:n])
        assert {trial for trial, r in here.items() if r.goes_on} == alive
    assert min(truth)[3] == best and min(truth)[2] == model.getNumTrees
    one = models.search_by_halving(train, rest, ["a"], space, 1, rounds=2)[0].collect()
    assert [(r.rung, r.rounds, r.goes_on) for r in one] == [(0, 2, True)]
    with pytest.raises(ValueError):
        models.search_by_halving(train, rest, ["a"], space, 2, factor=1)


def test_draws_stay_in_their_spaces():
    import random

    space = {"a": ("int", 1, 3), "b": ("float", 0.0, 1.0), "c": ("log", 1e-3, 1e-1), "d": ("choice", ["x", "y"])}
    for seed in range(20):
        d = models.draw(space, random.Random(seed))
        assert d["a"] in (1, 2, 3) and 0 <= d["b"] <= 1 and 1e-3 <= d["c"] <= 1e-1 and d["d"] in "xy"
    assert math.isclose(models.draw(space, random.Random(1))["b"], models.draw(space, random.Random(1))["b"])
