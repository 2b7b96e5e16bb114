"""Physical plans: no whole sequence on one task, no Python where none is needed, pruned scans, no joins by loop."""

import io
from contextlib import redirect_stdout

import pytest

from voltlane.operators import ranking, sampling, series
from voltlane.plans.joins import interval_join
from voltlane.queries import QUERIES, fixtures

SF = "/root/testdata/sf0.001"


def gathers_rows(df):
    """Whether anything but the partial result of a one-row aggregate goes to a single partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return any("SinglePartition" in a and "HashAggregate(keys=[]" not in b for a, b in zip(lines, lines[1:]))


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["merge_intervals", "intervals_between_rows", "point_adjustment", "seasonal_decompose",
                                  "window_mean_std", "regularise_ffill", "label_points_by_interval", "sequence_windows",
                                  "stratified_split", "interval_coverage"])
def test_no_single_partition_and_no_python(spark, name):
    df = QUERIES[name](spark, SF)
    assert not gathers_rows(df)
    text = plan(df)
    assert "Python" not in text and "InPandas" not in text


def test_small_intervals_are_broadcast_and_large_ones_shuffled(spark):
    points, spans = fixtures.readings(spark, SF), fixtures.intervals(spark, SF)
    small = plan(interval_join(points, spans))
    assert "BroadcastHashJoin" in small and "NestedLoop" not in small
    large = plan(interval_join(points, spans, max_broadcast_rows=10))
    assert "NestedLoop" not in large and "Cartesian" not in large and "_salt" in large


def test_scans_read_only_what_is_used(spark):
    text = plan(series.downsample_time(fixtures.readings(spark, SF), ["value"], 3600))
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schemas and all("event_id" not in line for line in schemas)
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in text


def test_copies_of_removed_keys_are_dropped_before_the_join(spark):
    rows = spark.range(20).selectExpr("id % 10 AS k")
    found = sampling.difference_timestamps(rows, rows.where("k > 6"), ["k"])
    sides = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1]
    assert "Aggregate" in sides  # of the removed keys; the distinct of the others may come after the join
    assert sorted(r.k for r in found.collect()) == list(range(7))


def test_neighbours_are_written_before_all_values_are_put_in_order(spark, monkeypatch):
    seen, within = [], ranking._rows_within
    monkeypatch.setattr(ranking, "_rows_within", lambda counts, near, label: seen.append(plan(near)) or within(counts, near, label))
    QUERIES["mutual_information_nearest"](spark, SF)
    assert len(seen) == 1 and "Window" not in seen[0]


def test_window_statistics_move_rows_once(spark):
    spec = series.SlidingWindows(86400, 21600, expected=24)
    rows = series.downsample_time(fixtures.readings(spark, SF), ["value"], 3600)
    text = plan(series.window_change_point(rows, spec, ["value"]))
    tree = text.split("(1) Scan")[0]
    # one for the slots, one for the rows of each pane, one for the panes of each window; the station bounds are a written side table
    assert tree.count("Exchange") - tree.count("BroadcastExchange") == 3
    # rows are not multiplied: the one Generate comes after their aggregate into panes
    assert tree.count("Generate") == 1 and tree.index("Generate") < tree.index("HashAggregate", tree.index("Generate"))
