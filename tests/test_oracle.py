"""Every registered query with SQL against DuckDB, on the smallest tables that give it rows."""

import pytest

from tests.oracle import compare
from voltlane.queries import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: queries that need more readings to have complete windows
SPARSE = {
    "sliding_windows", "window_label", "window_midpoint", "window_mean_std", "window_change_point", "window_skew", "window_trend_slope",
    "window_ks_normal", "window_fft_features", "window_welch_features", "window_features", "band_energy_ratio", "sample_anomaly_windows",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem = compare(name, spark, LARGER if name in SPARSE else SF)
    assert problem is None, problem


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
