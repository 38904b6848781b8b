"""Queries against their SQL. ``FULL=1`` runs every registered query at sf0.01, else a spread at sf0.001."""

import os

import pytest
from compare import compare, duck

from fleetpulse.registry import catalog

catalog.load_all()
FULL = os.environ.get("FULL") == "1"
SF = "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001"
SPREAD = ["a2_earliest_failure", "a5_median_fallback", "w1_w2_fill_long_series", "w3_row_windows", "w3_row_windows_long_series",
          "p7_split", "r7_window_subsample", "x1_frame_statistics", "m1_best_threshold", "m3_curve_threshold", "a14_sum_rounds",
          "f12_f14_t7_parse_answers", "j4_embedding_prototypes"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES) if FULL else SPREAD)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, catalog.QUERIES[name], catalog.SQL.get(name), SF)
    assert ok, note


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
