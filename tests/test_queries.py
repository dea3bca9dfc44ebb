"""Every registered query against its DuckDB oracle; the sliced path gives the same."""

import os

import pytest
from compare import connect, difference, duck_table, spark_table

import __spark_entry__ as entry
from tidemark.plans.ordering import TASK_ROWS_CONF

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLICED = [
    "numeric_summary", "dataset_fingerprint", "assign_interval", "trailing_window_join",
    "lag_log_features", "prefix_counts", "window_state_features", "frequency_forecast_rolling",
    "walk_forward_frequency", "forward_gate", "strip_insertions", "marker_class_enrichment",
    "exact_match_leak_audit", "onset_gap_summary",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    assert difference(spark_table(QUERIES[name](spark, SF_DIR)), duck_table(con, ORACLES[name])) is None


@pytest.mark.parametrize("name", SLICED)
def test_sliced_equals_oracle(spark, con, name):
    spark.conf.set(TASK_ROWS_CONF, "40")
    try:
        assert difference(spark_table(QUERIES[name](spark, SF_DIR)), duck_table(con, ORACLES[name])) is None
    finally:
        spark.conf.unset(TASK_ROWS_CONF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_stable_schema(spark, name):
    assert QUERIES[name](spark, SF_DIR).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
