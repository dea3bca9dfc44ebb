"""Queries that name, lock or check every row."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.sources import driver_tables as D

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_every_outcome_is_named_and_locked(spark):
    outcomes = D.outcomes(spark, SF_DIR).count()
    named = entry.queries()["history_as_of_all"](spark, SF_DIR)
    assert named.select("series", "outcome_id").distinct().count() == outcomes
    assert entry.queries()["reconstruct_prior_all"](spark, SF_DIR).count() == outcomes


def test_every_record_is_checked(spark):
    checked = entry.queries()["unique_key_check_all"](spark, SF_DIR).collect()
    assert sum(r.records for r in checked) == D.events(spark, SF_DIR).count()
