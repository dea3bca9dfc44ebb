"""The registered text queries at a small scale: oracles, held-out accuracy, the pipeline."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from compare import connect, difference, duck_table, spark_table  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidemark.llm import queries as llm  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_all_are_registered():
    assert set(llm.QUERIES) <= set(entry.queries()) and set(llm.ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_equals_oracle(spark, name):
    assert difference(spark_table(llm.QUERIES[name](spark, SF_DIR)), duck_table(connect(SF_DIR), llm.ORACLES[name])) is None


def test_classifier_on_held_out_labels(spark):
    scored = llm.QUERIES["op2_rule_ensemble"](spark, SF_DIR)
    rows = scored.join(llm.table(spark, SF_DIR, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_languages_of_held_out_texts(spark):
    found = llm.QUERIES["op11_language_id"](spark, SF_DIR)
    rows = found.join(llm.table(spark, SF_DIR, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_pipeline_stages(spark):
    docs = llm.table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns, name
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count() > 0
