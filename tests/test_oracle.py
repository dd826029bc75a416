"""Every registered query against its DuckDB twin (row count, column names,
order-insensitive value hash), the same check the driver makes."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK
from harness import compare

QUERIES = sorted(E.QUERIES)  # the llm queries have tests of their own
ORACLE = E.oracle_sql()


def test_every_query_but_model_ones_has_a_twin():
    missing = [q for q in QUERIES if q not in ORACLE]
    assert missing == ["compare_models_with_logistic", "predict_joint_heads", "train_joint_heads", "train_logistic_heads"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["doc_id", "type"]
    assert df.count() == 200


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, duck_check, name):
    r = compare(spark, name, SF_CHECK, duck_check)
    if name not in ORACLE:
        assert r["spark_rows"] > 0
        return
    assert r["cols_match"], r
    assert r["hash_match"], r
