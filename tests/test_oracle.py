"""Every query with SQL gives the rows of its SQL; every other one runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_match_sql(spark, con, data, name):
    said, _ = compare.compare(spark, con, data, name)
    assert said.startswith("ok"), said
    assert "types" not in said, said


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, con, data, name):
    said, _ = compare.compare(spark, con, data, name)
    assert said.startswith("rows only"), said
    assert "(0)" not in said


def test_entry(spark, data):
    assert entry(spark).count() > 0


def test_plans_have_no_nested_loops(spark, data):
    """No registered query joins everything with everything or runs Python per row."""
    for name in ("L1_assemble_fill_scale", "I8_population", "J4_city_zip_population", "K3_group_folds_mixed_labels", "H4_over_sample"):
        plan = queries()[name](spark, data)._jdf.queryExecution().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (name, bad)
