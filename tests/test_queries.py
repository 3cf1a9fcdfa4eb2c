import pytest

import verify_local
from __spark_entry__ import entry, oracle_sql, queries
from fpindex.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def connection():
    return verify_local.oracle_connection("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_oracle(spark, connection, sf_dir, name):
    assert verify_local.compare(spark, sf_dir, name, connection) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_flagship(spark):
    assert entry(spark).count() > 0


def test_no_query_multiplies_rows_or_collects_groups(spark, sf_dir):
    """No cartesian products, no single-partition windows, no local relations read back."""
    for name, query in QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        for line in plan.splitlines():
            if "Window " in line:
                assert "_salt" in line or "rule_id" in line, (name, line)
