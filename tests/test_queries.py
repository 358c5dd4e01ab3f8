"""Every registered query against the equivalent SQL, and that the entry point imports."""

import re
import subprocess
import sys

import pytest
from oracle import DATA, ROOT, TABLES, assert_same, connect

from ledgerline import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name], con)


@pytest.fixture
def items_without_events(tmp_path):
    """The given tables with orders for two thirds of the customers only."""
    con = connect()
    for t in TABLES:
        if t != "orders":
            (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    con.execute(f"copy (select * from orders where o_custkey % 3 <> 0) to '{tmp_path}/orders.parquet' (format parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["items_all_latest_event", "items_latest_event"])
def test_items_without_events(spark, items_without_events, name):
    con = connect(items_without_events)
    assert con.execute("select count(*) from customer where c_custkey not in (select o_custkey from orders)").fetchone()[0] >= 50
    assert_same(QUERIES[name](spark, items_without_events), SQL[name], con)


def test_queries_are_known_without_a_session():
    """The entry point is read in a process that has no session."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_catalyst_without_need(spark, name):
    """Python runs in the state machines only, and no plan has a product of two tables."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in {"rate_limited_requests", "breaker_states", "degradation", "patch_skips"})
    assert "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["facts_of_a_month"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull") >= 2 and "l_quantity" not in plan
