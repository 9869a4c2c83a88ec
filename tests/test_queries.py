"""Every registered query against its SQL, all rows, exactly."""

import os

import compare
import pytest
from helpers import plan, rows

import __spark_entry__ as entry
from tallywright.plans.oracle import oracle_queries
from tallywright.plans.registry import all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), oracle_queries()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    assert compare.differences(frame, con, ORACLES[name]) == ""
    shown = plan(frame)
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "LocalTableScan"):
        assert node not in shown, f"{node} in the plan of {name}"


def test_all_are_registered():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "month", "category", "total_sales", "total_orders", "paid_orders"
    ]


def test_registered_queries_return_rows(spark, con):
    empty = [n for n, q in ORACLES.items() if not con.execute(f"SELECT 1 FROM ({q}) q LIMIT 1").fetchall()]
    assert empty == []


def test_totals_equal_the_sum_of_rows(spark):
    report = rows(QUERIES["monthly_by_product_totals"](spark, FOLDER))
    # month, product, total_sales, total_orders, paid_orders, is_total
    total = [r for r in report if r[5]]
    parts = [r for r in report if not r[5]]
    assert len(total) == 1
    assert total[0][2] == pytest.approx(sum(r[2] for r in parts))
    assert total[0][4] == sum(r[4] for r in parts)


def test_running_income_ends_at_the_sum(spark):
    days = rows(QUERIES["product_cumulative"](spark, FOLDER).orderBy("date"))
    assert days[-1][4] == pytest.approx(sum(d[1] for d in days if d[1] is not None))


def test_shares_sum_to_one(spark):
    assert sum(r.share for r in QUERIES["category_share"](spark, FOLDER).collect()) == pytest.approx(1)
