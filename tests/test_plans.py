"""What the plans must and must not contain."""

import re

import pytest
from helpers import plan

import __spark_entry__ as entry
from tallywright.operators import partner as P
from tallywright.operators import reports as R
from tallywright.operators import upsert as U
from tallywright.plans import star as S

FOLDER = "/root/testdata/sf0.001"
PERIOD = {"start": "1997-01-01", "end": "1997-02-28"}


@pytest.fixture
def star(spark):
    return S.star(spark, FOLDER)


def test_period_reaches_the_files(star):
    """Of the given tables, and of orders stored by month."""
    text = plan(R.monthly_sales(star.orders, star.catalog, **PERIOD))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in text
    assert "LessThanOrEqual(o_orderdate,1997-02-28T23:59:59.999999)" in text
    text = plan(R.monthly_sales(star.stored_orders(), star.catalog, **PERIOD))
    assert "creation_month=1997-01" in text or re.search(r"PartitionFilters: \[.*creation_month.* >= 1997-01", text)
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThan(income,0.0)" in pushed
    assert "GreaterThanOrEqual(creation_date,1997-01-01T00:00)" in pushed
    assert "LessThanOrEqual(creation_date,1997-02-28T23:59:59.999999)" in pushed


def test_only_needed_columns_are_read(star):
    text = plan(R.monthly_sales(star.stored_orders(), star.catalog, **PERIOD))
    assert re.search(r"ReadSchema: struct<creation_date:timestamp_ntz,income:double>", text)


def test_star_tables_follow_their_source(spark, tmp_path):
    """Dimensions are stored once, and again when the source changes or they are gone."""
    import shutil

    for name in S.RAW_TABLES:
        shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    star = S.Star(spark, str(tmp_path))
    first = star.products
    assert star.products is first
    spark.read.parquet(f"{FOLDER}/part.parquet").limit(3).toPandas().to_parquet(tmp_path / "part.parquet")
    second = star.products
    assert second is not first and second.count() == second.distinct().count() <= 3
    shutil.rmtree(second.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert star.products.count() <= 3


def test_orders_are_grouped_before_they_meet_other_tables(star):
    orders = star.stored_orders()
    for frame in (
        R.monthly_by_category(orders, star.catalog, **PERIOD),
        R.category_revenue(orders, star.catalog),
        R.product_summary(orders, star.catalog, (), **PERIOD, category=1),
        P.partner_report(orders, star.contacts, **PERIOD),
    ):
        text = plan(frame, "simple")
        scan = next(i for i, line in enumerate(text.splitlines()) if "creation_date" in line and "FileScan" in line
                    or "income" in line and "FileScan" in line)
        above = text.splitlines()[:scan][::-1]
        first = next(line for line in above if "Join" in line or "Aggregate" in line)
        assert "HashAggregate" in first


def test_one_pass_over_the_orders_for_totals(star):
    queries = entry.queries()
    for name in ("product_summary_totals", "monthly_by_category_totals", "paid_products_totals"):
        text = plan(queries[name](star.spark, FOLDER), "simple")
        assert len(re.findall(r"FileScan.*l_extendedprice", text)) == 1, name


def test_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    current = S.frame(spark, FOLDER, S.CURRENT_ORDERS)
    path = str(tmp_path / "current")
    current.write.parquet(path)
    current = spark.read.parquet(path)
    last = U.last_rows(S.frame(spark, FOLDER, S.INCOMING_ORDERS).limit(10))
    last.write.parquet(str(tmp_path / "last"))
    last = spark.read.parquet(str(tmp_path / "last"))
    found = U.stored_keys(current, last)
    assert "Exchange hashpartitioning" not in plan(found, "simple")
    marked = U.mark_stored(last, found)
    marked.write.parquet(str(tmp_path / "marked"))
    merged = U.merged(current, spark.read.parquet(str(tmp_path / "marked")))
    assert "Exchange hashpartitioning" not in plan(merged, "simple")


def test_batch_copies_are_reduced_before_the_shuffle(spark):
    last = U.last_rows(S.frame(spark, FOLDER, S.REPEATED_ORDERS))
    assert "partial_max_by" in plan(last, "simple")


def test_hints_force_no_broadcast():
    import pathlib

    for path in pathlib.Path(entry.__file__).parent.joinpath("tallywright").rglob("*.py"):
        if "llm" in path.parts:  # broadcasts models of fixed size to its own tasks
            continue
        assert "broadcast(" not in path.read_text(encoding="utf-8"), path
