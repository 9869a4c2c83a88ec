"""What imports keep: the index of ids, sums by day, products in step, files that can be skipped."""

import datetime as dt
import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tallywright.functions import heavy_keys, may_match
from tallywright.operators import partner as P
from tallywright.operators import reports as R
from tallywright.operators import upsert as U
from tallywright.operators.catalog import new_product_names
from tallywright.operators.filters import SalesFilter
from tallywright.plans import derived as D
from tallywright.plans import star as S
from tallywright.plans.imports import ImportResult, merge_rows
from tallywright.plans.workspace import Workspace
from tallywright.schemas import ORDER_UPLOAD
from tallywright.sources.uploads import ROW_ORDER, UploadRejected

FIELDS = f"id string, content string, creation_date timestamp_ntz, utm_source string, income double, {ROW_ORDER} long"
EVER = {"start": "2020-01-01", "end": "2021-12-31"}


def batch(spark, rows):
    text = FIELDS.replace("timestamp_ntz", "string")
    full = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, text).withColumn("creation_date", F.col("creation_date").cast("timestamp_ntz"))


def drawn(r, ids):
    """Rows for the ids: some without a date, a text or an amount, months at random."""
    return [(
        str(i), r.choice(["tea", "cup", "pot", None]), r.choice([None, f"2020-{r.randint(1, 4):02}-{r.randint(1, 28):02} 12:30:00"]),
        r.choice(["a", "b", None]), r.choice([None, 0.0, -1.5, 0.1, 19.99, 1234.56]),
    ) for i in ids]


def jobs(spark, run):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A workspace after three random imports, and its orders as a dict."""
    r, space, want = random.Random(5), Workspace(spark, str(tmp_path_factory.mktemp("kept") / "tables")), {}
    for ids in (range(60), [*range(40, 75), *range(10)], r.sample(range(90), 30)):
        new = drawn(r, ids)
        result = merge_rows(space.store, ORDER_UPLOAD, batch(spark, new))
        assert result == ImportResult(sum(x[0] not in want for x in new), sum(x[0] in want for x in new))
        want |= {x[0]: x for x in new}
        space.product_days, space.source_days  # noqa: B018
    return space, want


def test_imports_by_index_equal_a_dict(grown):
    space, want = grown
    got = {o.id: (o.id, o.content, o.creation_date and str(o.creation_date), o.utm_source, o.income) for o in space.orders.collect()}
    assert got == want
    months = {o.id: o.creation_month for o in space.orders.collect()}
    assert {e.id: e.stored_month for e in D._newest(space.store.read(D.KEYS)).collect()} == months
    assert space.store.covers(D.KEYS) == space.store.state("orders")[0] == 3


def test_an_import_reads_the_buckets_and_months_of_its_keys(spark, grown):
    space, want = grown
    index = D.OrderKeys(space.store)
    one = batch(spark, [next(x for x in want.values() if x[2])])
    files = index.entries(one).inputFiles()
    assert len({f.split("key_bucket=")[1].split("/")[0] for f in files}) == 1
    assert rows(index.find(one)) == [(one.first().id, str(one.first().creation_date)[:7])]
    near = space._orders_near(one.select("id"))
    assert {f.split("creation_month=")[1].split("/")[0] for f in near.inputFiles()} == {str(one.first().creation_date)[:7]}
    assert rows(space.order(one.first().id).select("id")) == [(one.first().id,)] and space.order("none").count() == 0
    assert len(space.orders_by_ids(one.select("id").union(one.select("id"))).collect()) == 1


def test_reports_over_sums_equal_those_over_orders(grown, make_catalog):
    space, _ = grown
    catalog = make_catalog({"tea": ["A", "B"], "cup": ["A"], "pot": []})
    orders, sums, sources = space.orders.drop("creation_month"), space.product_days, space.source_days
    assert sums.count() < orders.count()
    for name, choice in {
        "sales_by_day": EVER, "product_daily": EVER | {"products": ["tea"]}, "product_cumulative": EVER | {"category": 1},
        "product_summary": {"start": "2020-02-10", "end": "2020-03-05"}, "paid_products": EVER, "max_creation_date": EVER,
        "category_revenue": {}, "monthly_sales": {}, "monthly_by_product": EVER | {"exclude_products": ["cup"]},
        "monthly_by_category": EVER | {"exclude_categories": [2]},
    }.items():
        report = getattr(R, name)
        assert rows(report(sums, catalog, **choice)) == rows(report(orders, catalog, **choice)), name
    contacts = space.contacts
    for choice in (EVER, {"start": "2020-02-10", "end": "2020-02-20"}):
        assert rows(P.partner_report(sources, contacts, **choice)) == rows(P.partner_report(orders, contacts, **choice))
    assert rows(R.freshness(sums, contacts)) == rows(R.freshness(orders, contacts))
    assert rows(R.order_count(sums)) == rows(R.order_count(orders)) == rows(space.order_count())
    assert sorted(rows(space.orders_by_source("a").select("id"))) == sorted(rows(orders.where("utm_source = 'a'").select("id")))
    text = plan(R.monthly_sales(sums, catalog, "2020-02-01", "2020-02-20"))
    assert "PartitionFilters: [isnotnull(creation_month" in text and "GreaterThanOrEqual(creation_date,2020-02-01)" in text


def test_only_written_months_are_summed_anew(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    assert space.product_days.count() == 0 and space.store.state("product_days") == (0, {})
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, [
        ("1", "tea", "2020-01-05", "a", 1.0), ("2", "tea", "2020-02-05", "a", 2.0), ("3", "cup", "2020-03-05", None, 3.0)]))
    assert space.product_days.count() == 3
    # order 2 moves: February has none left, March is written
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("2", "pot", "2020-03-06", "b", 5.0)]))
    assert space.store.changed("orders", 1) == {"2020-03"}
    assert {(str(r.creation_date), r.content, float(r.income)) for r in space.product_days.collect()} == {
        ("2020-01-05", "tea", 1.0), ("2020-03-05", "cup", 3.0), ("2020-03-06", "pot", 5.0)}
    assert space.store.state("product_days") == (2, {"2020-01": 1, "2020-03": 2})
    before = space.store.state("product_days")
    assert space.product_days.count() == 3 and space.store.state("product_days") == before


def test_an_interrupted_import_is_made_up_for(spark, tmp_path, monkeypatch):
    """The orders are published and the index is not: the next import takes the months in."""
    space = Workspace(spark, str(tmp_path / "tables"))
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("1", "tea", "2020-01-05", "a", 1.0), ("9", "tea", "2020-05-05", "a", 1.0)]))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(D.OrderKeys, "extend", dies)
        with pytest.raises(OSError):
            merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("1", "cup", "2020-02-05", "a", 2.0), ("2", "tea", "2020-02-06", "a", 2.0)]))
    assert (space.store.covers(D.KEYS), space.store.state("orders")[0]) == (1, 2)
    again = batch(spark, [("1", "cup", "2020-03-05", "a", 3.0), ("2", "tea", "2020-02-06", "a", 4.0), ("3", "tea", None, "a", 5.0)])
    assert merge_rows(space.store, ORDER_UPLOAD, again) == ImportResult(1, 2)
    assert sorted(rows(space.orders.select("id", "income"))) == [("1", 3.0), ("2", 4.0), ("3", 5.0), ("9", 1.0)]


def test_buckets_with_many_parts_are_compacted(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    for day in range(1, 6):
        merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("1", "tea", f"2020-0{day}-05", "a", 1.0)]))
    assert set(space.store.parts(D.KEYS).values()) == {5}
    index = D.OrderKeys(space.store, most_parts=3)
    marked = batch(spark, [("1", "tea", "2020-05-05", "a", 1.0)]).withColumns({D.MONTH: F.lit("2020-05"), "creation_month": F.lit("2020-05")})
    index.extend(marked, 5)
    assert set(space.store.parts(D.KEYS).values()) == {1}
    assert [tuple(r)[:3] for r in space.store.read(D.KEYS).collect()] == [("1", "2020-05", 5)]


def test_counts_come_with_the_marked_batch(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    twice = batch(spark, [("1", "tea", "2020-01-05", "a", 1.0)] * 2 + [("2", "tea", "2020-01-05", "a", 1.0)] * 3)
    with pytest.raises(UploadRejected, match=r"more than once in the orders upload \(5 rows\)"):
        merge_rows(space.store, ORDER_UPLOAD, twice)
    assert merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("1", "tea", "2020-01-05", "a", 1.0)]).limit(0)) == ImportResult(0, 0)
    first = batch(spark, [("1", "tea", "2020-01-05", "a", 1.0)])
    again = batch(spark, [("1", "tea", "2020-01-05", "a", 1.0), ("2", "tea", "2020-01-05", "a", 1.0), ("1", "cup", "2020-01-07", "a", 1.0)])
    assert merge_rows(space.store, ORDER_UPLOAD, first) == ImportResult(1, 0)
    assert jobs(spark, lambda: merge_rows(space.store, ORDER_UPLOAD, again)) <= 26  # many of them read a log of a few rows
    assert space.orders.count() == 2


def test_sync_reads_what_was_written_since(spark, tmp_path):
    r, space = random.Random(8), Workspace(spark, str(tmp_path / "tables"))
    for ids, months in ((range(6), "12"), (range(4, 9), "34"), (range(2), "1")):
        new = [(str(i), f"p{r.randint(0, 12)}", f"2020-0{r.choice(months)}-05", "a", 1.0) for i in ids]
        merge_rows(space.store, ORDER_UPLOAD, batch(spark, new))
        whole = new_product_names(space.orders, space.catalog.products)
        missing = {x.name for x in whole.collect()}
        known = {x.name for x in space.catalog.products.collect()}
        assert space.sync_products() == len(missing)
        assert {x.name for x in space.catalog.products.collect()} == known | missing
        assert space.store.covers("products") == space.store.state("orders")[0]
        assert space.sync_products() == 0


def scanned(frame):
    """Rows that the file scans of an executed plan passed on."""
    frame.collect()
    leaves, total = frame._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_lookups_skip_row_groups(spark, tmp_path):
    """The id is between the file's least and largest, so only its Bloom filter tells."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        space = Workspace(spark, str(tmp_path / "tables"))
        merge_rows(space.store, ORDER_UPLOAD, batch(spark, [(f"{i:04}", "tea", "2020-01-05", f"s{i % 7 * 2}", 1.0) for i in range(0, 3000, 3)]))
        orders = space.store.read("orders", {"2020-01"})
        assert scanned(orders.where("id = '0300'")) > 0 == scanned(orders.where("id = '0301'"))
        assert scanned(orders.where("utm_source = 's4'")) > 0 == scanned(orders.where("utm_source = 's5'"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_heavy_product_is_spread(spark, make_catalog):
    catalog = make_catalog({"hot": ["A", "B"], "cold": ["A"], **{f"p{i}": ["B"] for i in range(50)}})
    orders = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit(1.0).alias("income"), F.lit("2020-01-05").cast("timestamp_ntz").alias("creation_date"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('p', id % 50) WHEN id % 30 = 2 THEN NULL ELSE 'other' END").alias("content"))
    flt = SalesFilter(**EVER)
    heavy = heavy_keys(orders, "content", 0.2)
    assert sorted(heavy) == ["hot", "other"] and heavy_keys(orders.limit(0), "content") == []
    plain, dealt = R.linked_orders(orders, flt, catalog), R.linked_orders(orders, flt, catalog, heavy)
    assert plain.columns == dealt.columns and plain.exceptAll(dealt).count() == dealt.exceptAll(plain).count() == 0
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        most = lambda f: f.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most(R.linked_orders(orders, flt, catalog)) >= 2000
        assert most(R.linked_orders(orders, flt, catalog, heavy)) < 800
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_of_an_import_are_written_once(spark, tmp_path, monkeypatch):
    """Unique keys over rows without other fields: only keys are joined, whole rows are neither reduced nor merged."""
    space = Workspace(spark, str(tmp_path / "tables"))
    for name in ("last_rows", "merged"):
        monkeypatch.setattr(f"tallywright.operators.upsert.{name}", lambda *_, name=name: pytest.fail(f"{name} shuffles whole rows"))
    first = [(str(i), "tea", f"2020-0{i % 3 + 1}-05", "a", float(i)) for i in range(9)]
    assert merge_rows(space.store, ORDER_UPLOAD, batch(spark, first)) == ImportResult(9, 0)
    assert merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("1", "cup", "2020-05-05", None, None), ("x", None, None, "b", 2.0)])) == ImportResult(1, 1)
    got = {o.id: (o.content, o.creation_date and str(o.creation_date)[:10], o.utm_source, o.income) for o in space.orders.collect()}
    want = {r[0]: r[1:] for r in first} | {"1": ("cup", "2020-05-05", None, None), "x": (None, None, "b", 2.0)}
    assert got == want
    assert {e.id: e.stored_month for e in D._newest(space.store.read(D.KEYS)).collect()} == {k: (v[1] or "none")[:7] for k, v in want.items()}
    assert space.store.state("orders") == (2, {"2020-01": 1, "2020-02": 2, "2020-03": 1, "2020-05": 2, "none": 2})


def test_fields_that_a_batch_does_not_carry_stay(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    old = batch(spark, [(k, "tea", "2020-01-05", "a", 1.0) for k in "123"])
    merge_rows(space.store, ORDER_UPLOAD, old.withColumn("tags", F.concat(F.lit("t"), "id")))
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("2", "pot", "2020-01-06", "b", 1.0), ("4", "cup", "2020-01-06", "b", 1.0), ("2", "cup", "2020-02-07", "c", 2.0)]))
    assert sorted(rows(space.orders.select("id", "content", "tags", "creation_month"))) == [
        ("1", "tea", "t1", "2020-01"), ("2", "cup", "t2", "2020-02"), ("3", "tea", "t3", "2020-01"), ("4", "cup", None, "2020-01")]
    assert rows(D._newest(space.store.read(D.KEYS)).filter("id = '2'")) == [("2", "2020-02")]


def test_a_refused_upload_leaves_nothing_to_read(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    one = batch(spark, [("1", "tea", "2020-01-05", "a", 1.0)])
    merge_rows(space.store, ORDER_UPLOAD, one)
    with pytest.raises(UploadRejected, match="2 rows"):
        merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("2", "tea", "2020-01-05", "a", 1.0)] * 2 + [("1", "pot", "2020-01-05", "a", 1.0)]))
    assert rows(space.orders.select("id", "content")) == [("1", "tea")] and space.store.state("orders")[0] == 1
    assert merge_rows(space.store, ORDER_UPLOAD, batch(spark, [("3", "tea", "2020-03-05", "a", 1.0)])) == ImportResult(1, 0)
    assert sorted(rows(space.orders.select("id"))) == [("1",), ("3",)]


def test_lines_are_shuffled_by_order_only(spark, tmp_path):
    """Lines that share an id or differ by a null in it are grouped as the SQL says, without a shuffle by id."""
    folder, tables = str(tmp_path), {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string", [
            (1, 5, 7, 1, 10.0, 0.1, "N"), (1, 5, 7, 1, 20.0, 0.0, "A"), (2, 5, None, 3, 1.0, 0.0, "N"), (2, 3, 5, None, 2.0, 0.0, "N"), (3, 5, 7, 1, 9.0, 0.5, "R"),
            (4, 8, 7, 2, 9.0, None, None), (4, 9, 7, 2, 9.0, 0.0, "N"), (None, 5, 7, 1, 9.0, 0.0, "N"), (14, 5, 7, 1, 9.0, 0.0, "N")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz", [
            (k, c, s, dt.datetime(1997, 1, 5)) for k, c, s in ((1, 1, "O"), (2, 1, "P"), (3, None, "P"), (4, 2, None), (14, 2, "F"), (14, 2, "F"), (None, 1, "O"))]),
        "part": ("p_partkey long, p_name string, p_size int", [(5, "tea", 1), (3, "tea", None), (8, "cup", 50), (9, None, 2)]),
    }
    for name, (schema, made) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{folder}/{name}.parquet")
    for sql in (S.SALES_BEFORE, S.SALES_BATCH):
        plainly, by_order = S.frame(spark, folder, sql), S.sales_lines(spark, folder, sql)
        assert sorted(map(str, rows(by_order))) == sorted(map(str, rows(plainly))) != []
        text = plan(by_order, "simple")
        assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(id" not in text
        assert by_order.schema == plainly.schema


def exchanges(frame):
    return plan(frame, "simple").count("Exchange hashpartitioning")


def test_rows_are_left_out_with_one_shuffle(spark):
    """What stays lies by slot and piece, where it is written; nulls and equal keys in other slots stay."""
    stored = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "a", 3), ("2", "a", 4), (None, "a", 5), ("3", None, 6)], "id string, slot string, n int")
    gone = spark.createDataFrame([("1", "a"), ("2", "a"), ("9", "b")], "id string, slot string")
    for piece in (F.lit(0), F.pmod(F.xxhash64("id"), F.lit(3))):
        left = U.without(stored, gone, "id", "slot", piece)
        assert left.columns == stored.columns and exchanges(left) == 1
        assert sorted(r.n for r in left.collect()) == [2, 5, 6]


def test_keys_are_marked_with_one_shuffle(spark):
    new = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), (None, "a"), (None, "a")], "id string, slot string")
    old = spark.createDataFrame([("1", "c"), ("3", "c"), (None, "c")], "id string, now string")
    for place in ([], [F.col("id").substr(1, 1), F.lit(0)]):
        marked = U.marked_keys(new, old, "id", "slot", "now", place)
        want = {("1", 2, "b", "c", True), ("2", 1, "a", None, False), (None, 2, "a", None, False)}
        assert exchanges(marked) == 1 and set(map(tuple, marked.select("id", U.COPIES, "slot", "now", U.FOUND).collect())) == want
        assert {(r.id, r[U.FOUND]) for r in U.marked_keys(new, None, "id", "slot", "now", place).collect()} == {("1", False), ("2", False), (None, False)}


def test_keys_of_the_same_month_add_nothing_to_the_index(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    both = [("1", "tea", "2020-01-05", "a", 1.0), ("2", "tea", "2020-01-05", "a", 1.0)]
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, both))
    assert merge_rows(space.store, ORDER_UPLOAD, batch(spark, [both[0], ("2", "tea", "2020-02-05", "a", 1.0)])) == ImportResult(0, 2)
    assert sorted(tuple(r)[:3] for r in space.store.read(D.KEYS).collect()) == [("1", "2020-01", 1), ("2", "2020-01", 1), ("2", "2020-02", 2)]
    assert sorted(rows(space.orders.select("id", "creation_month"))) == [("1", "2020-01"), ("2", "2020-02")]


def test_large_months_are_cut_into_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallywright.sources.tables.PIECE", 300)
    space, want = Workspace(spark, str(tmp_path / "tables")), {}
    for first in (0, 40):
        new = [(str(i), "tea", f"2020-01-{i % 28 + 1:02}", "a", float(i + first)) for i in range(first, first + 80)]
        merge_rows(space.store, ORDER_UPLOAD, batch(spark, new))
        want |= {r[0]: r[4] for r in new}
    assert {r.id: r.income for r in space.orders.collect()} == want and space.orders.count() == 120
    assert space.orders.select(space.store.piece("orders", {"2020-01"}, "id")).distinct().count() > 1
    assert space.orders.select(space.store.piece("orders", set(), "id")).distinct().count() == 1


def test_a_look_up_ends_when_all_months_are_found(spark, tmp_path):
    """Many ids: a few buckets of the index name all months, and the orders are sifted before they are shuffled."""
    space = Workspace(spark, str(tmp_path / "tables"))
    merge_rows(space.store, ORDER_UPLOAD, batch(spark, [(str(i), "tea", f"2020-0{i % 2 + 1}-05", "a", 1.0) for i in range(1500)]))
    index, read = D.OrderKeys(space.store), []
    whole = space.store.read
    space.store.read = lambda name, slots=None: (read.append(slots) if name == D.KEYS else None) or whole(name, slots)
    asked = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("id"))
    assert index.months(asked) == {"2020-01", "2020-02"} and sum(map(len, read)) < 64
    assert index.months(asked.filter("id = '3'")) == {"2020-02"} and index.months(asked.filter("id = '2997'")) == set()
    del space.store.read
    assert {r.id for r in space.orders_by_ids(asked.union(asked)).collect()} == {str(i) for i in range(0, 1500, 3)}
    sifted = may_match(space.orders, asked, "id")
    assert sifted.columns == space.orders.columns and 500 <= sifted.count() < 520
    assert may_match(space.orders, asked, "id", 64).join(asked, "id", "left_semi").count() == 500


def test_lines_carry_their_amount(spark):
    text = S._LINES_BY_ORDER + S._LINES_OF_PARTS
    assert text.count("l_extendedprice") == 1 and "l_returnflag" not in S._LINES_BY_ORDER
