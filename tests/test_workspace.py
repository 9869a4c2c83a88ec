import csv
import os

import pytest
from helpers import rows
from test_uploads import SAMPLE, write_orders

from tallywright.plans.imports import ImportResult
from tallywright.plans.workspace import Workspace
from tallywright.schemas import CONTACT_HEADERS, SHARED_SOURCE, TOTAL_LABEL
from tallywright.sources.uploads import UploadRejected
from tallywright.streaming.drops import watch_uploads

PERIOD = {"start": "2021-01-01", "end": "2021-12-31"}


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("workspace")
    space = Workspace(spark, str(folder / "tables"))
    assert space.import_orders(write_orders(folder / "orders.csv")) == ImportResult(4, 0)
    path = folder / "contacts.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(CONTACT_HEADERS)
        for key, name in (("mail", "Search"), ("shop", "NA"), ("", "nobody")):
            cells = {"id": key, "full_name": name, "creation_date": "2023-05-01 22:30:00"}
            writer.writerow([cells.get(f, "1") for f in CONTACT_HEADERS.values()])
    assert space.import_contacts(str(path)) == ImportResult(2, 0)
    assert space.import_contacts(str(path)) == ImportResult(0, 2)
    assert space.sync_products() == 4
    assert space.sync_products() == 0
    made = {r.name: r.id for r in space.create_categories(["Books", "Toys"]).collect()}
    assert sorted(made.values()) == [1, 2]
    ids = {r.name: r.id for r in space.catalog.products.collect()}
    space.assign_categories({ids["Teapot, blue"]: [1, 2], ids["Lamp"]: [1]})
    return space


def test_tables_are_cut_into_slots(filled):
    assert set(filled.store.state("orders")[1]) == {"2021-06"}
    assert filled.contacts.count() == 2
    assert filled.orders.columns[-1] == "creation_month"


def test_general_tab(filled):
    days = rows(filled.general_tab(**PERIOD)["daily"])
    assert [(d.day, float(v)) for d, v in days] == [(7, 150), (8, 900), (9, 70), (12, 0)]


def test_product_tab(filled):
    tab = filled.product_tab(**PERIOD, category=1, base=2000)
    assert [tuple(map(str, r)) for r in tab["daily"].collect()] == [
        ("2021-06-07", "1", "150.00", "150.00", "7.50%", "7.50%"),
        ("2021-06-08", "1", "900.00", "1050.00", "52.50%", "45.00%"),
    ]
    assert [(r[0], r[1], float(r[2]), float(r[3])) for r in tab["summary"].collect()] == [
        ("Lamp", 1, 900, 900), ("Teapot, blue", 1, 150, 150), (TOTAL_LABEL, 2, 1050, 525)
    ]
    assert tab["latest"].first()[0].day == 8
    nothing = filled.product_tab(**PERIOD)
    assert [nothing[n].count() for n in ("daily", "summary", "totals")] == [0, 0, 0]


def test_period_tab(filled):
    table = filled.period_tab(**PERIOD)["table"].collect()
    assert [(r[0], r[1], float(r[2])) for r in table][-1] == (TOTAL_LABEL, 3, 1120)
    assert len(table) == 4


def test_category_tab(filled):
    tab = filled.category_tab()
    assert [(r[0], float(r[1])) for r in tab["table"].collect()] == [
        ("Books", 1050), ("Toys", 150), (TOTAL_LABEL, 1200)
    ]
    assert sum(r.share for r in tab["shares"].collect()) == pytest.approx(1)
    assert filled.category_tab(exclude=[1])["table"].first()[0] == "Toys"


def test_partner_tab(filled):
    tab = filled.partner_tab(**PERIOD, exclude_common=False, show_income=True)
    assert [(r[0], r[1], r[2], float(r[3])) for r in tab["table"].collect()] == [
        (SHARED_SOURCE, "shop", 1, 900), ("Search", "mail", 2, 150), (SHARED_SOURCE, "search", 1, 70)
    ]
    assert tab["by_registrations"].first().partner == "Search"
    assert filled.partner_tab(**PERIOD)["table"].columns == ["Партнер", "UTM Source", "Количество регистраций"]


def test_monthly_tab(filled):
    tab = filled.monthly_tab(**PERIOD)
    assert rows(tab["monthly"]) == [("2021-06", "1 120.00", 3), (TOTAL_LABEL, "1 120.00", 3)]
    assert rows(tab["by_product"])[-1] == (TOTAL_LABEL, "", "1 120.00", 3)
    assert rows(tab["by_category"]) == [
        ("2021-06", "Books", "1 050.00", 2), ("2021-06", "Toys", "150.00", 1), (TOTAL_LABEL, "", "1 200.00", 3)
    ]
    line = tab["by_category_summary"].first()
    assert (float(line.total_sales), line.paid_orders, line.average_check) == (1200, 3, 400)
    chosen = filled.monthly_tab(**PERIOD, categories=[1], exclude_products=["Lamp"])
    assert rows(chosen["by_product"])[0] == ("2021-06", "Teapot, blue", "150.00", 1)


def test_freshness(filled):
    shown = filled.freshness().first()
    assert shown.latest_order_text == "12-06-2021 03:00"
    assert shown.latest_contact_text == "02-05-2023 01:30"


def test_export(filled, tmp_path):
    paths = filled.export_all(str(tmp_path / "out"))
    assert set(paths) == set(filled.tables())
    folder = paths["orders"]
    text = "".join(
        open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.endswith(".csv")
    )
    assert "2021-06-07 00:00:00" in text
    assert text.startswith("id,number,contact_name,contact_surname,recipient_last_name,")
    assert '"it""s"' in text and '""' not in text.replace('"it""s"', "")


def test_jobs_leave_no_scratch_folders(filled, spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    filled.assign_categories({})
    filled.sync_products()
    assert set(os.listdir(shared)) == before


def test_malformed_upload_stores_nothing(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    broken = SAMPLE | {"tags": ["#new", "one\ntwo", "", ""]}
    with pytest.raises(UploadRejected, match="cells of its header"):
        space.import_orders(write_orders(tmp_path / "broken.csv", broken))
    assert space.store.state("orders") == (0, {})


def test_refused_uploads_change_nothing(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    twice = {k: [v[0], v[0]] for k, v in SAMPLE.items()}
    with pytest.raises(UploadRejected, match="more than once"):
        space.import_orders(write_orders(tmp_path / "twice.csv", twice))
    assert space.store.state("orders") == (0, {})
    assert space.orders.count() == 0


def test_updates_rewrite_only_the_months_they_touch(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    first = dict(SAMPLE, creation_date=["2023-01-10", "2023-02-11", "2023-03-12", ""])
    assert space.import_orders(write_orders(tmp_path / "a.csv", first)) == ImportResult(4, 0)
    # Order 2 moves from February to April; a stored key twice: the last row wins.
    change = {k: [v[1], v[1]] for k, v in SAMPLE.items()}
    change |= {"creation_date": ["2023-04-01", "2023-04-02"], "income": ["1", ""]}
    assert space.import_orders(write_orders(tmp_path / "b.csv", change)) == ImportResult(0, 2)
    version, slots = space.store.state("orders")
    assert (version, slots) == (2, {"2023-01": 1, "2023-03": 1, "2023-04": 2, "none": 1})
    got = space.orders.filter("id = '2'").first()
    assert (got.creation_date.day, got.income, got.creation_month) == (2, None, "2023-04")
    assert space.orders.count() == 4


def test_catalog_errors(filled):
    with pytest.raises(ValueError, match="exists"):
        filled.create_categories(["Books"])
    with pytest.raises(KeyError, match="unknown category: 99"):
        filled.delete_categories([99])
    with pytest.raises(KeyError, match="unknown product: 99"):
        filled.assign_categories({99: [1]})


def test_delete_category(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    space.import_orders(write_orders(tmp_path / "orders.csv"))
    space.sync_products()
    space.create_categories(["A", "B"])
    ids = {r.name: r.id for r in space.category_options().selectExpr("label AS name", "value AS id").collect()}
    space.assign_categories({1: [ids["A"], ids["B"]], 2: [ids["A"]]})
    space.delete_categories([ids["A"]])
    assert [list(r.categories) for r in space.products_with_categories().orderBy("id").collect()] == [["B"], [], [], []]
    changes = spark.createDataFrame(
        [(1, [ids["B"]], 1), (1, [], 2), (2, [], 1), (2, [ids["B"]], 2)],
        "product_id long, category_ids array<long>, position int")
    with pytest.raises(ValueError, match="without a position"):
        space.assign_categories(changes.drop("position"))
    space.assign_categories(changes)
    assert [r.product_id for r in space.catalog.links.collect()] == [2]


def test_dropped_files(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "tables"))
    drop = tmp_path / "drop"
    drop.mkdir()
    seen = []
    start = lambda: watch_uploads(
        space.store, "orders", str(drop), str(tmp_path / "checkpoint"),
        on_result=lambda path, result: seen.append((os.path.basename(path), result)),
    ).awaitTermination()
    for i, name in enumerate(("a.csv", "b.csv")):
        os.utime(write_orders(drop / name), (1000 + i, 1000 + i))
    (drop / "c.csv").write_text("wrong,headers\n1,2\n")
    start()
    assert seen[:2] == [("a.csv", ImportResult(4, 0)), ("b.csv", ImportResult(0, 4))]
    assert isinstance(seen[2][1], UploadRejected)
    start()
    assert len(seen) == 3
    assert space.orders.count() == 4
