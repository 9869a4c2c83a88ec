import pytest
from helpers import rows

from tallywright.functions import append_ids
from tallywright.operators import catalog as C

DAY = "2023-01-10 12:00:00"


@pytest.fixture
def catalog(make_catalog):
    return make_catalog({"Red Plate": ["B", "A"], "50% off_": ["A"], "bare": []})


def test_names_of_categories_are_sorted_and_never_null(catalog):
    out = {r.name: list(r.categories) for r in C.products_with_categories(catalog).collect()}
    assert out == {"Red Plate": ["A", "B"], "50% off_": ["A"], "bare": []}
    text = {r.name: r.category_text for r in C.category_text(C.products_with_categories(catalog)).collect()}
    assert text == {"Red Plate": "A, B", "50% off_": "A", "bare": "Без категории"}


def test_search_is_literal_and_ignores_case(catalog):
    assert [r.name for r in C.search_products(catalog.products, "PLATE").collect()] == ["Red Plate"]
    assert [r.name for r in C.search_products(catalog.products, "% off_").collect()] == ["50% off_"]
    assert C.search_products(catalog.products, "d%p").count() == 0


def test_uncategorised(catalog):
    assert [r.name for r in C.uncategorised_products(catalog).collect()] == ["bare"]
    assert C.uncategorised_products(catalog, "plate").count() == 0


def test_unknown_product_has_no_row(catalog):
    assert C.product_detail(catalog, 99).count() == 0
    assert C.product_detail(catalog, 3).first().categories == []


def test_ids_are_dense_and_repeatable(spark):
    names = spark.range(5000).selectExpr("concat('n', id) AS name")
    first, again = rows(append_ids(names)), rows(append_ids(names.repartition(3)))
    assert sorted(first) == sorted(again)
    assert sorted(i for i, _ in first) == list(range(1, 5001))
    known = spark.createDataFrame([(41, "x")], "id long, name string")
    assert min(i for i, _ in rows(append_ids(names, known))) == 42


def test_sync_adds_new_names_once(make_orders, catalog):
    orders = make_orders(("bare", 1.0, DAY), ("new", 1.0, DAY), ("new", 2.0, DAY), (None, 1.0, DAY))
    synced = C.sync_products(orders, catalog.products)
    assert sorted(rows(synced))[-1] == (4, "new")
    assert sorted(rows(C.sync_products(orders, synced))) == sorted(rows(synced))


def test_create_categories(spark, catalog):
    asked = spark.createDataFrame([("A",), ("C",), ("D",), ("D",), (None,), ("",)], "name string")
    conflicts = {r.name: (r.reason, r.requests) for r in C.category_conflicts(catalog.categories, asked).collect()}
    assert conflicts == {"A": ("exists", 1), "D": ("repeated", 2), None: ("missing", 1)}
    created = {r.name: r.id for r in C.create_categories(catalog.categories, asked).collect()}
    assert sorted(created) == ["", "A", "B", "C", "D"]
    assert sorted(created.values()) == [1, 2, 3, 4, 5]


def test_delete_is_repeatable(spark, catalog):
    doomed = spark.createDataFrame([(1,), (77,)], "id long")
    after = C.delete_categories(catalog, doomed)
    assert rows(after.categories) == [(2, "B")]
    assert rows(after.links) == [(1, 2)]
    assert rows(C.unknown_ids(catalog.categories, doomed)) == [(77,)]
    assert rows(C.delete_categories(after, doomed).links) == [(1, 2)]


def test_assign_replaces_clears_and_ignores_unknown(spark, catalog):
    changes = spark.createDataFrame(
        [(1, [2, 2, 99]), (2, []), (3, [1]), (88, [1])], "product_id long, category_ids array<long>"
    )
    assert sorted(rows(C.assign_categories(catalog, changes))) == [(1, 2), (3, 1)]


def test_options(make_orders, catalog):
    orders = make_orders(("Red Plate", 1.0, DAY), ("50% off_", 1.0, DAY), ("bare", 1.0, DAY))
    assert [r.label for r in C.product_options(orders, catalog, [2], []).collect()] == ["Red Plate"]
    assert C.product_options(orders, catalog, [2], [1]).count() == 2
    assert C.product_options(orders, catalog).count() == 3
    assert rows(C.category_options(catalog.categories)) == [("A", 1), ("B", 2)]
