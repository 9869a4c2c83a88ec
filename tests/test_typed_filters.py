"""Filters as they are typed above a table's columns."""

import pytest
from helpers import rows

from tallywright.operators.typed_filters import FilterRefused, filtered


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame([
        (1, "Green Tea", 1.5, "2023-05-31 23:59:59", True), (2, "tea", 100.0, "2023-06-01 00:00:00", False), (3, "eq cup", -3.0, "2024-02-29 10:30:00", True),
        (4, "", None, None, None), (5, None, 1e3, "2023-01-01 00:00:00", True), (6, '> "x"', 0.0, "2023-12-31 00:00:00", False),
    ], "n long, name string, price double, at string, ok boolean")
    return frame.selectExpr("n", "name", "price", "cast(at AS timestamp_ntz) AS at", "cast(at AS date) AS `the.day`", "ok", "cast(price AS decimal(10,2)) AS exact")


@pytest.mark.parametrize("column, text, kept", [
    ("price", "> 100", [5]), ("price", ">= 100", [2, 5]), ("price", "ge 1 000", [5]), ("price", "1.5", [1]), ("price", "=1.5", [1]), ("price", "!= 1.5", [2, 3, 5, 6]),
    ("price", "lt 0", [3]), ("price", "<=-3e0", [3]), ("exact", "1.50", [1]), ("exact", "> 99.99", [2, 5]), ("price", "contains 00", [2, 5]), ("n", "le 2", [1, 2]), ("n", "> 2.5", [3, 4, 5, 6]),
    ("name", "Tea", [1]), ("name", "tea", [2]), ("name", "icontains TEA", [1, 2]), ("name", "contains ea", [1, 2]), ("name", "= tea", [2]), ("name", "i= TEA", [2]), ("name", "ieq 'TEA'", [2]),
    ("name", '= "eq cup"', [3]), ("name", '"eq cup"', [3]), ("name", "eq 'eq cup'", [3]), ("name", "equal", []), ("name", "> f", [2]), ("name", "`> `", [6]), ("name", "''", [1, 2, 3, 4, 6]),
    ("name", "is nil", [5]), ("name", "is blank", [4, 5]), ("price", "is nil", [4]), ("name", "!= tea", [1, 3, 4, 6]), ("name", "eat", []),
    ("at", "2023-05", [1]), ("at", "datestartswith 2023", [1, 2, 5, 6]), ("at", "> 2023-05", [2, 3, 6]), ("at", ">= 2023-05", [1, 2, 3, 6]), ("at", "<= 2023-05-31", [1, 5]), ("at", "< 2023-06-01", [1, 5]),
    ("at", "= 2024-02-29 10:30", [3]), ("at", "= 2024-02-29T10:30:01", []), ("at", "!= 2023", [3]), ("at", "> 2023-12", [3]), ("the.day", "= 2023-12", [6]), ("the.day", "<= 2023-01-01", [5]), ("at", "contains -31", [1, 6]),
    ("ok", "true", [1, 3, 5]), ("ok", "!= True", [2, 6]), ("price", "", [1, 2, 3, 4, 5, 6]), ("price", "   ", [1, 2, 3, 4, 5, 6]),
])
def test_cells(table, column, text, kept):
    assert [r.n for r in filtered(table, {column: text}, ["n"]).collect()] == kept


@pytest.mark.parametrize("column, text", [
    ("price", "> tea"), ("price", ">"), ("price", "1; drop"), ("price", "= 1 or 1"), ("price", "nan"), ("price", "datestartswith 2023"), ("name", "datestartswith 2023"), ("n", "is"),
    ("at", "> 2023-13"), ("at", "2023-02-30"), ("at", "yesterday"), ("at", "9999-12-31"), ("ok", "> true"), ("ok", "maybe"), ("none", "> 1"), ("name", "="), ("price", "is even"), ("name", "contains "),
])
def test_everything_else_is_refused(table, column, text):
    with pytest.raises(FilterRefused):
        filtered(table, {column: text})


def test_several_cells_and_columns_to_sort_by(table):
    both = filtered(table, {"price": ">= 0", "at": "2023", "name": ""}, ["-ok", "-price"])
    assert [r.n for r in both.collect()] == [5, 1, 2, 6]
    assert [r[0] for r in rows(filtered(table, {}, ["price", "n"]).select("n"))] == [3, 6, 1, 2, 5, 4]
    assert [r[0] for r in rows(filtered(table, {}, ["-price"]).select("n"))] == [5, 2, 1, 6, 3, 4]
    with pytest.raises(FilterRefused):
        filtered(table, {}, ["-none"])


def test_bounds_reach_the_files(spark, table, tmp_path):
    from helpers import plan

    table.write.parquet(str(tmp_path / "t"))
    text = plan(filtered(spark.read.parquet(str(tmp_path / "t")), {"at": "> 2023-05", "price": ">= 5"}))
    assert "GreaterThanOrEqual(at,2023-06-01T00:00)" in text and "GreaterThanOrEqual(price,5.0)" in text
