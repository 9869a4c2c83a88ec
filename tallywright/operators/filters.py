"""One description of "which orders" for every report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import is_paid, month_text

# The month column by which stored orders are partitioned, and its value for
# orders without a creation date.
MONTH_SLOT = "creation_month"
NO_MONTH = "none"

Day = dt.date | str | None


def as_day(value: Day) -> dt.date | None:
    """A date, from a date or ISO text; empty values mean "not given"."""
    if not value:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def as_ids(value: int | Sequence[int] | None) -> tuple[int, ...]:
    """One category id or a list of them; none, zero and empty mean "no filter"."""
    if not value:
        return ()
    ids = (value,) if isinstance(value, int) else tuple(value)
    if not all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
        raise TypeError(f"category ids must be integers, got {value!r}")
    return ids


def in_period(
    ts: Column, start: Day, end: Day, *, optional: bool = False
) -> Column | None:
    """Whole days ``start`` to ``end``: midnight after ``end`` is outside.

    Both bounds compare the bare column with literals, so the predicate reaches
    the Parquet reader. A missing bound selects nothing, or everything
    (``None``) where the period is optional.
    """
    first, last = as_day(start), as_day(end)
    if first is None or last is None:
        return None if optional else F.lit(False)
    return (ts >= _moment(first, "00:00:00")) & (ts <= _moment(last, "23:59:59.999999"))


def _moment(day: dt.date, time: str) -> Column:
    return F.lit(f"{day.isoformat()} {time}").cast("timestamp_ntz")


@dataclass(frozen=True)
class SalesFilter:
    """Period, product and category choices of a report.

    Category choices work on product-category links, not on products: an order
    counts once per link that passes, so a product in two chosen categories
    counts twice and a product also in an allowed category survives an
    exclusion. Products without a category are gone as soon as either list is
    given.
    """

    start: Day = None
    end: Day = None
    products: Sequence[str] | DataFrame = ()
    exclude_products: Sequence[str] | DataFrame = ()
    categories: Sequence[int] | int | None = ()
    exclude_categories: Sequence[int] | int | None = ()
    paid_only: bool = False
    optional_period: bool = False

    @property
    def by_category(self) -> bool:
        return bool(as_ids(self.categories) or as_ids(self.exclude_categories))

    def rows(self, orders: DataFrame) -> DataFrame:
        """Orders that pass everything but the category choices."""
        return filter_products(self.in_range(orders), self.products, self.exclude_products)

    def in_range(self, orders: DataFrame) -> DataFrame:
        kept = filter_period(orders, self.start, self.end, optional=self.optional_period)
        return filter_paid(kept) if self.paid_only else kept

    def links(self, links: DataFrame) -> DataFrame:
        """Product-category links that pass the category choices."""
        return filter_links(links, self.categories, self.exclude_categories)


def filter_period(
    orders: DataFrame, start: Day, end: Day, *, optional: bool = False
) -> DataFrame:
    """Keep the orders created on the days ``start`` to ``end`` (or their sums by day)."""
    first, last = as_day(start), as_day(end)
    if dict(orders.dtypes)["creation_date"] == "date" and first and last:
        wanted = F.col("creation_date").between(F.lit(first), F.lit(last))
    else:
        wanted = in_period(F.col("creation_date"), start, end, optional=optional)
    if wanted is None:
        return orders
    if MONTH_SLOT in orders.columns and first and last:
        # Months outside the period are not even listed for reading.
        months = F.col(MONTH_SLOT).between(first.isoformat()[:7], last.isoformat()[:7])
        wanted = months & wanted
    return orders.filter(wanted)


def filter_paid(orders: DataFrame) -> DataFrame:
    """Paid means a positive income, whatever the status says."""
    if is_summed(orders):
        paid = orders.filter(F.col("paid_orders") > 0)
        return paid.withColumns({"income": F.col("paid_income"), "total_orders": F.col("paid_orders")})
    return orders.filter(is_paid(F.col("income")))


def is_summed(orders: DataFrame) -> bool:
    """Whether the rows are sums of orders by day (``operators.days``) and not orders."""
    return "total_orders" in orders.columns


def filter_products(
    orders: DataFrame,
    include: Sequence[str] | DataFrame = (),
    exclude: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """Keep or drop product texts; an exclusion also drops orders without text.

    Short lists become a predicate that the reader gets; long ones can be given as
    frames, whose first column holds the texts, and become semi and anti joins. An
    empty list filters nothing; an empty frame is a choice of nothing.
    """
    if isinstance(include, DataFrame):
        orders = orders.join(_texts(include), F.col("content") == F.col("__text"), "left_semi")
    elif include:
        orders = orders.filter(F.col("content").isin(list(include)))
    if isinstance(exclude, DataFrame):
        orders = orders.filter(F.col("content").isNotNull())
        orders = orders.join(_texts(exclude), F.col("content") == F.col("__text"), "left_anti")
    elif exclude:
        orders = orders.filter(~F.col("content").isin(list(exclude)))
    return orders


def _texts(names: DataFrame) -> DataFrame:
    return names.select(F.col(names.columns[0]).alias("__text"))


def filter_links(
    links: DataFrame,
    include: Sequence[int] | int | None = (),
    exclude: Sequence[int] | int | None = (),
) -> DataFrame:
    """Keep or drop product-category links by category id."""
    if wanted := as_ids(include):
        links = links.filter(F.col("category_id").isin(list(wanted)))
    if unwanted := as_ids(exclude):
        links = links.filter(~F.col("category_id").isin(list(unwanted)))
    return links


def orders_by_source(orders: DataFrame, utm_source: str) -> DataFrame:
    """The orders that came from one UTM source."""
    return orders.filter(F.col("utm_source") == utm_source).select(
        "id", "number", "status", "creation_date", "content", "income", "utm_source"
    )


def month_slot() -> Column:
    """The month an order is stored under."""
    return F.coalesce(month_text(F.to_date("creation_date")), F.lit(NO_MONTH))
