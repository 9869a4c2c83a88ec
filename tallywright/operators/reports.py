"""The sales reports.

Sums and counts can be taken in two steps, so every report that needs
categories first groups the orders by its own keys and the product text, and
joins the (much smaller) groups with the catalog. The order table is shuffled
once, after map-side aggregation, whatever share of it one product holds; the
one-to-many step to categories multiplies groups instead of orders.

Amounts come out as decimals, see ``tallywright.functions.exact_sum``.

All reports take orders, or their sums by day and product (``operators.days``), with the
same result: sums and counts are exact, and a period is whole days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import day_of, exact_sum, is_paid, month_start, month_text, spread_join
from tallywright.operators.catalog import Catalog
from tallywright.operators.filters import MONTH_SLOT, NO_MONTH, SalesFilter, is_summed


MEASURES = ("total_orders", "paid_orders", "income", "paid_income", "latest")


def _measure(name: str) -> Column:
    income = F.col("income")
    paid = is_paid(income)
    if name == "total_orders":
        # An order id is never null, so rows are counted and ids are not read.
        measure = F.count(F.lit(1))
    elif name == "paid_orders":
        measure = F.count(F.when(paid, 1))
    elif name == "income":
        measure = exact_sum(income)
    elif name == "paid_income":
        measure = exact_sum(F.when(paid, income))
    else:
        measure = F.max("creation_date")
    return measure.alias(name)


def measured(rows: DataFrame, wanted: Sequence[str]) -> list[Column]:
    """The measures over orders, or over sums of them."""
    return [_again(m) for m in wanted] if is_summed(rows) else [_measure(m) for m in wanted]


def _again(name: str) -> Column:
    return (F.max(name) if name == "latest" else F.sum(name)).alias(name)


def totals(
    orders: DataFrame,
    flt: SalesFilter,
    catalog: Catalog | None,
    keys: Mapping[str, Column],
    wanted: Sequence[str],
    *,
    category_name: bool = False,
) -> DataFrame:
    """The ``wanted`` measures of the filtered orders for each key.

    With ``category_name`` the name of each linked category is one more key.
    """
    columns = [expr.alias(name) for name, expr in keys.items()]
    rows = flt.rows(orders)
    if not (flt.by_category or category_name):
        return rows.groupBy(*columns).agg(*measured(rows, wanted))
    if catalog is None:
        raise ValueError("a category choice needs the catalog")
    pieces = rows.groupBy(*columns, F.col("content").alias("__content")).agg(*measured(rows, wanted))
    return link(pieces, flt, catalog, list(keys), wanted, category_name=category_name)


def link(
    pieces: DataFrame,
    flt: SalesFilter,
    catalog: Catalog,
    keys: Sequence[str],
    wanted: Sequence[str],
    *,
    category_name: bool = False,
) -> DataFrame:
    """Spread measures grouped by keys and product text over category links."""
    # Each dimension is joined by itself, so Spark knows its size from its
    # files and broadcasts it only if that is below the session's threshold.
    spread = pieces.join(
        catalog.products.select(F.col("name").alias("__content"), F.col("id").alias("product_id")),
        "__content",
    ).join(flt.links(catalog.links).select("product_id", "category_id"), "product_id")
    keys = list(keys)
    if category_name:
        spread = spread.join(
            catalog.categories.select(
                F.col("id").alias("category_id"), F.col("name").alias("category")
            ),
            "category_id",
        )
        keys.append("category")
    return spread.groupBy(*keys).agg(*[_again(m) for m in wanted])


def linked_orders(orders: DataFrame, flt: SalesFilter, catalog: Catalog, heavy: Sequence[str] = ()) -> DataFrame:
    """Single orders with the category links that pass: one row per order and link.

    Reports do not need this (see above); it lists the orders behind a figure. Products and
    links meet first, so the orders are joined once. ``heavy`` names product texts with
    many orders (``functions.heavy_keys`` finds them), which are then dealt over many tasks.
    """
    linked = catalog.products.select(F.col("name").alias("content"), F.col("id").alias("product_id")) \
        .join(flt.links(catalog.links).select("product_id", "category_id"), "product_id")
    return spread_join(flt.rows(orders), linked, "content", heavy, F.col("id"))


def _sorted(report: DataFrame, ordered: bool, *by) -> DataFrame:
    """Reports that only feed another step are not sorted: a sort is a shuffle."""
    return report.orderBy(*by) if ordered else report


# --- daily ----------------------------------------------------------------


def sales_by_day(orders, catalog=None, start=None, end=None, category=None) -> DataFrame:
    """Income per day, refunds and unpaid orders included."""
    flt = SalesFilter(start, end, categories=category)
    daily = totals(orders, flt, catalog, {"date": day_of(F.col("creation_date"))}, ["income"])
    return daily.select("date", F.col("income").alias("total_sales")).orderBy("date")


def product_daily(
    orders, catalog=None, products=(), start=None, end=None, category=None, *, ordered=True
) -> DataFrame:
    """Income, orders and paid orders per day for chosen products or a category."""
    flt = SalesFilter(start, end, products=products or (), categories=category)
    daily = totals(
        orders, flt, catalog, {"date": day_of(F.col("creation_date"))},
        ["income", "total_orders", "paid_orders"],
    )
    report = daily.select(
        "date", F.col("income").alias("daily_sales"), "total_orders", "paid_orders"
    )
    return _sorted(report, ordered, "date")


def product_cumulative(orders, catalog=None, products=(), start=None, end=None, category=None) -> DataFrame:
    """``product_daily`` with the running income.

    The window is not partitioned, but it sees one row per calendar day, a
    number that does not grow with the orders.
    """
    daily = product_daily(orders, catalog, products, start, end, category, ordered=False)
    running = F.sum("daily_sales").over(Window.orderBy("date"))
    return daily.withColumn("cumulative_sales", running).orderBy("date")


def max_creation_date(orders, catalog=None, products=(), start=None, end=None, category=None) -> DataFrame:
    """Time of the latest order among those of ``product_daily``; always one row."""
    flt = SalesFilter(start, end, products=products or (), categories=category)
    latest = totals(orders, flt, catalog, {}, ["latest"])
    return latest.select(F.col("latest").alias("max_creation_date"))


# --- products -------------------------------------------------------------


def product_summary(orders, catalog=None, products=(), start=None, end=None, category=None) -> DataFrame:
    """Orders, paid orders, income and mean paid income per product text."""
    summary = product_measures(orders, catalog, products, start, end, category)
    check = F.col("paid_income").cast("double") / F.col("paid_orders")
    return summary.select(
        "product",
        "total_orders",
        "paid_orders",
        F.col("income").alias("total_income"),
        F.when(F.col("paid_orders") > 0, check).alias("average_check"),
    ).orderBy("product")


def product_measures(orders, catalog=None, products=(), start=None, end=None, category=None) -> DataFrame:
    """What ``product_summary`` and its total row are computed from."""
    flt = SalesFilter(start, end, products=products or (), categories=category)
    return totals(
        orders, flt, catalog, {"product": F.col("content")},
        ["total_orders", "paid_orders", "income", "paid_income"],
    )


def product_pieces(orders: DataFrame, flt: SalesFilter, catalog: Catalog | None = None) -> DataFrame:
    """Measures per day and product text: all tables of the product tab follow from it."""
    keys = {"date": day_of(F.col("creation_date")), "product": F.col("content")}
    return totals(orders, flt, catalog, keys, MEASURES)


def paid_products(
    orders, catalog=None, start=None, end=None, category=None, *, ordered=True
) -> DataFrame:
    """Products with at least one paid order."""
    flt = SalesFilter(start, end, categories=category)
    summary = totals(
        orders, flt, catalog, {"product": F.col("content")},
        ["total_orders", "paid_orders", "income"],
    ).filter(F.col("paid_orders") > 0)
    report = summary.select(
        "product", "total_orders", "paid_orders", F.col("income").alias("total_income")
    )
    return _sorted(report, ordered, "product")


# --- categories and months ------------------------------------------------


def category_revenue(
    orders, catalog, start=None, end=None, exclude=None, include=None, *, ordered=True
) -> DataFrame:
    """Paid income per category, largest first; without dates over all time."""
    flt = SalesFilter(
        start, end, categories=include, exclude_categories=exclude,
        paid_only=True, optional_period=True,
    )
    revenue = totals(orders, flt, catalog, {}, ["income"], category_name=True)
    report = revenue.select(
        F.col("category").alias("category_name"), F.col("income").alias("total_revenue")
    )
    return _sorted(report, ordered, F.desc("total_revenue"), "category_name")


def category_share(revenue: DataFrame) -> DataFrame:
    """Category revenue with its part of the whole (one row per category)."""
    whole = F.sum("total_revenue").over(Window.partitionBy())
    part = F.col("total_revenue").cast("double") / whole.cast("double")
    return revenue.withColumn("share", part)


_MONTHLY = ["income", "total_orders", "paid_orders"]


def monthly_filter(
    start=None, end=None, categories=None, products=None,
    exclude_categories=None, exclude_products=None,
) -> SalesFilter:
    """The filter all three monthly reports share: paid orders, optional period."""
    return SalesFilter(
        start, end, products=products or (), exclude_products=exclude_products or (),
        categories=categories, exclude_categories=exclude_categories,
        paid_only=True, optional_period=True,
    )


def monthly_pieces(orders: DataFrame, flt: SalesFilter) -> DataFrame:
    """Measures per month and product text: all three monthly reports follow from it.

    A caller who wants all three can checkpoint this one small frame and read
    the orders once.
    """
    rows = flt.rows(orders)
    return rows.groupBy(
        month_start(F.col("creation_date")).alias("month"), F.col("content").alias("__content")
    ).agg(*measured(rows, _MONTHLY))


def monthly_sales(orders, catalog=None, start=None, end=None, *, ordered=True, **choices) -> DataFrame:
    """Paid income and orders per month."""
    flt = monthly_filter(start, end, **choices)
    rows = totals(orders, flt, catalog, {"month": month_start(F.col("creation_date"))}, _MONTHLY)
    return _monthly(rows, ordered=ordered)


def monthly_by_product(orders, catalog=None, start=None, end=None, *, ordered=True, **choices) -> DataFrame:
    """Paid income and orders per month and product text."""
    flt = monthly_filter(start, end, **choices)
    keys = {"month": month_start(F.col("creation_date")), "product": F.col("content")}
    return _monthly(totals(orders, flt, catalog, keys, _MONTHLY), "product", ordered=ordered)


def monthly_by_category(orders, catalog, start=None, end=None, *, ordered=True, **choices) -> DataFrame:
    """Paid income and orders per month and category."""
    flt = monthly_filter(start, end, **choices)
    keys = {"month": month_start(F.col("creation_date"))}
    rows = totals(orders, flt, catalog, keys, _MONTHLY, category_name=True)
    return _monthly(rows, "category", ordered=ordered)


def monthly_from_pieces(
    pieces: DataFrame, flt: SalesFilter, catalog: Catalog, *, ordered=True
) -> dict[str, DataFrame]:
    """The three monthly reports from one ``monthly_pieces`` frame."""
    if flt.by_category:
        by_product = link(
            pieces.withColumn("product", F.col("__content")), flt, catalog,
            ["month", "product"], _MONTHLY,
        )
    else:
        by_product = pieces.withColumnRenamed("__content", "product")
    by_month = by_product.groupBy("month").agg(*[F.sum(m).alias(m) for m in _MONTHLY])
    by_category = link(pieces, flt, catalog, ["month"], _MONTHLY, category_name=True)
    return {
        "monthly": _monthly(by_month, ordered=ordered),
        "by_product": _monthly(by_product, "product", ordered=ordered),
        "by_category": _monthly(by_category, "category", ordered=ordered),
    }


def _monthly(rows: DataFrame, *extra: str, ordered: bool) -> DataFrame:
    report = rows.select(
        month_text(F.col("month")).alias("month"),
        *extra,
        F.col("income").alias("total_sales"),
        "total_orders",
        "paid_orders",
    )
    return _sorted(report, ordered, "month", *extra)


# --- single figures -------------------------------------------------------


def order_count(orders: DataFrame) -> DataFrame:
    if is_summed(orders):
        return orders.agg(F.coalesce(F.sum("total_orders"), F.lit(0)).alias("order_count"))
    return orders.agg(F.count(F.lit(1)).alias("order_count"))


def freshness(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Latest creation time of orders and of contacts, in one row.

    Of stored orders only the newest month is read.
    """
    nothing = F.lit(None).cast("timestamp_ntz")
    time = "latest" if is_summed(orders) else "creation_date"
    both = newest_month(orders).agg(F.max(time).alias("latest_order")).select(
        "latest_order", nothing.alias("latest_contact")
    ).unionByName(
        contacts.agg(F.max("creation_date").alias("latest_contact")).select(
            nothing.alias("latest_order"), "latest_contact"
        )
    )
    return both.agg(
        F.max("latest_order").alias("latest_order"), F.max("latest_contact").alias("latest_contact")
    )


def newest_month(orders: DataFrame) -> DataFrame:
    """Stored orders of the newest month; other frames as they are."""
    if MONTH_SLOT not in orders.columns:
        return orders
    months = orders.filter(F.col(MONTH_SLOT) != NO_MONTH).select(MONTH_SLOT)
    return orders.filter(F.col(MONTH_SLOT) == months.agg(F.max(MONTH_SLOT)).scalar())
