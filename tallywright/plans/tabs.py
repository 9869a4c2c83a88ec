"""The tables of the six report tabs, each tab from one pass over the orders.

A tab shows several reports over the same orders. The orders are grouped once
to the finest level the tab needs; that small frame is stored and all tables of
the tab follow from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators import partner as P
from tallywright.operators import present as V
from tallywright.operators import reports as R
from tallywright.operators import totals as X
from tallywright.operators.catalog import Catalog
from tallywright.operators.filters import SalesFilter
from tallywright.schemas import (
    CATEGORY_TITLES,
    DEFAULT_BASE_INCOME,
    MONTHLY_TITLES,
    PERIOD_TITLES,
    PRODUCT_DAILY_TITLES,
    PRODUCT_SUMMARY_TITLES,
)
from tallywright.session import stored
from tallywright.sources.exports import partner_export


def general_tab(orders, catalog, start, end, category=None) -> dict[str, DataFrame]:
    """Income per day."""
    return {"daily": R.sales_by_day(orders, catalog, start, end, category)}


def product_tab(
    orders, catalog, start, end, products=(), category=None, base=DEFAULT_BASE_INCOME
) -> dict[str, DataFrame]:
    """Daily, running and summed income of the chosen products.

    Without a choice of products or a category all tables are empty. ``totals``
    and ``latest`` are what ``fund_allocation`` takes.
    """
    flt = SalesFilter(start, end, products=products or (), categories=category)
    pieces = R.product_pieces(orders, flt, catalog)
    if not (products or flt.by_category):
        pieces = pieces.limit(0)
    pieces = stored(pieces, "product-tab")
    sums = ["income", "total_orders", "paid_orders"]
    daily = pieces.groupBy("date").agg(*[F.sum(m).alias(m) for m in sums]).select(
        "date", F.col("income").alias("daily_sales"), "total_orders", "paid_orders"
    )
    running = F.sum("daily_sales").over(Window.orderBy("date"))
    percent = V.percent_of_base(daily.withColumn("cumulative_sales", running), base)
    measures = pieces.groupBy("product").agg(
        *[F.sum(m).alias(m) for m in (*sums, "paid_income")]
    )
    totals = X.product_summary_totals(measures)
    return {
        "daily": V.titled(percent.orderBy("date"), PRODUCT_DAILY_TITLES),
        "summary": V.titled(totals, PRODUCT_SUMMARY_TITLES),
        "totals": totals,
        "latest": pieces.agg(F.max("latest").alias("max_creation_date")),
    }


def period_tab(orders, catalog, start, end, category=None) -> dict[str, DataFrame]:
    """Paid products of a period with their total."""
    totals = X.paid_products_totals(
        R.paid_products(orders, catalog, start, end, category, ordered=False)
    )
    return {"table": V.titled(totals, PERIOD_TITLES)}


def category_tab(orders, catalog, start=None, end=None, exclude=None, include=None) -> dict[str, DataFrame]:
    """Revenue of each category, its share and the total; without dates over all time."""
    report = R.category_revenue(orders, catalog, start, end, exclude, include, ordered=False)
    revenue = stored(report, "category-tab")
    shares = R.category_share(revenue).orderBy(F.desc("total_revenue"), "category_name")
    return {
        "shares": shares,
        "table": V.titled(X.category_revenue_totals(revenue), CATEGORY_TITLES),
    }


def partner_tab(orders, contacts, start, end, exclude_common=True, show_income=False) -> dict[str, DataFrame]:
    """Partners by registrations (for the chart) and by income (the table)."""
    report = stored(P.partner_report(orders, contacts, start, end, exclude_common), "partner-tab")
    by_income = report.orderBy(F.desc("total_income"), "partner", "utm_source")
    return {
        "by_registrations": P.by_registrations(report),
        "table": partner_export(by_income, show_income),
    }


def monthly_tab(orders, catalog: Catalog, start, end, **choices) -> dict[str, DataFrame]:
    """The three monthly tables with totals and their summary lines."""
    flt = R.monthly_filter(start, end, **choices)
    pieces = stored(R.monthly_pieces(orders, flt), "monthly-tab")
    reports = R.monthly_from_pieces(pieces, flt, catalog, ordered=False)
    second = {"monthly": (), "by_product": ("product",), "by_category": ("category",)}
    tab = {}
    for name, report in reports.items():
        totals = X.monthly_totals(report, *second[name])
        tab[name] = V.titled(V.money_columns(totals, ["total_sales"]), MONTHLY_TITLES)
        tab[f"{name}_summary"] = X.summary_line(report)
    return tab
