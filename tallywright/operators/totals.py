"""Total rows and summary figures under the reports.

A total row comes from grouping sets over the finished report, so the orders
are read once. It is marked by ``is_total``, never found by a null key: a null
product is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import ratio, round_half_even
from tallywright.schemas import TOTAL_LABEL


def with_total(
    report: DataFrame, keys: Sequence[str], sums: Sequence[str], label: str = TOTAL_LABEL
) -> DataFrame:
    """``report`` plus one row that sums its ``sums``; an empty report stays empty.

    The label goes to the first key, later keys are empty text in that row.
    """
    keys = list(keys)
    both = report.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        *[F.sum(s).alias(s) for s in sums], F.grouping_id().alias("__level")
    )
    total = F.col("__level") > 0
    shown = [F.when(total, F.lit(label if i == 0 else "")).otherwise(F.col(k)).alias(k)
             for i, k in enumerate(keys)]
    filled = [F.when(total, F.coalesce(s, F.lit(0))).otherwise(F.col(s)).alias(s) for s in sums]
    return both.select(*shown, *filled, total.alias("is_total")).orderBy("is_total", *keys)


def product_summary_totals(measures: DataFrame, label: str = TOTAL_LABEL) -> DataFrame:
    """Rounded product summary and its total row, from ``product_measures``.

    A product's average check is the mean of its positive incomes, that of the
    total row is the whole income divided by the paid orders.
    """
    sums = ["total_orders", "paid_orders", "income", "paid_income"]
    both = with_total(measures, ["product"], sums, label)
    top = F.when(F.col("is_total"), F.col("income")).otherwise(F.col("paid_income"))
    return both.select(
        "product",
        "total_orders",
        "paid_orders",
        round_half_even(F.col("income")).alias("total_income"),
        ratio(top, F.col("paid_orders"), digits=2).alias("average_check"),
        "is_total",
    ).orderBy("is_total", "product")


def paid_products_totals(report: DataFrame, label: str = TOTAL_LABEL) -> DataFrame:
    """Period report with rounded incomes and the sum of the *rounded* incomes."""
    rounded = report.withColumn("total_income", round_half_even(F.col("total_income")))
    return with_total(rounded, ["product"], ["paid_orders", "total_income"], label)


def category_revenue_totals(report: DataFrame, label: str = TOTAL_LABEL) -> DataFrame:
    """Category revenue and its total, both rounded after summing."""
    both = with_total(report, ["category_name"], ["total_revenue"], label)
    return both.withColumn("total_revenue", round_half_even(F.col("total_revenue"))).orderBy(
        "is_total", F.desc("total_revenue"), "category_name"
    )


def monthly_totals(report: DataFrame, *extra: str, label: str = TOTAL_LABEL) -> DataFrame:
    """A monthly report with its total row; ``extra`` names the second key, if any."""
    return with_total(report, ["month", *extra], ["total_sales", "total_orders", "paid_orders"], label)


def summary_line(report: DataFrame, sales: str = "total_sales", paid: str = "paid_orders",
                 month: str | None = "month") -> DataFrame:
    """Income, paid orders, average check and, for monthly reports, income per month.

    One row, or none for an empty report.
    """
    figures = [
        F.coalesce(F.sum(sales), F.lit(0)).alias("total_sales"),
        F.coalesce(F.sum(paid), F.lit(0)).alias("paid_orders"),
        F.count(F.lit(1)).alias("__rows"),
    ]
    averages = {"average_check": ratio(F.col("total_sales"), F.col("paid_orders"))}
    if month:
        figures.append(F.countDistinct(month).alias("__months"))
        averages["average_monthly_income"] = ratio(F.col("total_sales"), F.col("__months"))
    line = report.agg(*figures).filter(F.col("__rows") > 0)
    return line.withColumns(averages).drop("__rows", "__months")
