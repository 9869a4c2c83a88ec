"""Report frames as they are shown: rounding, percentages, texts, titles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import (
    local_text,
    money_text,
    percent_of,
    percent_text,
    ratio,
    round_half_even,
)
from tallywright.schemas import (
    DEFAULT_AFTER_TAX_RATE,
    DEFAULT_BASE_INCOME,
    DEFAULT_FUND_RATE,
    DEFAULT_HEADCOUNT,
    DISPLAY_ZONE,
    NO_DATA,
)


def plain(report: DataFrame) -> DataFrame:
    """Amounts as doubles and days as ISO text, for readers without such types."""
    plain_types = {T.DecimalType: "double", T.DateType: "string"}
    return report.select(
        *[
            F.col(f.name).cast(plain_types[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in plain_types else F.col(f.name)
            for f in report.schema.fields
        ]
    )


def round_columns(report: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Round decimal or double columns half to even."""
    exact = {
        c: round_half_even(F.col(c).cast("decimal(30,10)"), digits)
        if isinstance(report.schema[c].dataType, T.DoubleType)
        else round_half_even(F.col(c), digits)
        for c in columns
    }
    return report.withColumns(exact)


def rounded_product_summary(summary: DataFrame) -> DataFrame:
    """Product summary to two digits; a product without payments has a check of 0."""
    filled = summary.withColumn("average_check", F.coalesce("average_check", F.lit(0.0)))
    return round_columns(filled, ["total_income", "average_check"])


def percent_of_base(daily: DataFrame, base: float | None = DEFAULT_BASE_INCOME) -> DataFrame:
    """Daily and running income, rounded, each with its percentage of ``base``.

    Percentages are numbers (null without a positive base) and texts.
    """
    rounded = round_columns(daily, ["daily_sales", "cumulative_sales"])
    numbers = rounded.withColumns({
        "cumulative_percent": percent_of(F.col("cumulative_sales"), base),
        "daily_percent": percent_of(F.col("daily_sales"), base),
    })
    return numbers.withColumns({
        "cumulative_percentage": percent_text(F.col("cumulative_percent")),
        "daily_percentage": percent_text(F.col("daily_percent")),
    })


def money_columns(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Amounts as text with spaced thousands."""
    return report.withColumns({c: money_text(F.col(c)) for c in columns})


def titled(report: DataFrame, titles: Mapping[str, str], hide: Sequence[str] = ()) -> DataFrame:
    """Only the columns that have a title and are not hidden, under their titles."""
    return report.select(
        *[F.col(c).alias(title) for c, title in titles.items()
          if c in report.columns and c not in hide]
    )


def freshness_text(latest: DataFrame, zone: str = DISPLAY_ZONE, no_data: str = NO_DATA) -> DataFrame:
    """The one row of ``freshness`` as local wall-clock texts."""
    def shown(column: str) -> Column:
        text = local_text(F.col(column), zone, "-")
        return F.coalesce(text, F.lit(no_data)).alias(f"{column}_text")

    return latest.select("*", shown("latest_order"), shown("latest_contact"))


def summary_texts(line: DataFrame) -> DataFrame:
    """A summary line as it is read: amounts with spaced thousands, counts as they are."""
    amounts = ("total_sales", "average_check", "average_monthly_income")
    return money_columns(line, [c for c in amounts if c in line.columns])


def fund_texts(fund: DataFrame) -> DataFrame:
    """Fund figures as texts; those that are not shown stay null."""
    return money_columns(fund, ["total_income", "fund_income", "fund_after_tax", "employee_income"])


def fund_allocation(
    summary_with_total: DataFrame,
    latest: DataFrame,
    category_name: str | None,
    marker: str,
    title: str,
    headcount: int | None = DEFAULT_HEADCOUNT,
    fund_rate: str = DEFAULT_FUND_RATE,
    after_tax_rate: str = DEFAULT_AFTER_TAX_RATE,
    zone: str = DISPLAY_ZONE,
) -> DataFrame:
    """Share of the total row's income set aside, after tax and per employee.

    ``summary_with_total`` comes from ``product_summary_totals``, ``latest`` from
    ``max_creation_date``. The figures are null, and ``visible`` false, unless
    the chosen category's name contains ``marker``. The title gets the local
    time of the latest order, if there is one. An empty report has income 0.
    """
    one = summary_with_total.filter("is_total").agg(F.max("total_income").alias("total_income"))
    one = one.withColumn("latest", latest.select("max_creation_date").scalar())
    return _fund_figures(one, category_name, marker, title, headcount, fund_rate, after_tax_rate, zone)


def fund_of_pieces(
    pieces: DataFrame,
    category_name: str | None,
    marker: str,
    title: str,
    headcount: int | None = DEFAULT_HEADCOUNT,
    fund_rate: str = DEFAULT_FUND_RATE,
    after_tax_rate: str = DEFAULT_AFTER_TAX_RATE,
    zone: str = DISPLAY_ZONE,
) -> DataFrame:
    """``fund_allocation`` where only it is wanted: one pass over ``product_pieces``."""
    one = pieces.agg(round_half_even(F.sum("income")).alias("total_income"), F.max("latest").alias("latest"))
    return _fund_figures(one, category_name, marker, title, headcount, fund_rate, after_tax_rate, zone)


def _fund_figures(one, category_name, marker, title, headcount, fund_rate, after_tax_rate, zone) -> DataFrame:
    visible = F.lit(marker in (category_name or ""))
    income = F.coalesce("total_income", F.lit(0).cast("decimal(30,2)"))
    fund = income * F.lit(fund_rate).cast("decimal(6,4)")
    after_tax = fund * F.lit(after_tax_rate).cast("decimal(6,4)")
    people = F.lit(headcount if headcount and headcount > 0 else 0)
    when = local_text(F.col("latest"), zone, ".")
    stamped = F.concat(F.lit(title), F.coalesce(F.concat(F.lit(" на "), when), F.lit("")))
    return one.select(
        income.alias("total_income"),
        visible.alias("visible"),
        F.when(visible, stamped).otherwise(F.lit(title)).alias("title"),
        F.when(visible, fund).alias("fund_income"),
        F.when(visible, after_tax).alias("fund_after_tax"),
        F.when(visible, ratio(after_tax, people)).alias("employee_income"),
    )


def refine(report: DataFrame, where: str | Column | None = None, order_by: Sequence = ()) -> DataFrame:
    """Filter and sort a finished report by its own columns."""
    if where is not None:
        report = report.filter(where)
    return report.orderBy(*order_by) if order_by else report
