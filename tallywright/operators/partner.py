"""Orders by the partner whose contact id is their UTM source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import exact_sum
from tallywright.operators.filters import filter_period, is_summed
from tallywright.schemas import SHARED_SOURCE


def partner_report(
    orders: DataFrame,
    contacts: DataFrame,
    start=None,
    end=None,
    exclude_common: bool = False,
    label: str = SHARED_SOURCE,
) -> DataFrame:
    """Orders and income per partner and UTM source, largest income first.

    Sources without a named contact are labelled as the shared source;
    ``exclude_common`` drops that label, also where a contact bears it as a name.

    Orders are grouped by source before the join. So the source that holds a
    third of all orders (often the empty one) reaches the join as one row, and
    since a contact id is unique the joined rows are already the final groups.
    """
    counted, summed = F.count(F.lit(1)), exact_sum(F.col("income"))
    if is_summed(orders):
        counted, summed = F.sum("total_orders"), F.sum("income")
    by_source = (
        filter_period(orders, start, end)
        .groupBy("utm_source")
        .agg(counted.alias("order_count"), summed.alias("total_income"))
    )
    names = contacts.select(F.col("id").alias("utm_source"), "full_name")
    report = by_source.join(names, "utm_source", "left").select(
        F.coalesce("full_name", F.lit(label)).alias("partner"),
        "utm_source",
        "order_count",
        "total_income",
    )
    if exclude_common:
        report = report.filter(F.col("partner") != label)
    return report.orderBy(F.desc("total_income"), "partner", "utm_source")


def by_registrations(report: DataFrame) -> DataFrame:
    """The partner report by number of orders, largest first."""
    return report.orderBy(F.desc("order_count"), "partner", "utm_source")
