"""Orders summed by day: what reports over periods can be put together from.

Sums and counts of disjoint sets of orders add up, the latest time is the larger of two,
and a period is whole days. So a day's sums by product text serve every income report, and
those by source the partner report. Sums are exact, so it makes no difference which way a
report takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import day_of
from tallywright.operators.reports import MEASURES, measured

_DAY = "creation_date"


def product_days(orders: DataFrame) -> DataFrame:
    """All measures of the reports per day and product text; orders without a date or a
    text have a row of their own."""
    return orders.groupBy(day_of(F.col(_DAY)).alias(_DAY), "content").agg(*measured(orders, MEASURES))


def source_days(orders: DataFrame) -> DataFrame:
    """Orders and income per day and UTM source."""
    return orders.groupBy(day_of(F.col(_DAY)).alias(_DAY), "utm_source").agg(*measured(orders, ["total_orders", "income"]))
