"""Sequential ids for new dimension rows, numbered in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import stored

_BUCKET = "__bucket"


def append_ids(names: DataFrame, after: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Number distinct ``names`` as ``id`` = 1, 2, ... following the ids of ``after``.

    The order is (first two hex digits of the name's MD5, name). A plain
    ``row_number`` over all names would sort them in one task; here each of the
    256 hash buckets is numbered on its own and then shifted by the number of
    names in the buckets before it. Only those 256 counts meet in one place.

    The names are used twice, to count and to number, so they are stored first:
    finding them may take a pass over all orders.
    """
    bucketed = stored(
        names.select(name).withColumn(_BUCKET, F.substring(F.md5(name), 1, 2)), "new-names"
    )
    counts = bucketed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        _BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    rank = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(name))
    start = F.lit(0)
    if after is not None:
        start = after.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return (
        bucketed.withColumn("__rank", rank)
        .join(shifts, _BUCKET)
        .select((start + F.col("__shift") + F.col("__rank")).cast("bigint").alias("id"), name)
    )
