"""Joins in which a few keys hold much of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a sketch reports at most, and items it keeps track of.
MOST_KEYS, TRACKED = 64, 4096


def heavy_keys(rows: DataFrame, key: str, share: float = 1 / MOST_KEYS) -> list:
    """The keys with at least this part of the rows, from one pass with a sketch of fixed size.

    Counts are estimates and may be a little too high; no key that has the share is missed
    while ``share`` is well above ``1 / TRACKED``. Nulls are not keys.
    """
    found = rows.select(F.col(key).alias("key")).filter("key IS NOT NULL").agg(
        F.expr(f"approx_top_k(key, {MOST_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] >= share * found["n"]]


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: Sequence, salt: Column, parts: int = 32) -> DataFrame:
    """Inner join by ``key`` with the ``heavy`` keys of ``left`` dealt into ``parts`` by a hash of
    ``salt``, a column of ``left``; rows of ``right`` are repeated for those keys alone.

    The rows are those of the plain join. No task gets all rows of a heavy key, with or
    without adaptive execution.
    """
    if not heavy:
        return left.join(right, key)
    hot = F.col(key).isin(list(heavy))
    dealt = F.when(hot, F.pmod(F.xxhash64(salt), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    joined = left.withColumn("__salt", dealt).join(right.withColumn("__salt", F.explode(every)), [key, "__salt"])
    return joined.drop("__salt")
