"""A bounded set of bits that tells which rows cannot meet another frame's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import stored

#: 8 MB of bits in bitmaps of 4 KB, so that Spark broadcasts them by itself.
BITS = 1 << 26


def may_match(rows: DataFrame, asked: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``asked``: a join that follows
    shuffles the others only. None that has a key of ``asked`` is lost."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = asked.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(position).alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__at div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, int(__at % 8))").bitwiseAND(byte) > 0
    joined = rows.withColumns({"__bucket": bucket, "__at": position}).join(stored(maps, "bits"), "__bucket")
    return joined.filter(hit).select(*rows.columns)
