"""What the two searches over vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one task compares at a time, about.
ROW_BLOCK, QUERY_BLOCK = 8192, 16384


def sound(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, vector`` (doubles) of the rows without null or non-finite components."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("key").isNotNull() & F.col("vector").isNotNull()).where(finite)


def block_of(key, blocks: int, salt: int):
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(blocks)).cast("int")


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the place at which each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    first, last = (offsets[0], offsets[-1]) if len(column) else (0, 0)
    values = column.values.slice(first, last - first).to_numpy(zero_copy_only=False)
    return values, offsets - first


def found_batch(queries: list, ids: list[np.ndarray], scores: list[np.ndarray], score: pa.DataType) -> pa.Table:
    """One row for each query with the arrays of what it found."""
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = lambda parts, kind: pa.array(
        np.concatenate(parts) if parts else np.zeros(0, np.int64), kind)
    return pa.table({
        "query_id": pa.array(queries, pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array(offsets), flat(ids, pa.int64())),
        "scores": pa.ListArray.from_arrays(pa.array(offsets), flat(scores, score)),
    })


def best(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest of each query over all its
    partial lists, ties to the smaller id. Spark cuts each task's rows to k for a
    query before it shuffles them."""
    rows = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")) \
        .select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
