"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.session import stored

#: A word of the documents: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "by_size", "let", "pieces", "small_side", "stored", "table", "words_in"]


def small_side(frame: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most so many.

    Its rows are counted first (from the files' footers). Beyond that the join shuffles,
    with the same result.
    """
    return F.broadcast(frame) if frame.count() <= rows else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, then) -> F.Column:
    """``then(value)`` with the value computed once.

    Neighbouring projections are merged by the optimizer, which repeats a column's
    expression wherever it is used, within a lambda for every element. A lambda's
    argument is not repeated.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def words_in(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, without copying.

    A worker then holds the Python objects of a few hundred texts at a time,
    however many rows Spark sends at once.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_size(
    batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, rows: int = 512,
) -> Iterator[pa.RecordBatch]:
    """Arrow batches whose texts have at most so many bytes together, without copying.

    A longer text is a batch of its own, so what a worker holds of Python objects depends
    on its longest text and not on how many rows Spark sends at once.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + most, side="right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to
