"""Insert or overwrite rows by key, as set operations.

Rules for keys that occur more than once in a batch: of a stored key the last
row wins and every row counts as an update; a new key must be unique, else the
whole batch is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.uploads import ROW_ORDER

COPIES = "__copies"
FOUND = "__found"


def last_rows(batch: DataFrame, key: str = "id", order: str = ROW_ORDER) -> DataFrame:
    """The last row of each key, and in ``__copies`` how many there were.

    An aggregate and not a window: copies are reduced before the shuffle, so a
    key with very many copies does not end up in one task.
    """
    fields = [c for c in batch.columns if c not in (key, order)]
    last = F.max_by(F.struct(*fields), F.col(order)).alias("__last")
    return (
        batch.groupBy(key).agg(last, F.count(F.lit(1)).alias(COPIES))
        .select(key, "__last.*", COPIES)
    )


def stored_keys(current: DataFrame, batch: DataFrame, key: str = "id", *keep: str) -> DataFrame:
    """Keys (and ``keep`` columns) of stored rows that the batch touches.

    Reads only those columns of the table, and where the batch is below the
    broadcast threshold the table is not shuffled.
    """
    return current.select(key, *keep).join(batch.select(key), key, "left_semi")


def mark_stored(last: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The reduced batch with ``__found``: is the key stored already?

    Other columns of ``stored`` come along, null for new keys.
    """
    flags = stored.withColumn(FOUND, F.lit(True))
    return last.join(flags, key, "left").withColumn(FOUND, F.coalesce(FOUND, F.lit(False)))


def marked_keys(batch: DataFrame, stored: DataFrame | None, key: str, at: str, now: str, place: Sequence[Column] = ()) -> DataFrame:
    """Each key of the batch with its ``__copies``, the largest ``at`` of them, the place ``now``
    where it is stored (null for new keys) and ``__found``.

    One aggregate over the keys of both sides. ``place``: expressions of the key by which
    rows are shuffled for it, so that what follows finds them there.
    """
    rows = batch.select(key, at, F.lit(None).cast("string").alias(now))
    if stored is not None:
        known = stored.filter(F.col(key).isNotNull()).select(key, F.lit(None).cast("string").alias(at), now)
        rows = rows.unionByName(known)
    extra = {f"__place{i}": p for i, p in enumerate(place)}
    if extra:
        rows = rows.withColumns(extra).repartition(*extra)
    told = [F.count(at).alias(COPIES), F.max(at).alias(at), F.max(now).alias(now)]
    return rows.groupBy(*extra, key).agg(*told).filter(F.col(COPIES) > 0).withColumn(FOUND, F.col(now).isNotNull()).drop(*extra)


def without(rows: DataFrame, gone: DataFrame, key: str, slot: str, piece: Column) -> DataFrame:
    """``rows`` whose keys are not ``gone`` from their slot, with one shuffle, by slot and
    ``piece`` (an expression of slot and key): they lie where their slots are written."""
    both = rows.withColumn("__gone", F.lit(False)).unionByName(gone.select(key, slot, F.lit(True).alias("__gone")), allowMissingColumns=True)
    both = both.withColumn("__piece", piece).repartition(slot, "__piece")
    named = F.max("__gone").over(Window.partitionBy(slot, "__piece", key))
    return both.withColumn("__gone", named).filter(~F.col("__gone")).drop("__gone", "__piece")


def _rows_where(wanted) -> Column:
    return F.coalesce(F.sum(F.when(wanted, F.col(COPIES))), F.lit(0))


def _refused() -> Column:
    return ~F.col(FOUND) & (F.col(COPIES) > 1)


def upsert_counts(marked: DataFrame) -> DataFrame:
    """Rows created and updated, in one row."""
    return marked.agg(*tally()[:2])


def tally() -> list[Column]:
    """Aggregates over a marked batch: rows created and updated, new keys that it has more
    than once, and the rows of those."""
    return [
        _rows_where(~F.col(FOUND)).alias("created"), _rows_where(F.col(FOUND)).alias("updated"),
        F.count(F.when(_refused(), 1)).alias("conflicts"), _rows_where(_refused()).alias("refused"),
    ]


def upsert_conflicts(marked: DataFrame, key: str = "id") -> DataFrame:
    """New keys that the batch has more than once."""
    return marked.filter(_refused()).select(key, F.col(COPIES).alias("copies"))


def merged(current: DataFrame, marked: DataFrame, key: str = "id") -> DataFrame:
    """The table after the batch.

    Fields the batch carries overwrite what is stored, nulls included; fields
    it does not carry keep what is stored and are null in new rows. Updates are
    a left join that streams the table past the batch (no shuffle of the table
    where the batch is small); new rows are appended to it.
    """
    types = {f.name: f.dataType for f in current.schema.fields}
    fields, given = list(types), set(marked.columns)
    carried = [f for f in fields if f in given and f != key]
    updates = marked.filter(FOUND).select(
        key, F.struct(*carried).alias("__new"), F.lit(True).alias("__hit")
    )
    taken = [
        F.when(F.col("__hit"), F.col(f"__new.{f}")).otherwise(F.col(f)).alias(f)
        if f in carried else F.col(f)
        for f in fields
    ]
    kept = current.join(updates, key, "left").select(*taken)
    created = marked.filter(~F.col(FOUND)).select(
        *[F.col(f) if f in carried or f == key else F.lit(None).cast(types[f]).alias(f)
          for f in fields]
    )
    return kept.unionByName(created)
