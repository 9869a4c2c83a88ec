"""Tables that follow from the stored orders and are kept up to date with them.

Each covers a version of the orders, which its log tells. What a job of an import did not
get to do is made up for by the next one that needs the table: it reads the months that were
written since, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators import days
from tallywright.operators.filters import MONTH_SLOT
from tallywright.session import stored
from tallywright.sources.tables import KEY_SLOTS, PIECE, TableStore

KEYS, MONTH = "order_keys", "stored_month"
#: The slot of staged keys that are to stay out of the index: their month has not changed.
SAME = "same"
#: A bucket of the index with more parts than this is written as one again.
MOST_PARTS = 16


class OrderKeys:
    """The month under which each order is stored, found by the bucket of its id.

    Rows are only ever added: an id has one for each month it was stored under, the one
    of the latest version counts. So an import writes what its batch adds, and a bucket
    is written anew only when it has gathered too many parts.
    """

    def __init__(self, store: TableStore, most_parts: int = MOST_PARTS):
        self.store, self.most_parts = store, most_parts

    def catch_up(self) -> int:
        """Take in the months written since the index was; returns the orders' version."""
        version, _ = self.store.state("orders")
        covers = self.store.covers(KEYS)
        if version and covers != version:
            months = self.store.changed("orders", covers)
            rows = self.store.read("orders", months).select("id", F.col(MONTH_SLOT).alias(MONTH), F.lit(version).cast("long").alias("at"))
            if covers is not None:
                rows = rows.join(_newest(self.store.read(KEYS)), ["id", MONTH], "left_anti")
            self.store.append(KEYS, rows, version)
        return version

    def entries(self, batch: DataFrame) -> DataFrame:
        """The index rows of the buckets that hold the batch's ids; no other file is read."""
        slot = self.store.tables[KEYS].slot
        buckets = self.store.with_slot(KEYS, batch.select("id")).select(slot).distinct()
        return self.store.read(KEYS, {r[0] for r in buckets.collect()})

    def find(self, batch: DataFrame) -> DataFrame:
        """``id, stored_month`` of those ids of the batch that are stored."""
        self.catch_up()
        return _newest(self.entries(batch).join(batch.select("id"), "id", "left_semi"))

    def months(self, batch: DataFrame) -> set[str]:
        """The months that hold the batch's ids. A few buckets are searched first, then more of
        them, until all are or all months of the orders are found, to which others add nothing."""
        self.catch_up()
        slot, every = self.store.tables[KEYS].slot, self.store.state("orders")[1].keys()
        ids = self.store.with_slot(KEYS, batch.select("id"))
        buckets, found, some = sorted(r[0] for r in ids.select(slot).distinct().collect()), set(), 1
        while buckets and found != every:
            now, buckets, some = buckets[:some], buckets[some:], 4 * some
            entries = self.store.read(KEYS, set(now)).join(ids.filter(F.col(slot).isin(now)).select("id"), "id", "left_semi")
            found |= {r[0] for r in _newest(entries).select(MONTH).distinct().collect()}
        return found

    def near(self, batch: DataFrame) -> DataFrame | None:
        """``id, stored_month`` of the buckets that hold the batch's ids; none if no order is stored yet."""
        if not self.catch_up():
            return None
        entries = self.entries(batch)
        # In buckets of one part, an import's, an id has one row.
        return entries.select("id", MONTH) if max(self.store.parts(KEYS).values()) == 1 else _newest(entries)

    def place(self) -> list[Column]:
        """By what keys are shuffled to be staged: buckets, in pieces where the batch is large."""
        pieces = self.store.staged_bytes("orders") // (KEY_SLOTS * PIECE) + 1
        return [self.store.tables[KEYS].slot_of(), F.pmod(F.hash("id"), F.lit(pieces))]

    def stage(self, marked: DataFrame, version: int, was: str, *more: str) -> DataFrame:
        """Write the marked keys as the part of the index that ``extend`` enters, once the orders
        have that version, and read them back. ``was``: the month under which a key is stored,
        null for a new one. Keys lie as ``place`` says."""
        slot = self.store.tables[KEYS].slot
        same = F.col(was).eqNullSafe(F.col(MONTH_SLOT))
        rows = marked.withColumns({
            MONTH: F.col(MONTH_SLOT), "at": F.lit(version).cast("long"),
            slot: F.when(same, F.lit(SAME)).otherwise(self.store.tables[KEYS].slot_of())})
        return self.store.stage(KEYS, rows, was, *more, placed=True)[0].withColumnRenamed(MONTH, MONTH_SLOT).drop("at", slot)

    def extend(self, marked: DataFrame | None, version: int) -> None:
        """Add the ids of a merged batch that are new or have another month. ``marked``
        has ``stored_month`` as it was and the month slot as it is now; without it the staged
        keys are entered."""
        if marked is None:
            self.store.append(KEYS, None, version, leave={SAME})
        else:
            moved = marked.filter(~F.col(MONTH).eqNullSafe(F.col(MONTH_SLOT)))
            rows = moved.select("id", F.col(MONTH_SLOT).alias(MONTH), F.lit(version).cast("long").alias("at"))
            self.store.append(KEYS, rows, version)
        full = {slot for slot, n in self.store.parts(KEYS).items() if n > self.most_parts}
        if full:
            rows = self.store.read(KEYS, full).groupBy("id").agg(F.max_by(MONTH, "at").alias(MONTH), F.max("at").alias("at"))
            self.store.publish(KEYS, stored(rows, "keys-compact"), full, version)


def _newest(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.max_by(MONTH, "at").alias(MONTH))


SUMS = {"product_days": days.product_days, "source_days": days.source_days}


def refresh(store: TableStore, name: str) -> DataFrame:
    """The sums by day ``name``, after those months are summed anew that were written
    since. Others are neither read nor written."""
    version, months = store.state("orders")
    covers = store.covers(name)
    if covers != version and (version or covers):
        changed = store.changed("orders", covers)
        gone = store.state(name)[1].keys() - months.keys()  # all their orders have moved
        store.publish(name, SUMS[name](store.read("orders", changed)), changed | gone, version)
    return store.read(name)
