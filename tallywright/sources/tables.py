"""Stored tables: Parquet in version folders, published all at once.

A table is cut into slots by a partition column (orders by month, contacts by
a hash of the id). A change writes only the slots it touches, into a new
version folder; one small file in the table's log then says which version of
each slot counts (or versions, where rows were appended). Readers see the change when
that file appears, and never a part of it. One writer per table at a time; a job that
died before the log file leaves only a folder that nobody reads and the next run overwrites.

A table may follow from another one. Its log then also tells which version of that one it
covers, and the slots with a later version are what has changed since.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators.filters import MONTH_SLOT, month_slot
from tallywright.schemas import (
    CONTACTS_SCHEMA,
    KEYS_SCHEMA,
    LINKS_SCHEMA,
    NAMED_SCHEMA,
    ORDERS_SCHEMA,
    PRODUCT_DAYS_SCHEMA,
    SOURCE_DAYS_SCHEMA,
)
from tallywright.session import subfolders

CONTACT_SLOTS, KEY_SLOTS = 16, 64
#: Bytes of a slot's files for each task that writes it, where rows are put in place by a key.
PIECE = 32 << 20
_LOG = "slot string, slot_version long, covers long"


@dataclass(frozen=True)
class TableSpec:
    """``sort``: by what a slot's files are sorted, so that readers can skip most of them;
    ``blooms``: columns whose values the files' Bloom filters tell."""

    schema: T.StructType
    slot: str
    slot_of: Callable[[], Column]
    sort: tuple[str, ...] = ()
    blooms: tuple[str, ...] = ()


def _id_bucket() -> Column:
    return F.format_string("b%02d", F.pmod(F.xxhash64("id"), F.lit(CONTACT_SLOTS)))


def _key_bucket() -> Column:
    return F.format_string("k%02d", F.pmod(F.xxhash64("id"), F.lit(KEY_SLOTS)))


def _whole() -> Column:
    return F.lit("all")


TABLES = {
    "orders": TableSpec(ORDERS_SCHEMA, MONTH_SLOT, month_slot, ("utm_source", "id"), ("id", "utm_source")),
    "contacts": TableSpec(CONTACTS_SCHEMA, "id_bucket", _id_bucket),
    "products": TableSpec(NAMED_SCHEMA, "part", _whole),
    "product_categories": TableSpec(NAMED_SCHEMA, "part", _whole),
    "product_category_association": TableSpec(LINKS_SCHEMA, "part", _whole),
}

#: Tables that follow from the orders; neither listed nor exported.
DERIVED = {
    "order_keys": TableSpec(KEYS_SCHEMA, "key_bucket", _key_bucket, ("id",)),
    "product_days": TableSpec(PRODUCT_DAYS_SCHEMA, MONTH_SLOT, month_slot, ("content",)),
    "source_days": TableSpec(SOURCE_DAYS_SCHEMA, MONTH_SLOT, month_slot, ("utm_source",)),
}


class TableStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, TableSpec] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.own = dict(tables or TABLES)
        self.tables = self.own | DERIVED
        self._logs: dict[str, tuple[int, list[tuple[str, int]], int | None]] = {}

    # --- reading ---------------------------------------------------------

    def _log(self, name: str) -> tuple[int, list[tuple[str, int]], int | None]:
        """The latest version, its slots with a version each (a slot to which rows were
        appended several times), and the version it covers of what it follows from.

        Each log entry lists all slots, so the newest one is found by listing the
        log's folder, and only that one is read: one row per slot and part. An entry
        never changes, so it is read once.
        """
        log = f"{self.root}/{name}/log"
        versions = [
            int(entry.removeprefix("version=")) for entry in subfolders(self.spark, log, marker="_SUCCESS")
            if entry.startswith("version=")
        ]
        if not versions:
            return 0, [], None
        newest = max(versions)
        if name in self._logs and self._logs[name][0] == newest:
            return self._logs[name]
        rows = self.spark.read.schema(_LOG).parquet(f"{log}/version={newest}").collect()
        covers = next((r.covers for r in rows if r.covers is not None), None)
        self._logs[name] = newest, sorted((r.slot, r.slot_version) for r in rows if r.slot is not None), covers
        return self._logs[name]

    def state(self, name: str) -> tuple[int, dict[str, int]]:
        """The latest version and the newest version of each slot."""
        newest, parts, _ = self._log(name)
        return newest, dict(parts)  # in order, so the highest version of a slot stays

    def covers(self, name: str) -> int | None:
        """The version of its origin that a derived table has taken in; none at first."""
        return self._log(name)[2]

    def changed(self, name: str, since: int | None) -> set[str]:
        """Slots that were written after version ``since``; all of them without one."""
        return {slot for slot, version in self.state(name)[1].items() if since is None or version > since}

    def parts(self, name: str) -> dict[str, int]:
        """How many parts each slot has: one, and one more for each time rows were appended."""
        return dict(Counter(slot for slot, _ in self._log(name)[1]))

    def read(self, name: str, slots: set[str] | None = None) -> DataFrame:
        """The current rows; the slot column comes last. ``slots`` limits the read."""
        spec = self.tables[name]
        schema = self._stored_schema(name)
        base = f"{self.root}/{name}/data"
        paths = [
            f"{base}/version={version}/{spec.slot}={slot}"
            for slot, version in self._log(name)[1]
            if slots is None or slot in slots
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return rows.select(*schema.fieldNames())

    def _stored_schema(self, name: str) -> T.StructType:
        spec = self.tables[name]
        return T.StructType([*spec.schema.fields, T.StructField(spec.slot, T.StringType())])

    # --- writing ---------------------------------------------------------

    def with_slot(self, name: str, rows: DataFrame) -> DataFrame:
        spec = self.tables[name]
        return rows.withColumn(spec.slot, spec.slot_of())

    def stage(self, name: str, rows: DataFrame, *more: str, placed: bool = False) -> tuple[DataFrame, set[str]]:
        """``rows`` as files of the next version, for a ``publish`` or ``append`` that follows; until
        then no reader sees them. Returns them with their slots, and the set of slots; ``more``:
        columns to write beside those of the table; ``placed``: as for ``publish``."""
        version, fields = self._log(name)[0] + 1, self._fields(name, rows, *more)
        slots = self._write(name, rows, version, more, placed=placed)
        schema = T.StructType([*rows.select(*fields).schema.fields, T.StructField(self.tables[name].slot, T.StringType())])
        if not slots:
            return self.spark.createDataFrame([], schema), slots
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/data/version={version}"), slots

    def staged_bytes(self, name: str) -> int:
        """The size of what is staged as the next version."""
        return self._bytes(f"{self.root}/{name}/data/version={self._log(name)[0] + 1}")

    def piece(self, name: str, slots: set[str], key: str) -> Column:
        """A number by the key for rows that are put in place by slot: one for most slots, and
        more where a slot's files are large, so that no task gets all of it."""
        sizes: Counter[str] = Counter()
        for slot, version in self._log(name)[1]:
            if slot in slots:
                sizes[slot] += self._bytes(f"{self.root}/{name}/data/version={version}/{self.tables[name].slot}={slot}")
        large = [F.lit(x) for slot, size in sizes.items() if size > PIECE for x in (slot, size // PIECE + 1)]
        if not large:
            return F.lit(0)
        pieces = F.coalesce(F.create_map(*large)[F.col(self.tables[name].slot)], F.lit(1))
        return F.pmod(F.xxhash64(key), pieces)

    def _bytes(self, path: str) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def publish(
        self, name: str, rows: DataFrame | None, touched: set[str] | None = None, covers: int | None = None, staged: bool = False,
        placed: bool = False,
    ) -> int:
        """Make ``rows`` the content of the ``touched`` slots (of all, if not given), together
        with the ``staged`` ones. ``placed`` rows have their slots and are in their places: they
        are written as they lie, without a shuffle."""
        version, parts, _ = self._log(name)
        written = self._write(name, rows, version + 1, mode="append" if staged else "overwrite", placed=placed)
        kept = [] if touched is None else [(s, v) for s, v in parts if s not in touched]
        stray = written & {s for s, _ in kept}
        if stray:
            raise ValueError(f"rows outside the touched slots of {name}: {sorted(stray)[:5]}")
        return self._enter(name, version + 1, kept + [(s, version + 1) for s in written], covers)

    def append(self, name: str, rows: DataFrame | None, covers: int | None = None, leave: set[str] = frozenset()) -> int:
        """Add ``rows``, or what is staged, to what their slots hold already; nothing is read or
        rewritten. Staged slots to ``leave`` are not added."""
        version, parts, _ = self._log(name)
        written = self._write(name, rows, version + 1) - leave
        return self._enter(name, version + 1, parts + [(s, version + 1) for s in written], covers)

    def cover(self, name: str, covers: int) -> int:
        """Only enter that the table, as it is, covers a later version of its origin."""
        version, parts, _ = self._log(name)
        return self._enter(name, version + 1, parts, covers)

    def _fields(self, name: str, rows: DataFrame, *more: str) -> list[str]:
        return [f for f in (*self.tables[name].schema.fieldNames(), *more) if f in rows.columns]

    def _write(
        self, name: str, rows: DataFrame | None, version: int, more: tuple[str, ...] = (), mode: str = "overwrite", placed: bool = False,
    ) -> set[str]:
        """Write a version's rows; returns the slots that have some."""
        folder = f"{self.root}/{name}/data/version={version}"
        if rows is not None:
            chosen = rows.select(*self._fields(name, rows, *more), *([self.tables[name].slot] if placed else []))
            self._write_files(name, chosen if placed else self.with_slot(name, chosen), folder, mode, placed)
        prefix = f"{self.tables[name].slot}="
        return {f.removeprefix(prefix) for f in subfolders(self.spark, folder) if f.startswith(prefix)}

    def _write_files(self, name: str, slotted: DataFrame, folder: str, mode: str, placed: bool = False) -> None:
        spec = self.tables[name]
        # Rebalancing gathers a slot's rows into few files, and cuts a slot
        # that holds much of the table into as many tasks as its size asks for.
        spread = slotted if placed else slotted.hint("rebalance", spec.slot)
        if spec.sort:
            spread = spread.sortWithinPartitions(spec.slot, *spec.sort)
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in spec.blooms}
        if blooms:  # as large as a file's values ask for
            blooms["parquet.bloom.filter.adaptive.enabled"] = "true"
        spread.write.mode(mode).options(**blooms).partitionBy(spec.slot).parquet(folder)

    def _enter(self, name: str, version: int, parts: list[tuple[str, int]], covers: int | None) -> int:
        entries = [(s, v, covers) for s, v in sorted(parts)] or [(None, None, covers)]
        self.spark.createDataFrame(entries, _LOG).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/{name}/log/version={version}"
        )
        return version
