"""The import job: one upload into its table, as a whole or not at all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallywright.operators import upsert as U
from tallywright.plans.derived import MONTH, OrderKeys
from tallywright.schemas import UploadSpec
from tallywright.session import scratch, stored
from tallywright.sources.tables import TableStore
from tallywright.sources.uploads import ROW_ORDER, UploadRejected, clean_upload, refusing_malformed


@dataclass(frozen=True)
class ImportResult:
    created: int
    updated: int


def import_upload(store: TableStore, spec: UploadSpec, upload: DataFrame) -> ImportResult:
    """Check, clean and merge an upload; raises ``UploadRejected`` and changes nothing else.

    Importing the same upload again leads to the same table, so a job that was
    interrupted is simply run again.
    """
    if ROW_ORDER not in upload.columns:
        upload = upload.withColumn(ROW_ORDER, F.monotonically_increasing_id())
    return merge_rows(store, spec, clean_upload(upload, spec))


def merge_rows(store: TableStore, spec: UploadSpec, rows: DataFrame) -> ImportResult:
    """Merge typed rows with their position into the table; as ``import_upload``.

    The rows are written once, as files of the table's next version. From there on only keys
    are shuffled to tell how often each occurs and where it is stored: orders are found
    through the index of their ids, contacts in the slots that follow from theirs. Keys of
    orders are shuffled to the buckets of the index, so what tells about them is also
    what the index adds. Stored rows that the batch replaces are left out of the slots it
    touches, and the log entry makes both readable. Only where keys occur more than once, or
    stored rows have fields that the batch does not carry, its rows are joined with the stored ones.
    """
    key, slot, now = spec.key, store.tables[spec.table].slot, "__now"
    with scratch(store.spark):
        with refusing_malformed():
            staged, then = store.stage(spec.table, rows, ROW_ORDER)
        if not then:
            return ImportResult(0, 0)
        told = Observation(f"import-{spec.table}")
        tally = [*U.tally(), F.max(U.COPIES).alias("most"), F.collect_set(now).alias("now")]
        if spec.table == "orders":
            index = OrderKeys(store)
            known = index.near(staged)
            known = known and known.withColumnRenamed(MONTH, now)
            marked = U.marked_keys(staged, known, key, slot, now, index.place()).observe(told, *tally)
            marked = index.stage(marked, store.state(spec.table)[0] + 1, now, U.COPIES, U.FOUND)
        else:
            held = then & store.state(spec.table)[1].keys()
            known = store.read(spec.table, held).select(key, F.col(slot).alias(now)) if held else None
            marked = stored(U.marked_keys(staged, known, key, slot, now).observe(told, *tally), f"marked-{spec.table}")
        counts = told.get
        if counts["conflicts"]:
            twice = ", ".join(str(r[key]) for r in U.upsert_conflicts(marked, key).take(5))
            raise UploadRejected(
                f"new keys occur more than once in the {spec.table} upload ({counts['refused']} rows): {twice}")
        result = ImportResult(counts["created"], counts["updated"])

        # Where updated rows are now and where all rows of the batch belong.
        touched = {*counts["now"], *then}
        full = touched & store.state(spec.table)[1].keys()
        current, whole = store.read(spec.table, full), None
        if not full:
            version = store.publish(spec.table, None, touched, staged=True)
        elif counts["most"] == 1 and not _has_other_fields(current.drop(slot), staged, key):
            kept = current.select(*[f for f in current.columns if f in staged.columns])
            if result.updated:
                gone = marked.filter(U.FOUND).select(key, F.col(now).alias(slot))
                kept = U.without(kept, gone, key, slot, store.piece(spec.table, full, key))
            version = store.publish(spec.table, kept, touched, staged=True, placed=bool(result.updated))
        else:
            batch, at = U.last_rows(staged.drop(slot), key), marked.filter(F.col(now).isNotNull())
            whole = stored(store.with_slot(spec.table, U.mark_stored(batch, at.select(key, now), key)), f"whole-{spec.table}")
            version = store.publish(spec.table, U.merged(current.drop(slot), whole.drop(slot, now), key), touched)
            whole = whole.withColumnRenamed(now, MONTH)
        if spec.table == "orders":
            index.extend(whole, version)
        return result


def _has_other_fields(current: DataFrame, batch: DataFrame, key: str) -> bool:
    """Whether stored rows have values in fields that the batch does not carry."""
    others = [F.col(f).isNotNull() for f in current.columns if f not in batch.columns and f != key]
    return bool(others) and not current.filter(reduce(Column.__or__, others)).isEmpty()
