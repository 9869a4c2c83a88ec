"""Uploads dropped into a folder, imported one by one as they arrive."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallywright.plans.imports import ImportResult, import_upload
from tallywright.schemas import UPLOADS
from tallywright.sources.tables import TableStore
from tallywright.sources.uploads import UploadRejected, read_upload

log = logging.getLogger(__name__)

# The columns of Spark's binary file source; the content is never selected.
_FILE = "path string, modificationTime timestamp, length long, content binary"

OnResult = Callable[[str, ImportResult | UploadRejected], None]


def watch_uploads(
    store: TableStore,
    kind: str,
    folder: str,
    checkpoint: str,
    fmt: str = "csv",
    on_result: OnResult | None = None,
    **trigger,
) -> StreamingQuery:
    """Start importing the ``kind`` (orders, contacts) uploads that appear in ``folder``.

    The stream only carries the files' paths and remembers which were seen; each
    file is then imported like any upload, oldest first. A refused file is
    reported and does not stop the others. A trigger that is run again after a
    failure imports its files again, which leads to the same table. By default
    the query ends when all files present have been imported.
    """
    spark = store.spark
    report = on_result or (lambda path, result: log.info("%s: %s", path, result))

    def import_files(files: DataFrame, _batch: int) -> None:
        # One row per file of this trigger, at most maxFilesPerTrigger.
        for row in files.orderBy("modificationTime", "path").collect():
            try:
                result = import_upload(store, UPLOADS[kind], read_upload(spark, row.path, fmt))
            except UploadRejected as refused:
                result = refused
            report(row.path, result)

    paths = (
        spark.readStream.format("binaryFile").schema(_FILE)
        .options(maxFilesPerTrigger=100, pathGlobFilter=f"*.{fmt}")
        .load(folder).select("path", "modificationTime")
    )
    return (
        paths.writeStream.foreachBatch(import_files)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
