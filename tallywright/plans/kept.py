"""A workspace filled by imports from the given tables, for the queries over what it keeps."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.plans import star as S
from tallywright.plans.imports import merge_rows
from tallywright.plans.workspace import Workspace
from tallywright.schemas import ORDER_UPLOAD
from tallywright.session import shared_folder
from tallywright.sources.uploads import ROW_ORDER

_spaces: dict[tuple, Workspace] = {}
_lock = threading.Lock()


def empty_space(star: S.Star) -> Workspace:
    return Workspace(star.spark, f"{shared_folder(star.spark)}/tallywright-space-{uuid.uuid4().hex}")


def sales(star: S.Star, sql: str) -> DataFrame:
    """Typed rows as an upload has them after cleaning."""
    rows = S.sales_lines(star.spark, star.sf_dir, sql).withColumn("income", F.col("income").cast("double"))
    return rows.withColumn(ROW_ORDER, F.monotonically_increasing_id())


def kept(star: S.Star) -> Workspace:
    """Two imports, with a sync of the products and sums by day after each. Made once for
    each state of the tables that it comes from."""
    names = ("lineitem", "orders", "part")
    source = (star.spark.sparkContext.applicationId, *(S.files_of(star.spark, f"{star.sf_dir}/{t}.parquet") for t in names))
    with _lock:
        space = _spaces.get(source)
        if space is None or not space.store.state("orders")[0]:
            space = _spaces[source] = empty_space(star)
            for sql in (S.SALES_BEFORE, S.SALES_BATCH):
                merge_rows(space.store, ORDER_UPLOAD, sales(star, sql))
                space.sync_products()
                space.product_days, space.source_days  # noqa: B018  the months of this import are summed
        return space
