"""Spark session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallywright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach, from ``spark.checkpoint.dir``.

    Without the setting it is a folder in the warehouse, which executors share too, unless
    that is a local folder and executors are other machines: then there is none, and this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", warehouse):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_tallywright"


def subfolders(spark: SparkSession, path: str, marker: str | None = None) -> list[str]:
    """Names of the folders in a folder, only those that hold a file ``marker`` if one
    is given; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s.getPath() for s in system.listStatus(folder) if s.isDirectory()]
    if marker:
        found = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, marker))]
    return sorted(p.getName() for p in found)


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the folders that ``stored`` writes inside, when the job ends.

    For jobs that publish their result elsewhere. Outside of it a stored table lives
    as long as the frames over it may be used, and the folder's owner expires it.
    """
    folders: list[str] = []
    token = _owned.set(folders)
    try:
        yield
    finally:
        _owned.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(frame: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``frame`` written to the shared folder and read back.

    For a result that several queries start from: it is computed once, survives
    the loss of executors, and its file sizes let Spark judge what it can
    broadcast. Partitions are rebalanced before the write: small ones share a
    file and one that holds much of the data is written by several tasks.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tallywright-{name}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    if partition_by:
        frame.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
