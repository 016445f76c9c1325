"""Helpers that several operators use: reading tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small lookup table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder, local or remote."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is spark.checkpoint.dir. Only where that is unset and the master is local, as in tests on one
    machine, a temporary folder takes its place; on a cluster it must be set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared folder, for what is large or read in part: columns compress, and unread ones stay on disk.

    The table goes with the block of tables_of_block that it was stored in; outside of one it stays until the folder is emptied.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    owned = _BLOCK.get()
    if owned is not None:
        owned.append(path)
    return df.sparkSession.read.parquet(path)


#: Tables stored in the block that runs now.
_BLOCK: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables_of_block(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within it, and no others; results that read them must be written by then."""
    paths: list[str] = []
    before = _BLOCK.set(paths)
    try:
        yield
    finally:
        _BLOCK.reset(before)
        for path in paths:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The count stops after ``max_rows`` + 1 rows. Call it on a table that is cheap to read.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows of whole texts that a Python worker gets at once.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's rows per Arrow batch to ``rows``; texts can be long, and a batch is held whole by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
