"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``.  A lost
executor then costs a re-read, not a recomputation, and nothing depends on a
machine-local folder.  Tables are grouped under the application id and removed
when the driver process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no folder (single-machine tests).
LOCAL_FALLBACK = "file:///tmp/checkpoints/stratafold"

_roots: set[str] = set()
_scope: ContextVar[list[str] | None] = ContextVar("scratch scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_FALLBACK
    root = f"{base.rstrip('/')}/stratafold-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(remove, spark, root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; silent when the session has already ended."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Lists the paths of tables written within it, which ``remove`` may free once nothing reads them any more."""
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield written
    finally:
        _scope.reset(token)


#: Rows that go to Python at once while a table is written: texts are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_lock = threading.Lock()
_writing: list[str] = []


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Several threads may write at once; the first sets the size and the last puts it back."""
    with _lock:
        held = _writing[0] if _writing else spark.conf.get(_BATCH)
        _writing.append(held)
        spark.conf.set(_BATCH, str(min(int(held), BATCH_ROWS) if int(held) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        with _lock:
            _writing.pop()
            if not _writing:
                spark.conf.set(_BATCH, held)


def save(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return the reread table and its path."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    written = _scope.get()
    if written is not None:
        written.append(path)
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``save`` without the path."""
    return save(df, tag)[0]
