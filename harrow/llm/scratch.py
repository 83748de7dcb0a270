"""Tables that cut lineage, written to the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests on
one machine) a folder of our own is made, and only for a local master.

A table belongs to the owner that is set when it is written, and ``release`` deletes an owner's
tables and no others.  A query's result is read after the query returns, so a query's tables have no
owner; they stay until ``release(spark, "")`` or the end of the Python process that wrote them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[str] = ContextVar("owner", default="")
#: Paths by thread and owner.
_written: dict[tuple[int, str], list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="harrow-"))
    return context.getCheckpointDir().rstrip("/")


@contextlib.contextmanager
def owner(name: str) -> Iterator[None]:
    """Tables written within belong to ``name``, in this thread."""
    before = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(before)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/harrow-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_all)
    _written.setdefault((threading.get_ident(), _owner.get()), []).append(path)
    return path


def write(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    return write(df, tag)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete one table; call it once its readers are done."""
    for paths in _written.values():
        if path in paths:
            paths.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, name: str) -> None:
    """Delete what this thread wrote for the owner ``name``; call it once its readers are done."""
    for path in list(_written.get((threading.get_ident(), name), [])):
        delete(spark, path)


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the process ends, and with it perhaps the session
            for path in [p for paths in _written.values() for p in paths]:
                delete(spark, path)
