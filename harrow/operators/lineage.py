"""Cut points of long runs: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def _shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine may that setting be missing, and a folder of our own serves then."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="harrow-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, so that later steps neither plan nor compute what lies before.

    Its size is known from then on, so small tables are broadcast by their size and large ones are not.
    The tables stay until ``clear`` or the end of the Python process.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/harrow-cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear_at_exit)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``cut`` has written; call it when their readers are done."""
    conf = spark._jsc.hadoopConfiguration()
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(conf).delete(target, True)


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the process ends, and with it perhaps the session
            clear(spark)
