"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session (tests) gets one of its own; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tastemill-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: ``paths``: of the tables that this thread writes and passing() deletes
_own = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: it is worked out once, and its lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and blocks of frames that nothing refers to: it learns of them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread keeps inside are deleted at the end, and the shuffle files released; only numbers may leave the block."""
    before, _own.paths = getattr(_own, "paths", None), []
    try:
        yield
    finally:
        paths, _own.paths = _own.paths, before
        for path in paths:
            delete(spark, path)
        release(spark)
