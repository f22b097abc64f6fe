"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder: within the one that the session names in spark.checkpoint.dir, else in the warehouse.

    Only where all of Spark is one local process is it a temporary folder of this machine.  On a cluster one of the two
    settings has to name a folder that all machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and (master == "local" or master.startswith("local[")):
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/cairn-{spark.sparkContext.applicationId}"


#: The lists of the blocks that this thread is in.
_within: ContextVar[tuple[list[str], ...]] = ContextVar("within", default=())


@contextmanager
def tables() -> Iterator[list[str]]:
    """Lists the paths that are given out in a block, in order, so that their tables can be removed when it is done."""
    made: list[str] = []
    before = _within.set((*_within.get(), made))
    try:
        yield made
    finally:
        _within.reset(before)


def scratch_path(spark: SparkSession) -> str:
    """A new path there."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    for made in _within.get():
        made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Writes df there and reads it back: cuts the lineage, survives lost executors, has a known size."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all of this application's scratch tables; to be called when no result that reads them is needed any more."""
    remove(spark, [folder(spark)])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no result needs any more; paths without one are passed over."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
