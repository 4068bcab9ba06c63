"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from ..blocks.frame import Frame

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset, a local folder serves only a master whose executors are on this machine; on a
    cluster each executor would write to its own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quern-tables"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and reads it back.

    Cuts the lineage: what follows rereads these files when executors are lost, and nothing above
    is computed twice. The files go when dropped() is called or the driver's Spark ends. A block's rows are in memory already.
    """
    if isinstance(df, Frame):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as the query ends.

    Else they stay until the driver happens to collect its garbage, so a chain of tables holds the shuffles of all.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def dropped(df: DataFrame) -> None:
    """Deletes the files of what written() gave, which no later step may read."""
    if path := _paths.pop(df, None):
        where, files = _file_system(df.sparkSession, path)
        files.delete(where, True)
