"""Intermediate tables: lineage ends in a written table in the folder that driver and executors share.

What a function returns may read its tables later, so it cannot delete them itself: store the result, then :func:`release`
what has been written, or wrap both in :func:`tables_of`.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LET_GO_S = 0.3

_own: list[tempfile.TemporaryDirectory] = []  # deleted when the interpreter ends
_paths: list[str] = []  # of tables that have not been released


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local session and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="corpusloom-", ignore_cleanup_errors=True))
    return _own[0].name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once, written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` in zstd, after which Spark lets go of the shuffle files that the table came from.

    These go when the driver collects their owners, which it seldom does by itself: without that each step's stay to the end. One
    collection leaves some of the owners, which other threads let go only then; two more take them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths.append(path)
    gc.collect()
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(LET_GO_S)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that :func:`written` has left, from the ``since``-th on; how many."""
    gone = _paths[since:]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _paths[since:]
    return len(gone)


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Release the tables that are written inside, when what is computed there has been stored."""
    since = len(_paths)
    try:
        yield
    finally:
        release(spark, since)
