"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir

_scratch: list[dict[str, DataFrame]] = []
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on, the session sends Python at most ``BATCH_BYTES`` of rows at once, or one row; a lower setting stays.

    By default it is 64 MB. A batch is held by the JVM, outside of its heap, and by Python, and neither returns to the
    system all that large ones took, so an executor grows by them step by step. Frames that are evaluated later need the
    setting too: it is not taken back.
    """
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(BATCH, None) or "")
    if size is None or int(size[1]) << 10 * " kmgt".index(size[2] or " ") > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scratch:
        _scratch[-1][path] = out
    return out


def forget(*tables: DataFrame, collect: bool = True) -> None:
    """Delete tables of :func:`materialize` that nothing lazy reads any more, and let Spark drop their shuffle files."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for names in _scratch:
            names.pop(df.written_at, None)
    if tables and collect:
        collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects their owners."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch():
    """Forget all tables that are written inside, but those given to the function this yields."""
    _scratch.append({})

    def keep(*tables: DataFrame) -> None:
        for df in tables:
            _scratch[-1].pop(df.written_at, None)
            if len(_scratch) > 1:
                _scratch[-2][df.written_at] = df

    try:
        yield keep
    finally:
        forget(*_scratch.pop().values())


def utf8_crc32(text):
    """Unsigned CRC-32 of a string column's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def ascii_lower(text):
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
