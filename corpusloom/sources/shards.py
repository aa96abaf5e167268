"""Sequences in numbered shards with a cumulative manifest, and random access by global index.

A store is a folder of Parquet shards and a manifest beside it: a row a shard with its number of rows and where it starts and
stops in the whole. An index is looked up in the manifest, whose ranges meet it by an equi-join on blocks of indexes, and
then only the shards that are asked for are opened: their folders are named to the reader, so that no other file is listed.
Within a shard rows are sorted, and the reader skips row groups by their place.

Appending numbers the new rows and shards on from the last ones and reads no old shard. A batch of shards counts from when its part of
the manifest is written, as one job; what a lost or failed job leaves behind belongs to no batch and is never read.

Edge cases: an index at or beyond the end wraps around, a negative one counts from the end; a null index finds nothing;
an index that is asked for twice gives two rows; of columns that clash, those asked with are kept and the shard's go; an
empty store finds nothing; appending no rows adds no shard. The last shard of a batch may be smaller than the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import row_index
from ..functions.tables import tables_of, written
from .text import _exists

LISTED = 10_000  # shards that are named to the reader; with more, the join alone decides which rows are used
MANIFEST = "batch string, shard_id long, rows long, start long, stop long"


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """``MANIFEST`` of every shard."""
        if not _exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def _end(self) -> tuple[int, int]:
        last = self.manifest().agg(F.max("shard_id"), F.max("stop")).first()
        return (0, 0) if last[0] is None else (last[0] + 1, last[1])

    def total(self) -> int:
        return self._end()[1]

    def append(self, sequences: DataFrame, order: tuple[str, ...], size: int) -> int:
        """Add rows in ``order`` (a number first, then what breaks ties) as shards of ``size`` rows; how many shards."""
        with tables_of(self.spark):
            return self._append(sequences, order, size)

    def _append(self, sequences: DataFrame, order: tuple[str, ...], size: int) -> int:
        batch, (first, start) = uuid.uuid4().hex, self._end()
        narrow = written(sequences.withColumn("_at", F.monotonically_increasing_id()), "sequences")
        places = row_index(narrow.select(*order, "_at"), order[0], "_place", ties=(*order[1:], "_at")).select("_at", "_place")
        rows = narrow.join(places, "_at").withColumn("shard_id", F.floor(F.col("_place") / size) + first).withColumn("row_in_shard", F.col("_place") % size)
        rows = rows.drop("_at", "_place").repartition("shard_id").sortWithinPartitions("shard_id", "row_in_shard")
        data = f"{self.path}/data/batch={batch}"
        rows.write.partitionBy("shard_id").parquet(data)
        if not narrow.limit(1).count():
            return 0
        counts = self.spark.read.parquet(data).groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"))
        # All shards of a batch but the last are full, so the ends need no running total.
        before = F.lit(start) + (F.col("shard_id") - first) * size
        new = counts.select(F.lit(batch).alias("batch"), F.col("shard_id").cast("long"), "rows", before.cast("long").alias("start"), (before + F.col("rows")).cast("long").alias("stop"))
        new = written(new, "manifest")
        new.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return new.count()

    def place(self, wanted: DataFrame, idx: str = "idx") -> DataFrame:
        """``wanted`` with batch, shard_id and row_in_shard of each index."""
        shards = written(self.manifest(), "manifest")
        size = shards.agg(F.count(F.lit(1)).alias("n"), F.max("stop").alias("total")).first()
        if not size["n"]:
            return wanted.filter("false").select("*", F.lit("").alias("batch"), F.lit(0).cast("long").alias("shard_id"), F.lit(0).cast("long").alias("row_in_shard"))
        step = max(1, size["total"] // size["n"])  # a shard lies in two blocks on average
        block = lambda x: F.floor(x / step).cast("long")
        covered = shards.filter("rows > 0").withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.col("stop") - 1))))
        asked = wanted.withColumn("_at", F.pmod(F.col(idx), F.lit(size["total"]))).withColumn("_block", block(F.col("_at")))
        met = asked.join(covered.select("batch", "shard_id", "start", "stop", "_block"), "_block").filter((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("stop")))
        return met.withColumn("row_in_shard", F.col("_at") - F.col("start")).drop("_block", "_at", "start", "stop")

    def locate(self, wanted: DataFrame, idx: str = "idx") -> DataFrame:
        """``wanted`` with the columns of the row that each index names."""
        names = {c: f"_wanted_{c}" for c in wanted.columns}
        placed = written(self.place(wanted.withColumnsRenamed(names), names[idx]), "placed")
        asked = placed.select("batch", "shard_id").distinct().limit(LISTED + 1).collect()  # bounded, or all
        if not asked:
            return wanted.filter("false")
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        rows = reader.parquet(*([f"{self.path}/data/batch={r['batch']}/shard_id={r['shard_id']}" for r in asked] if len(asked) <= LISTED else [f"{self.path}/data"]))
        rows = rows.withColumns({"batch": F.col("batch").cast(T.StringType()), "shard_id": F.col("shard_id").cast("long")})
        found = placed.join(rows, ["batch", "shard_id", "row_in_shard"]).drop("batch")
        return found.drop(*wanted.columns).withColumnsRenamed({v: k for k, v in names.items()})
