"""Curation in batches: what comes later is held against all that was kept before.

A store keeps, for each batch, the clean rows, their keys, and a row of counts; beside them a bounded filter of all keys. A
batch is filtered and deduplicated by itself. Then its keys are held against the filter: those that it does not know are
new, and only the others are joined with the keys of the earlier batches, which decides. So batches after another keep the same rows as
one batch of all, and a batch costs what it holds and not what lies there already.

A batch counts from when its row of counts is written, last of all. What a lost run leaves behind belongs to no
batch and is never read; a batch that is there already is not run again, which is how a run resumes.

Counts are observed in the job that reads the rows, without a scan of their own.

Edge cases: those of the rules and of deduplication hold within a batch; a null domain is one domain; of repeated rows one
stays, in the first batch that has it; an empty batch leaves a row of counts and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions import text as tx
from ..functions.tables import tables_of, written
from ..operators import curation
from ..sources.text import _exists

BATCHES = "number long, batch string, folder string, n_read long, quality_fail long, dup_inside long, dup_before long, n_kept long"


class CleanStore:
    def __init__(self, spark: SparkSession, path: str, words: int = bloom.WORDS):
        self.spark, self.path, self.words = spark, path.rstrip("/"), words

    def batches(self) -> DataFrame:
        """``BATCHES``, one row a batch."""
        if not _exists(self.spark, f"{self.path}/batches"):
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")

    def _folders(self) -> list[str]:
        return [r["folder"] for r in self.batches().select("folder").collect()]  # one row a batch

    def _read(self, what: str, schema) -> DataFrame:
        folders = [f"{self.path}/{what}/{f}" for f in self._folders()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self, schema) -> DataFrame:
        """The rows kept so far; ``schema`` is that of the documents."""
        return self._read("clean", schema)

    def add(self, docs: DataFrame, batch: str, order: str = "doc_id", domain: str = "source", rules: curation.QualityRules = curation.QualityRules()) -> dict:
        """Curate ``docs`` and keep what is new; the batch's row of counts. A batch of that name that is there is left as it is."""
        done = self.batches().filter(F.col("batch") == batch).first()
        if done:
            return done.asDict()
        with tables_of(self.spark):
            return self._add(docs, batch, order, domain, rules)

    def _add(self, docs: DataFrame, batch: str, order: str, domain: str, rules: curation.QualityRules) -> dict:
        folder = f"{batch}-{uuid.uuid4().hex}"
        seen_keys = self._read("keys", "scoped string")
        passes = curation.reason(F.col("text"), rules).isNull() | F.col(domain).isin(*rules.unfiltered)
        read = Observation(f"read-{folder}")
        rows = docs.filter(tx.present(F.col("text"))).withColumn("_ok", F.coalesce(passes, F.lit(False)))
        failed = F.coalesce(F.sum(F.when(F.col("_ok"), 0).otherwise(1)), F.lit(0)).cast("long")
        rows = written(rows.observe(read, F.count(F.lit(1)).alias("n"), failed.alias("failed")), "documents")
        first = curation.dedup_exact(rows, order, domain, among=rows.filter("_ok"))
        scoped = F.concat(F.coalesce(F.concat(F.lit("="), F.col(domain)), F.lit("")), F.lit("|"), curation.dedup_key(F.col("text")))
        before = self._filter()
        asked = written(bloom.maybe_seen(first.withColumn("_scoped", scoped), "_scoped", before, "_maybe", self.words), "asked")
        maybe = asked.filter("_maybe").join(seen_keys.withColumnRenamed("scoped", "_scoped"), "_scoped", "left_anti")
        kept = written(asked.filter("NOT _maybe").unionByName(maybe), "kept")
        kept.select(*docs.columns).write.parquet(f"{self.path}/clean/{folder}")
        kept.select(F.col("_scoped").alias("scoped")).write.parquet(f"{self.path}/keys/{folder}")
        bloom.merge(before.unionByName(bloom.build(kept, "_scoped", self.words))).write.parquet(f"{self.path}/filter/{folder}")
        inside, n, counts = asked.count(), kept.count(), read.get  # the tables' own numbers of rows
        row = (self.batches().count(), batch, folder, counts["n"], counts["failed"], counts["n"] - counts["failed"] - inside, inside - n, n)
        self.spark.createDataFrame([row], BATCHES).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return dict(zip((c.split()[0] for c in BATCHES.split(", ")), row, strict=True))

    def _filter(self) -> DataFrame:
        """The filter that the last batch has left; it holds those before it."""
        last = self.batches().orderBy(F.desc("number")).first()
        schema = "word int, bits long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/filter/{last['folder']}") if last else self.spark.createDataFrame([], schema)
