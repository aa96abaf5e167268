"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What a stage returns is written as
Parquet and read again as the next one's ``docs``; all stages but the last return the columns of ``documents``. Executors
go through all stages, so each stage bounds the batches that it sends to Python (a setting of the session, which stays).

Edge cases follow the operators. Null and empty texts fail the base rules of the first stage and go there; by themselves, a
later stage keeps them (scored like any text, equal ones one class, no secrets, one separator). Very long texts are read
whole. Repeated rows are judged alike and one of them stays after the near-duplicate stage; of rows that tie there, the
one of least id and then least content hash. Further columns pass through, whatever their names, but for ``n_chars``,
which follows the text. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import orderminhash, packing, quality, secrets, toxicity
from corpusloom.llm.common import bound_batches, forget, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents at or above the decision score go."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order MinHash: one document of each group of near duplicates stays."""
    bound_batches(spark)
    return orderminhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every finding is replaced by a mark, and n_chars follows the text."""
    bound_batches(spark)
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", drop_toxic),
    ("order_minhash", keep_one_of_each),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Boosted trees, sketches and a trained network have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
