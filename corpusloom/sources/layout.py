"""Where data lies and in which form: paths, formats, manifests and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _exists

HUB = "hf://"


def resolve(path: str, exists) -> str:
    """A local path as it is. A hub address is an error here, as there is no network; a missing path is not taken for one."""
    if path.startswith(HUB):
        raise NotImplementedError(f"{path}: download it first")
    if not exists(path):
        raise FileNotFoundError(path)
    return path


def present_domains(spark: SparkSession, base: str, domains: tuple[str, ...]) -> list[str]:
    """Domains whose folder is there; the others are left out."""
    return [d for d in domains if _exists(spark, f"{base}/{d}")]


def detect_format(names: list[str], task: str) -> str:
    """``sft``: archives win, else train.jsonl. ``dpo``: archives or JSON lines are tokenized, other single files raw."""
    if any(n.endswith(".npz") for n in names):
        return "npz"
    if task == "sft":
        if any(n.rsplit("/", 1)[-1] == "train.jsonl" for n in names):
            return "jsonl"
        raise FileNotFoundError("neither archives nor train.jsonl")
    if len(names) == 1:
        return "tokens" if names[0].endswith(".jsonl") else "raw"
    raise FileNotFoundError("no preference data")


def load_settings(kind: type, text: str):
    """A dataclass from JSON; unknown keys are ignored."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in json.loads(text).items() if k in known})


def latest_checkpoint(spark: SparkSession, path: str) -> str | None:
    """The folder that latest_checkpoint.json names, if it is there."""
    if not _exists(spark, path):
        return None
    row = spark.read.option("multiLine", "true").json(path).select("latest_path").first()
    return row["latest_path"] if row and row["latest_path"] and _exists(spark, row["latest_path"]) else None


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines unless a finished write is there, and read them."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").json(path)
    return spark.read.schema(df.schema).json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Per-domain metadata, with ``error`` where a domain failed, as one JSON file."""
    out = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    out.coalesce(1).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class ModelConfig:
    """Sizes that the parameter count needs."""

    vocab_size: int = 206_464
    d_model: int = 1024
    n_layers: int = 12
    attention_layers: tuple[int, ...] = ()
    dense_layers: tuple[int, ...] = ()
    expert_layers: tuple[int, ...] = ()
    recurrent_parameters: int = 0
    n_heads: int = 16
    n_kv_heads: int = 4
    head_dim: int = 64
    d_ff: int = 2816
    experts: int = 16
    d_ff_expert: int = 512

    def parameters(self) -> int:
        """Embedding, recurrent and attention layers, dense and expert feed-forward layers."""
        attention = 2 * self.d_model * self.head_dim * (self.n_heads + self.n_kv_heads)
        recurrent = self.n_layers - len(self.attention_layers)
        return (
            self.vocab_size * self.d_model
            + recurrent * self.recurrent_parameters
            + len(self.attention_layers) * attention
            + len(self.dense_layers) * 3 * self.d_model * self.d_ff
            + len(self.expert_layers) * self.experts * 3 * self.d_model * self.d_ff_expert
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)
