"""Preference pairs, their losses and rolling metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chat import IGNORED, collate, mask_to_labels
from .tokens import BOS, PAD

SIDES = ("chosen", "rejected")


def last_content(text: Column | None = None, messages: Column | None = None) -> Column:
    """A completion is a string or the content of the last of its messages."""
    last = F.try_element_at(messages, F.lit(-1))["content"] if messages is not None else None
    if text is None:
        return F.coalesce(last, F.lit(""))
    return F.coalesce(text, last, F.lit("")) if last is not None else F.coalesce(text, F.lit(""))


def _fit(col: Column, length: int, pad: int) -> Column:
    cut = F.slice(col, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def pretokenized(pairs: DataFrame, length: int) -> DataFrame:
    """``{side}_input_ids`` and ``{side}_labels`` of tokenized pairs.

    Columns: ``{side}_full_ids`` and ``{side}_loss_mask``, or ``prompt_ids`` and ``{side}_ids``; each row uses what it
    has. Without a mask the prompt and its marker do not count.
    """
    has = set(pairs.columns)
    null = F.lit(None).cast("array<int>")
    col = lambda name: F.col(name) if name in has else null
    out = pairs
    for side in SIDES:
        ids = F.coalesce(col(f"{side}_full_ids"), F.concat(F.array(F.lit(BOS)), col("prompt_ids"), col(f"{side}_ids")))
        prompt = F.coalesce(F.size(F.coalesce(col("prompt_ids"), F.array().cast("array<int>"))), F.lit(0)) + 1
        inferred = F.concat(F.array_repeat(F.lit(0), prompt), F.array_repeat(F.lit(1), F.greatest(F.lit(0), F.size(ids) - prompt)))
        mask = F.coalesce(col(f"{side}_loss_mask"), inferred)
        out = out.withColumn(f"{side}_input_ids", _fit(ids, length, PAD))
        out = out.withColumn(f"{side}_labels", mask_to_labels(F.col(f"{side}_input_ids"), _fit(mask, length, 0)))
    return out


def raw_pairs(pairs: DataFrame, length: int) -> DataFrame:
    """The same from ``prompt_ids`` (template with generation prompt) and ``{side}_ids`` (completion with end marker)."""
    out = pairs
    for side in SIDES:
        whole = F.concat("prompt_ids", f"{side}_ids")
        labels = F.concat(F.transform("prompt_ids", lambda _: F.lit(IGNORED)), F.col(f"{side}_ids"))
        out = out.withColumn(f"{side}_input_ids", _fit(whole, length, PAD)).withColumn(f"{side}_labels", _fit(labels, length, IGNORED))
    return out


def collate_pairs(rows: DataFrame, batch: str = "batch_id", max_length: int = 4096) -> DataFrame:
    """Chosen and rejected sides padded independently."""
    out = rows
    for side in SIDES:
        named = out.withColumnRenamed(f"{side}_input_ids", "input_ids").withColumnRenamed(f"{side}_labels", "labels")
        out = collate(named, batch, max_length)
        for name in ("input_ids", "labels", "attention_mask"):
            out = out.withColumnRenamed(name, f"{side}_{name}")
    return out


def sequence_log_prob(token_log_probs: Column, labels: Column) -> Column:
    """Mean log-probability of the tokens whose label counts; both arrays are aligned after the shift by one."""
    kept = F.zip_with(token_log_probs, labels, lambda p, y: F.when(y != IGNORED, p))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    n = F.aggregate(labels, F.lit(0), lambda a, y: a + F.when(y != IGNORED, 1).otherwise(0))
    return total / F.greatest(n, F.lit(1))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """log softmax of one entry of an array of logits, stable for large values."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.element_at(logits, index.cast("int") + 1) - top - F.log(total)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def pair_loss(kind: str, delta: Column, beta: float, smoothing: float = 0.1) -> Column:
    """Loss of one pair; ``delta`` is the policy's log-ratio minus the reference's."""
    if kind == "dpo":
        return softplus(-beta * delta)
    if kind == "ipo":
        return F.pow(delta - 1.0 / (2.0 * beta), 2)
    if kind == "cdpo":
        return (1 - smoothing) * softplus(-beta * delta) + smoothing * softplus(beta * delta)
    raise ValueError(f"unknown loss {kind!r}")


def preference_metrics(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Losses, rewards, accuracy and margin over rows with pc, pr (policy) and rc, rr (reference) log-probabilities."""
    pc, pr, rc, rr = map(F.col, ("pc", "pr", "rc", "rr"))
    delta = (pc - pr) - (rc - rr)
    chosen, rejected = beta * (pc - rc), beta * (pr - rr)
    return rows.agg(
        *[F.avg(pair_loss(k, delta, beta)).alias(f"loss_{k}") for k in ("dpo", "ipo", "cdpo")],
        F.avg(chosen).alias("chosen_reward"), F.avg(rejected).alias("rejected_reward"),
        F.avg((chosen > rejected).cast("double")).alias("accuracy"), F.avg(chosen - rejected).alias("margin"),
    )


def rolling(rows: DataFrame, order: str, window: int = 50, every: int = 10, streams: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and margin over the last ``window`` steps, reported every ``every`` steps; ``order`` counts from 1."""
    w = W.partitionBy(*streams).orderBy(order).rowsBetween(-(window - 1), 0)
    better = (F.col("chosen") > F.col("rejected")).cast("double")
    out = rows.withColumn("accuracy", F.avg(better).over(w)).withColumn("margin", (F.sum("chosen").over(w) - F.sum("rejected").over(w)) / F.count(F.lit(1)).over(w))
    return out.filter(F.col(order) % every == 0).select(*streams, order, "accuracy", "margin")
