"""Quality rules: plain text rules first, then a hashed n-gram likelihood ratio.

Byte trigrams are hashed into a fixed number of buckets. The raw-corpus multinomial counts the trigrams of all documents,
the trusted-target multinomial those of labelled good documents. A document's score is the mean over its trigrams of
log p(target) - log p(raw); the mean takes the length out. Every document is held against the same threshold, so the
verdict is a function of the text and the two count vectors.

The target is fitted on at most ``TARGET_ROWS`` labelled rows, those whose ids hash lowest. The raw counts have no bound
and cover every byte of the corpus; they come back as one row a bucket.

Edge cases: null and empty texts have no words and fail the base rules; a text of under three bytes scores 0; without
labels every score is 0 and only the base rules decide; a score equal to the threshold passes; very long texts are read
whole; repeated rows are judged alike; further columns are left alone but for one named ``quality_rules``, which
:func:`quality_stats` replaces (:func:`keep_good` adds none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS_LOG2 = 15
TARGET_ROWS = 50_000
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram."""
    a = raw.astype(np.uint32)
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BUCKETS_LOG2)


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text. Words end at ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    size = 1 << BUCKETS_LOG2
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        for text, trusted in zip(batch["text"], batch["trusted"], strict=True):
            if text is not None and len(data := text.encode("utf-8", "surrogatepass")) > 2:
                got = np.bincount(trigrams(np.frombuffer(data, np.uint8)), minlength=size)
                raw += got
                if trusted:
                    target += got
    yield pd.DataFrame({"bucket": np.arange(size), "raw": raw, "target": target})[raw > 0]


def fit_weights(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, with add-one smoothing."""
    good = labels.filter(F.col("quality") == 1).select("doc_id").dropna().distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")  # at most target_rows ids
    marked = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = marked.mapInPandas(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(1 << BUCKETS_LOG2), np.zeros(1 << BUCKETS_LOG2)
    for bucket, r, t in sums.collect():  # one row a bucket
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(len(raw))
    n = len(raw)
    return np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))


def judge(texts, weights: np.ndarray, threshold: float = THRESHOLD) -> pd.DataFrame:
    """One row of statistics and verdict for each text."""
    out = []
    for text in texts:
        text = "" if text is None else text
        stats = word_rules(text)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        llr = float(weights[trigrams(data)].mean()) if len(data) > 2 else 0.0
        failed = base_failed(stats[0], stats[4])
        out.append((*stats, failed, llr, not failed and llr >= threshold))
    return pd.DataFrame(out, columns=[x.split()[0] for x in STATS.split(", ")])


def quality_column(weights: np.ndarray, threshold: float = THRESHOLD):
    """A function from the text column to a struct of ``STATS``."""

    @F.pandas_udf(f"struct<{STATS.replace(' ', ':').replace(',:', ',')}>")
    def rule(text: pd.Series) -> pd.DataFrame:
        return judge(text, weights, threshold)

    return rule.asNondeterministic()  # else a filter on it is pushed down and runs it twice


def quality_stats(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``quality_rules``."""
    weights = fit_weights(docs, labels)
    return docs.withColumn("quality_rules", quality_column(weights, threshold)(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had."""
    return docs.filter(quality_column(fit_weights(docs, labels), threshold)(F.col("text"))["kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the rules over all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    q = quality_stats(docs.select("doc_id", "text"), labels).select("doc_id", "quality_rules.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
