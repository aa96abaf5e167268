"""A bounded filter of keys that were seen before: it may say yes to a new key, and never no to an old one.

A key sets a few bits of one 64-bit word. The table holds a row for each word that is not empty, at most as many as ``words``,
so it can be broadcast whatever the number of keys; with very many keys it says yes to more of them. Filters of equal
``words`` merge by the union of their bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 64 million bits: one in a hundred new keys passes at seven million old ones
BITS = 4


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    other = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(other, 6 * i), F.lit(64)).cast("int")))
    return out


def build(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """(word, bits) of the keys; null keys are left out."""
    set_ = keys.filter(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("bits"))
    return merge(set_)


def merge(filters: DataFrame) -> DataFrame:
    return filters.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_seen(rows: DataFrame, key: str, seen: DataFrame, name: str = "maybe", words: int = WORDS) -> DataFrame:
    """``rows`` with whether the filter ``seen`` holds all bits of the key."""
    known = F.broadcast(seen.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))  # at most ``words`` rows
    asked = rows.withColumn("_at", _word(F.col(key), words)).withColumn("_mask", _mask(F.col(key)))
    met = asked.join(known, F.col("_at") == F.col("_word"), "left")
    return met.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_word", "_bits", "_at", "_mask")
