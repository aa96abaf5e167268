"""Corpus rules that the blueprint specifies without code behind them: perplexity bands, languages, personal data, lengths,
upsampling, composition and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import key_digest
from ..functions.ordering import row_index
from ..functions.tables import written
from ..functions.text import ascii_borders

#: Bands and patterns.
DROP_TOP, DROP_BOTTOM = 0.20, 0.05
LONG_TOKENS = 4096
FREQUENT = 10_000  # words that are broadcast with their frequencies
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


def words(text: Column) -> Column:
    """Words between spaces and line ends."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w != "")


def unigram_perplexity(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, perplexity) under the unigram model of the corpus itself, one row for each row with words.

    Words are counted once, by text, and the model is the sum of these counts. Words of most texts would be keys with a row a
    text: the ``FREQUENT`` most frequent meet the model by broadcast instead.
    """
    rows = docs.filter(F.col("text") != "").select(F.monotonically_increasing_id().alias("_row"), key, "text")  # numbered before they are taken apart
    texts = rows.select("_row", key, F.explode(words(F.col("text"))).alias("word"))
    own = written(texts.groupBy("_row", key, "word").agg(F.count(F.lit(1)).alias("n")), "words")
    model = written(own.groupBy("word").agg(F.sum("n").alias("freq")), "word-counts")
    total = model.agg(F.sum("freq").alias("total"))
    frequent = written(model.orderBy(F.desc("freq"), "word").limit(FREQUENT), "frequent")
    scored = own.join(F.broadcast(frequent), "word").unionByName(
        own.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(model, "word")
    ).join(F.broadcast(total), F.lit(True))  # one row
    bits = F.sum(F.col("n") * -F.log(F.col("freq") / F.col("total")))
    return scored.groupBy("_row", key).agg(F.sum("n").alias("n_words"), bits.alias("nll")).select(key, "n_words", F.exp(F.col("nll") / F.col("n_words")).alias("perplexity"))


def perplexity_band(scored: DataFrame, key: str = "doc_id", top: float = DROP_TOP, bottom: float = DROP_BOTTOM) -> DataFrame:
    """Rows between the bottom and the top share by perplexity. Ranks are exact; ties go by key."""
    n = scored.count()
    ranked = row_index(scored.withColumn("_p", F.round("perplexity", 6)), "_p", "_rank", ties=(key,))
    return ranked.filter((F.col("_rank") >= int(n * bottom)) & (F.col("_rank") < n - int(n * top))).drop("_rank", "_p")


def top_languages(docs: DataFrame, others: int = 9, always: str = "en", lang: str = "lang") -> DataFrame:
    """Rows in ``always`` and in the most frequent other languages; one row a language is ranked."""
    counts = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(lang) != always)
    kept = counts.orderBy(F.desc("_n"), lang).limit(others).select(lang)
    return docs.filter(F.col(lang) == always).unionByName(docs.join(F.broadcast(kept), lang, "left_semi"))  # at most ``others`` rows


def redact_personal(text: Column) -> Column:
    """Addresses of mail and network and telephone numbers become marks."""
    out = F.regexp_replace(text, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, ascii_borders(IP), "[IP]")
    return F.regexp_replace(out, PHONE, "[PHONE]")


def long_documents(docs: DataFrame, tokens: Column, most: int = LONG_TOKENS) -> DataFrame:
    return docs.filter(tokens > most)


def upsample(docs: DataFrame, group: str, times: dict[str, int], key: str = "doc_id", seed: int = 5) -> DataFrame:
    """``docs`` with ``copy`` and ``place``: rows of the named groups repeated, each copy ordered by its own hash."""
    n = F
    for name, k in times.items():
        n = n.when(F.col(group) == name, k)
    n = n.otherwise(1)
    out = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    return out.withColumn("place", key_digest(seed, F.concat(F.col("copy").cast("string"), F.lit("|"), F.col(key).cast("string"))))


def composition(docs: DataFrame, group: str, tokens: Column) -> DataFrame:
    """Tokens and share by group."""
    per = docs.groupBy(group).agg(F.sum(tokens).cast("long").alias("tokens"))
    return per.withColumn("share", F.col("tokens") / F.sum("tokens").over(W.partitionBy()))  # one row a group


def shingle_jaccard(docs: DataFrame, key: str = "doc_id", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b, jaccard): all pairs of different shingle sets at ``threshold`` or above, and each key whose set repeats with the least one.

    Sets are equal, or differ and are joined exactly, without MinHash: two sets of n and m shingles need
    ``threshold`` (n + m) / (1 + ``threshold``) in common. With shingles in one order, rarest first, both sets have at
    least as many left at their first common one, so only the first n - ceil(``threshold`` n) + 1 of a set are joined.

    Rows without an id have no name to be paired by and take no part. All pairs are listed, so the result grows with the
    square of a family; ``neardup`` gives classes and counts instead.
    """
    w = words(F.col("text"))
    prepared = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), w.alias("w")).filter(F.size("w") > 0)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - k + 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
    sets = prepared.select("key", F.array_sort(F.array_distinct(shingles)).alias("s"))
    # Sets are made once; of equal ones, told by a digest, only the least key's goes on.
    sets = written(sets.withColumn("bits", F.md5(F.array_join(F.col("s").cast("array<string>"), ","))), "shingle-sets")
    least = written(sets.groupBy("bits").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows")), "least")
    equal = sets.select("bits", "key").join(least.filter("rows > 1"), "bits").filter(F.col("key") != F.col("least"))
    equal = equal.select(F.col("least").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("jaccard"))
    distinct = sets.join(least.select("bits", F.col("least").alias("key")), ["bits", "key"]).select("key", "s").dropDuplicates(["key"])
    distinct = written(distinct, "distinct-sets")

    # A shingle of one set brings nobody together: it counts in a set's order, where it comes first, by number only.
    terms = distinct.select("key", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = written(terms.groupBy("h").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    shared = terms.join(often, "h").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("r"))
    alone = F.col("n") - F.size("r")
    first = (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1 - alone).cast("int")
    ranked = shared.filter(first > 0).select("key", "n", alone.alias("alone"), F.transform(F.slice("r", F.lit(1), F.greatest(first, F.lit(0))), lambda x: x["h"]).alias("first"))
    # Sets meet at the first shingle that both prefixes hold, and nowhere else: ``before`` is what stands earlier.
    posted = ranked.select("key", "n", "alone", "first", F.posexplode("first").alias("at", "h"))
    posted = posted.select("key", "n", "h", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.slice("first", F.lit(1), F.col("at")).alias("before"))
    posted = written(posted, "posted")
    a, b = posted.alias("a"), posted.alias("b")
    need = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    met = (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.rest") >= need) & (F.col("b.rest") >= need)
    pairs = a.join(b, met & ~F.arrays_overlap("a.before", "b.before")).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
    pairs = written(pairs, "pairs")
    sa, sb = distinct.select(F.col("key").alias("key_a"), F.col("s").alias("sa")), distinct.select(F.col("key").alias("key_b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(sa, "key_a").join(sb, "key_b").select("key_a", "key_b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return near.filter(F.col("jaccard") >= threshold).unionByName(equal.distinct())
