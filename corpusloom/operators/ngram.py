"""Word n-gram models with interpolated absolute discounting, and perplexity of texts under them.

A word's probability after a context takes ``DISCOUNT`` from each count that was seen there and gives what that leaves to the
model of the next shorter context; a context that was never seen hands over everything. The shortest model adds one to
every count and keeps one share for all words that it does not know. A text begins with a context of its own.

At scale: a probability is ``a + b * p`` with the p of the next shorter n-gram, so the n-grams to be scored go through the orders from
the longest down and take a and b along. In each order they meet the counts by bucket of their context, which holds all that
the order needs; counts of one order at a time are on disk. Tasks take pieces of ``PIECE`` bytes apart, count them, and hand on
a compressed blob a bucket, in which the ``FREQUENT`` most frequent words, known to every task, are numbers, and the others places in
a list of 64 bits of their hash. A task that reads a bucket folds its blobs as they come, so it holds distinct n-grams and about
``FOLD`` others. Words that are not frequent meet their counts by a join that Spark splits where it is skewed.
Before that all words are told apart by 128 bits: where two share the first 64, everything is hashed under another seed.

Texts are read once an order and once for the words. Each step ends in a stored table, and its shuffle files go before the next
step writes its own.

Edge cases: texts that are null, empty or white space have no words and give no row; rows that share an id are one text for
each row and are told apart by a row number; a null id stays null; a model of no texts gives every word the same share;
further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, stored

ORDER = 3
DISCOUNT = 0.75
FREQUENT = 1 << 18
PIECE = 6 << 20  # bytes of text that a task takes apart at once
FOLD = 1 << 19  # n-grams that a task reads before it folds them
BUCKET = 1_000_000  # words a bucket, where there are more than ``BUCKETS`` of them
BUCKETS = 24
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

BLOBS = "bucket int, held boolean, blob binary"
LAST = "row long, n long, nll double, h1 long, a double, b double"  # a sum of frequent words, or a word to be joined


@dataclass(frozen=True)
class Model:
    """``words`` has the counts c of words by hash (h1, and h2 to tell them apart); longer n-grams of ``texts`` (text) are counted when they are asked for."""

    order: int
    texts: DataFrame
    words: DataFrame
    total: int
    types: int
    seed: int = 0


# --- texts ---------------------------------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """Columns of batches whose last one is a text, in pieces of about ``size`` bytes or one row."""
    held, full = [], 0
    for batch in batches:
        ends, done = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while done < len(ends):
            before = int(ends[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, before + size - full, "right")))
            held.append(batch.slice(done, stop - done).columns)
            full, done = full + int(ends[stop - 1]) - before, stop
            if full >= size or done < len(ends):
                yield [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                held, full = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held, strict=True)]


@dataclass(frozen=True)
class Frequent:
    """Hashes of the most frequent words by rank, their order, and the probabilities by rank."""

    hashes: np.ndarray
    order: np.ndarray
    p: np.ndarray

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, -1 for other words."""
        if not len(self.p):
            return np.full(len(hashes), -1, np.int32)
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=self.order), len(self.p) - 1)]
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int32)

    def sums(self, hashes: np.ndarray, row: np.ndarray, ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Rows of ``LAST``."""
        known, rest = ids < len(self.p), ids >= len(self.p)
        rows, of = np.unique(row[known], return_inverse=True)
        words = np.bincount(of, n[known], len(rows)).astype(np.int64)
        nll = np.bincount(of, n[known] * -np.log(a[known] + b[known] * self.p[ids[known]]), len(rows)) if len(rows) else np.zeros(0)
        long, double, few, many = pa.int64(), pa.float64(), len(rows), int(rest.sum())
        own = hashes[ids[rest] - len(self.p)].view(np.int64)
        summed = [pa.array(rows, long), pa.array(words, long), pa.array(nll, double), pa.nulls(few, long), pa.nulls(few, double), pa.nulls(few, double)]
        single = [pa.array(row[rest], long), pa.array(n[rest], long), pa.nulls(many, double), pa.array(own, long), pa.array(a[rest]), pa.array(b[rest])]
        arrays = [pa.concat_arrays(x) for x in zip(summed, single, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in LAST.split(", ")])


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))


@dataclass(frozen=True)
class Words:
    """Place of the text and number of each word: its rank, or a place in ``hashes``, which are sorted, after all ranks.

    The start of a text is the first of ``hashes``; ``more`` has 64 bits more of each.
    """

    at: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray
    more: np.ndarray


def taken_apart(texts: pa.Array, seed: int, frequent: Frequent = NONE) -> Words:
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    spelled = coded.dictionary.cast(pa.binary() if coded.dictionary.type == pa.string() else pa.large_binary()).to_numpy(zero_copy_only=False)
    salt = seed.to_bytes(8, "little")
    hashes = np.frombuffer(bytes(16) + b"".join(blake2b(w, digest_size=16, salt=salt).digest() for w in spelled), "<u8").reshape(-1, 2).copy()
    hashes[1:, 0] |= np.uint64(1)  # no word has the hash of a start
    number = frequent.ranks(hashes[:, 0])
    own = np.flatnonzero(number < 0)
    own = own[np.argsort(hashes[own, 0])]
    number[own] = np.arange(len(frequent.p), len(frequent.p) + len(own), dtype=np.int32)
    ids = coded.indices.to_numpy()  # the hash of each is one place further on
    words = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids]
    return Words(pc.list_parent_indices(lists).to_numpy()[words], number[ids[words] + 1], hashes[own, 0], hashes[own, 1])


def grams(words: Words, order: int, start: int) -> list[np.ndarray]:
    """The n-gram that ends in each word, a column a word."""
    at, ids = words.at, words.ids
    columns = [ids]
    for j in range(1, order):
        before = np.full(len(ids), start, np.int32)
        same = at[j:] == at[:-j]
        before[j:][same] = ids[:-j][same]
        columns.insert(0, before)
    return columns


# --- n-grams as arrays ---------------------------------------------------------------------------------------------


def keys(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each combination of numbers below ``size``."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        if len(key) and int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key *= size
        key += c
    return key


def distinct(columns: list[np.ndarray], size: int, n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different n-grams in order and the sum of ``n``, or of ones, for each."""
    key = keys(columns, size)
    order = None if n is None and size ** len(columns) < 1 << 62 else np.argsort(key)
    if order is None:
        key.sort()
    else:
        key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    if order is not None:
        sums = np.diff(first, append=len(key)) if n is None else np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else n[:0]
        return [c[order[first]] for c in columns], sums
    different, found = key[first], []
    for _ in columns[1:]:
        different, last = np.divmod(different, size)
        found.insert(0, last.astype(np.int32))
    return [different.astype(np.int32), *found], np.diff(first, append=len(key))


def merged(hashes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different hashes of several lists, and the new numbers of each list."""
    different, number = np.unique(np.concatenate(hashes), return_inverse=True)
    return different, np.split(number, np.cumsum([len(h) for h in hashes])[:-1])


def packed(hashes: np.ndarray, arrays: list[np.ndarray]) -> bytes:
    """Steps of sorted hashes, and arrays in the fewest bytes a number, byte by byte, in zstd."""
    out = []
    for a in (np.diff(hashes, prepend=np.zeros(1, np.uint64)), *arrays):
        if a.dtype.kind == "i" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        out.append((a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()))
    data = pickle.dumps(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    """Hashes and arrays."""
    plain = []
    for kind, data in pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)):
        plain.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1))
    small = lambda a: a.itemsize < 4 or a.itemsize == 4 and (not len(a) or int(a.max()) < 1 << 31)
    return [np.cumsum(plain[0], dtype=np.uint64), *[a.astype(np.int32 if small(a) else np.int64) if a.dtype.kind == "u" else a for a in plain[1:]]]


def dealt(frequent: Frequent, hashes: np.ndarray, columns: list[np.ndarray], others: list[np.ndarray], buckets: int, held: bool) -> pa.RecordBatch:
    """A blob a bucket of the context: hashes, columns, ``others``."""
    every, ranks = np.concatenate([frequent.hashes, hashes]), len(frequent.p)
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns[:-1]:
        x = (x ^ every[c]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    bucket = (x % np.uint64(buckets)).astype(np.min_scalar_type(buckets))  # small numbers are sorted fast
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    blobs, number = [], np.arange(len(every), dtype=np.int32)
    for part in np.split(order, starts[1:]) if len(found) else []:
        own = [c[part] for c in columns]
        words = np.unique(np.concatenate([c[c >= ranks] for c in own]))
        number[words] = np.arange(ranks, ranks + len(words), dtype=np.int32)
        blobs.append(packed(every[words], [*[number[c] for c in own], *[o[part] for o in others]]))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([held] * len(found), pa.bool_()), pa.array(blobs, pa.binary())], ["bucket", "held", "blob"])


# --- steps ---------------------------------------------------------------------------------------------------------


def counted(texts: DataFrame, order: int, buckets: int, frequent: Frequent, seed: int = 0) -> DataFrame:
    """``BLOBS`` of the counts of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (body,) in pieces(batches, PIECE):
            words, ranks = taken_apart(body, seed, frequent), len(frequent.p)
            columns, n = distinct(grams(words, order, ranks), ranks + len(words.hashes))
            yield dealt(frequent, words.hashes, columns, [n], buckets, False)

    return texts.mapInArrow(run, BLOBS)


def asked(rows: DataFrame, order: int, buckets: int, frequent: Frequent, seed: int = 0) -> DataFrame:
    """The n-grams of ``rows`` (_row, _text): ``BLOBS``, or ``LAST`` where order is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, body in pieces(batches, PIECE):
            words, ranks = taken_apart(body, seed, frequent), len(frequent.p)
            (at, *columns), n = distinct([words.at, *grams(words, order, ranks)], max(ranks + len(words.hashes), len(body)))
            row, a, b = row.to_numpy()[at], np.zeros(len(n)), np.ones(len(n))
            yield frequent.sums(words.hashes, row, columns[0], n, a, b) if order == 1 else dealt(frequent, words.hashes, columns, [row, n, a, b], buckets, True)

    return rows.mapInArrow(run, LAST if order == 1 else BLOBS)


def met(blobs: DataFrame, order: int, discount: float, buckets: int, frequent: Frequent) -> DataFrame:
    """What is asked after an order has given its part: ``BLOBS`` of the next shorter one, or ``LAST``."""

    ranks = len(frequent.p)

    def renumbered(column: np.ndarray, number: np.ndarray) -> np.ndarray:
        rare = column >= ranks
        column = column.astype(np.int32)
        column[rare] = ranks + number[column[rare] - ranks]
        return column

    def joined(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """Blobs with places in one list of hashes."""
        hashes, numbers = merged([p[0] for p in parts])
        return hashes, [[*[renumbered(c, n) for c in p[1 : order + 1]], *p[order + 1 :]] for n, p in zip(numbers, parts, strict=True)]

    def folded(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        hashes, parts = joined(parts)
        *columns, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns, n = distinct(columns, ranks + len(hashes), n)
        return [hashes, *columns, n]

    def scored(counts: list[np.ndarray], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        hashes, (known, *parts) = joined([counts, *parts])
        *columns, row, n, a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        own, m = known[-1], len(known[-1])
        every = [np.concatenate(c) for c in zip(known[:-1], columns, strict=True)]
        contexts, context = np.unique(keys(every[:-1], ranks + len(hashes)), return_inverse=True)
        different, gram = np.unique(context * (ranks + len(hashes)) + every[-1], return_inverse=True)
        c = np.bincount(gram[:m], own, len(different))[gram[m:]]
        total = np.bincount(context[:m], own, len(contexts))[context[m:]]
        types = np.bincount(context[:m], minlength=len(contexts))[context[m:]]
        seen, whole = total > 0, np.maximum(total, 1)
        a = a + b * np.where(seen, np.maximum(c - discount, 0) / whole, 0.0)
        b = b * np.where(seen, discount * types / whole, 1.0)
        if order == 2:
            return frequent.sums(hashes, row, columns[1], n, a, b)
        return dealt(frequent, hashes, columns[1:], [row, n, a, b], buckets, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (order + 1)]
        at, counts, new, asking = None, none, [], []
        size = lambda parts: sum(len(p[1]) for p in parts)
        for batch in batches:
            for bucket, held, blob in zip(*batch.columns, strict=True):
                if bucket.as_py() != at:
                    if asking:
                        yield scored(counts, asking)
                    at, counts, new, asking = bucket.as_py(), none, [], []
                if not held.as_py():
                    new.append(unpacked(blob.as_py()))
                    if size(new) >= max(FOLD, len(counts[-1])):
                        counts, new = folded([counts, *new]), []
                    continue
                if new:
                    counts, new = folded([counts, *new]), []
                asking.append(unpacked(blob.as_py()))
                if size(asking) >= max(FOLD, len(counts[-1]) // 4):
                    yield scored(counts, asking)
                    asking = []
        if asking:
            yield scored(counts, asking)

    return blobs.repartition("bucket").sortWithinPartitions("bucket", "held").mapInArrow(run, LAST if order == 2 else BLOBS)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(h1, h2, c) of the words of ``texts``, a row for each word of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (body,) in pieces(batches, PIECE):
            words = taken_apart(body, seed)
            n = np.bincount(words.ids, minlength=len(words.hashes))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (words.hashes, words.more, n)], ["h1", "h2", "c"])

    return texts.mapInArrow(run, "h1 long, h2 long, c long")


def told_apart(words: DataFrame) -> tuple[bool, int]:
    """Whether no two words of (h1, h2, c) share h1, and the sum of c."""
    hashes = words.groupBy("h1").agg((F.min("h2") != F.max("h2")).alias("several"), F.sum("c").alias("c"))
    got = hashes.agg(F.max("several").alias("several"), F.sum("c").alias("c")).first()
    return not got["several"], got["c"] or 0


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets ``BATCH_BYTES`` at once, or a row: larger batches leave their mark in the memory of executors."""
    plain = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if plain is None else spark.conf.set(BATCH, plain)


def fit(docs: DataFrame, order: int = ORDER, text: str = "text") -> Model:
    """The model of all of ``docs``."""
    with small_batches(docs.sparkSession):
        return _fitted(docs.select(F.coalesce(text, F.lit("")).alias("_text")), order, 0)


def _fitted(texts: DataFrame, order: int, seed: int) -> Model:
    counts = stored(word_counts(texts, seed).groupBy("h1", "h2").agg(F.sum("c").alias("c")), "words")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("types")).first()
    return Model(order, texts, counts, whole["total"], whole["types"], seed)


def perplexity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """(``key``, n_words, perplexity) of every row with words."""
    with small_batches(docs.sparkSession):
        # Rows are numbered and stored before they are taken apart, so that they have the same numbers when they meet their ids.
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
        while True:
            apart, n = told_apart(model.words.withColumn("c", F.lit(0)).unionByName(word_counts(rows.select("_text"), model.seed)))
            if apart:
                break
            model = _fitted(model.texts, model.order, model.seed + 1)
        rows = stored(rows, "asked")
        last = _last(rows.select("_row", "_text"), model, discount, model.total + n)
        rare = last.filter("h1 IS NOT NULL").join(model.words.select("h1", "c"), "h1", "left")
        p = F.col("a") + F.col("b") * _share(model, F.coalesce("c", F.lit(0)))
        parts = last.filter("h1 IS NULL").select("row", "n", "nll").unionByName(rare.select("row", "n", (F.col("n") * -F.log(p)).alias("nll")))
        sums = parts.groupBy("row").agg(F.sum("n").alias("n_words"), F.sum("nll").alias("nll"))
        whole = rows.select(F.col("_row").alias("row"), "_id").join(sums, "row")
        out = stored(whole.select(F.col("_id").alias(key), "n_words", F.exp(F.col("nll") / F.col("n_words")).alias("perplexity")), "perplexity")
    for gone in (rows, last):
        discard(gone)
    return out


def _share(model: Model, c: Column | np.ndarray) -> Column | np.ndarray:
    return (c + 1) / (model.total + model.types + 1)


def _last(texts: DataFrame, model: Model, discount: float, size: int) -> DataFrame:
    """What is asked by ``texts`` (_row, _text) as ``LAST``, through all orders of ``model``."""
    buckets = max(-(-size // BUCKET), min(BUCKETS, -(-size // (BUCKET // 8))), 1)
    top = model.words.select("h1", "c").orderBy(F.desc("c"), "h1").limit(FREQUENT).toArrow()
    hashes = top["h1"].to_numpy().view(np.uint64)
    frequent = Frequent(hashes, np.argsort(hashes), _share(model, top["c"].to_numpy()))
    asking = asked(texts, model.order, buckets, frequent, model.seed)
    if model.order == 1:
        return stored(asking, "after-1")
    for k in range(model.order, 1, -1):
        rest = stored(met(counted(model.texts, k, buckets, frequent, model.seed).unionByName(asking), k, discount, buckets, frequent), f"after-{k}")
        if k < model.order:
            discard(asking)
        asking = rest
    return asking
