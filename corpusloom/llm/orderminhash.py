"""Near duplicates by order MinHash.

A text is the sequence of its five-word shingles, each labelled with how often it came before. A sketch takes the two
labelled shingles of least hash and keeps them in text order; several sketches are drawn. Two texts that agree in a
sketch share shingles in the same order, so agreement follows edit similarity and not only the overlap of sets.

Candidates are verified by banded alignment of their words: with an edit distance of E words (insertions, deletions and
substitutions), texts of n and m words are near duplicates if 1 - E / max(n, m) is at least 0.8. The band is as wide as
that bound allows, so it cuts off no alignment that could reach it. Groups are the connected components of these links.

Every pair of texts that agree in a sketch ends up compared or in one group, however many texts share the bucket:

1. Equal texts collapse first; buckets of one text go.
2. Each text is compared with one pivot, that of most of its buckets; a bucket's pivot is its text with the most company.
   That brings families of copies together and decides nothing.
3. Buckets are contracted to the groups found. In those that still hold several, all pairs across groups are compared:
   pair by pair in buckets of at most ``SMALL`` texts, and in larger ones by an exact join on rare words (``_posts``,
   ``_meetings``), which skips only pairs whose words cannot overlap enough.

At scale: the sketches are computed once, on arrays of many texts; only texts that share a bucket are loaded again; of
each table only narrow columns are shuffled. Buckets are never gathered in one task. Batches of texts
and of pairs that go to Python are bounded in bytes. Components alternate large and small
stars and stop when all are stars. Every step ends in a table in the shared folder, which goes when it has been used.

Edge cases: null counts as the empty text; texts without words form one class each, by equality; white space does not
count in comparisons; a text of one to four words has one shingle, of all its words; very long texts are sketched alone
and aligned in a band that is widened only as far as needed; a class without any id has a null class id; repeated rows
share a class; of texts that tie for a class's least id, the least content hash is kept; further columns are left alone,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, collect_garbage, forget, materialize, scratch

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 48
TAKEN = 2  # shingles a sketch takes
SMALL = 32
CHUNK = 1 << 15  # words that are sketched together
CELLS_LOG2 = 16  # words are counted by cells of their hash when pairs across groups are sought; for speed only
COMMON = 1 << 12  # words of a cluster's chosen text that come last then; for speed only
DEALT = 2000  # texts that a task posts, about
BEFORE = 256  # earlier words of a text that are looked at when it meets another; with more, a pair may be named twice
BITMAP_LOG2 = 27  # 16 MB
_MAX = np.uint64(2**64 - 1)
_SEEDS = np.array([xxh64_intdigest(b"sketch %d" % i) for i in range(SKETCHES)], np.uint64)
_FACTORS = np.array([xxh64_intdigest(b"factor %d" % i) | 1 for i in range(SKETCHES)], np.uint64)


# --- sketches --------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _labels(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes told apart by how often each came before in its text."""
    own = hashes ^ _mix(owner.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.empty(len(own), np.uint64)
    nth[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return _mix(hashes + nth * np.uint64(0x9E3779B97F4A7C15))


def _sketch(texts: list[list[bytes]]) -> np.ndarray:
    """A row of sketches for each text; all have words."""
    padded = [w + [b""] * (WORDS - len(w)) for w in texts]
    sizes = np.array([len(w) for w in padded])
    h = np.fromiter((xxh64_intdigest(x) for w in padded for x in w), np.uint64, sizes.sum())
    plain = np.zeros(len(h) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        plain = _mix(plain ^ h[i : len(h) - WORDS + 1 + i])
    inside = np.ones(len(plain), bool)  # shingles that do not run into the next text
    for i in range(1, WORDS):
        inside[np.cumsum(sizes)[:-1] - i] = False
    plain, counts = plain[inside], sizes - WORDS + 1
    starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(texts)), counts)
    labelled = _labels(plain, owner)
    out = np.empty((len(texts), SKETCHES), np.uint64)
    for s, (seed, factor) in enumerate(zip(_SEEDS, _FACTORS, strict=True)):
        rank, taken = (labelled ^ seed) * factor, []
        for _ in range(TAKEN):  # a text of fewer shingles takes its last one again
            at = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, starts), counts))
            if len(at) > len(texts):
                at = at[np.unique(owner[at], return_index=True)[1]]
            taken.append(at)
            rank[at] = _MAX
        value = np.full(len(texts), seed)
        for at in np.sort(taken, axis=0):  # in text order
            value = _mix(value ^ plain[at])
        out[:, s] = value
    return out


def sketches(texts) -> pd.DataFrame:
    """Number of words and sketches (signed 64-bit numbers; none without words) of each text."""
    n, out, rows, held = [], [np.zeros(0, np.int64)] * len(texts), [], []

    def finish() -> None:
        if rows:
            for i, row in zip(rows, _sketch(held).view(np.int64), strict=True):
                out[i] = row
        rows.clear()
        held.clear()

    many = 0
    for i, text in enumerate(texts):
        w = words_of(text)
        n.append(len(w))
        if w:
            if many + len(w) > CHUNK:
                finish()
                many = 0
            many += len(w)
            rows.append(i)
            held.append(w)
    finish()
    return pd.DataFrame({"n": np.array(n, np.int64), "sketch": out})


# --- alignment -------------------------------------------------------------------------------------------------------


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel: the band is one integer, whose bit k stands for the cell of b's row j and a's column j - below + k and
    says whether a cell is one more or one less than its neighbour. The distance is read along the diagonal that ends
    in the last cell.
    """
    if len(a) < len(b):
        a, b = b, a
    distance = len(a) - len(b)
    if distance > most:
        return None
    below = (most - distance) // 2
    diagonal = below + distance
    band = (1 << (diagonal + below + 1)) - 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    more, less = band & ~((1 << below) - 1), 0  # cells of row 0 are one more than the cell before
    for j, x in enumerate(b):
        at = places.get(x, 0)
        same = (at >> (j - below) if j >= below else at << (below - j)) & band
        kept = ((((same & more) + more) ^ more) | same | less) & band  # as cheap as the cell before on the diagonal
        across_more = (less | ~(kept | more)) & band
        across_less = kept & more
        if not kept >> diagonal & 1:
            distance += 1
            if distance > most:
                return None
        kept >>= 1
        more = (across_less | ~(kept | across_more)) & band
        less = across_more & kept
    return distance


def similarity(a: list, b: list, bound: float = SIMILARITY) -> float:
    """1 - (edit distance) / (longer length) of two word sequences; exact where it is at least ``bound``, else 0."""
    longer = max(len(a), len(b))
    most = int((1 - bound) * longer + 1e-9)
    if not a or not b or abs(len(a) - len(b)) > most:
        return 0.0
    if (Counter(a) & Counter(b)).total() < longer - most:
        return 0.0
    band = max(64, most // 64)
    while True:
        distance = banded_distance(a, b, min(band, most))
        if distance is not None:
            return 1 - distance / longer
        if band >= most:
            return 0.0
        band *= 4


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, words = None, []
    for batch in batches:
        keep = []
        for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if b != key:
                key, words = b, words_of(text_b)
            keep.append(similarity(words_of(text_a), words) >= SIMILARITY)
        yield batch.loc[keep, ["a", "b"]]


# --- components ------------------------------------------------------------------------------------------------------


def content_key(text):
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _stars(links: DataFrame) -> DataFrame:
    """Each link once, from its greater end u to its lesser end v."""
    a, b = F.col("a"), F.col("b")
    return links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component. ``links`` has a and b."""
    u, v = F.col("u"), F.col("v")
    edges = materialize(_stars(links.select("a", "b")), "edges")
    while True:
        ends = edges.select(u.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(v.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty():  # all are stars
            return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
        both = edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(v > u).join(least, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(v != F.col("m")).select(v.alias("a"), F.col("m").alias("b"))
        small = materialize(_stars(small.unionByName(least.select(u.alias("a"), F.col("m").alias("b")))), "small-star")
        forget(edges, large, collect=False)
        edges = small


# --- candidates ------------------------------------------------------------------------------------------------------


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``: a filter by a bitmap of hashed keys, before the exact join.

    The bitmap has 16 bits a key but never more than 2 ** ``BITMAP_LOG2`` bits, so what is broadcast is bounded; with far
    more keys it lets more rows pass and changes no result.
    """
    bits = 1 << min(BITMAP_LOG2, max(10, int(np.ceil(np.log2(16 * max(1, keys.count()))))))
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(F.floor(bit / 64).alias("word_"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask"))
    words = words.groupBy("word_").agg(F.bit_or("mask").alias("mask_"))
    found = df.withColumn("bit_", bit).withColumn("word_", F.floor(F.col("bit_") / 64)).join(F.broadcast(words), "word_")
    return found.filter(F.col("mask_").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit_") % 64).cast("int"))) != 0).select(*df.columns)


def _near_in_size(n, m):
    return F.least(n, m) >= F.greatest(n, m) * SIMILARITY - 1e-9


def _shared(texts: DataFrame) -> DataFrame:
    """(value, key, n, degree): the sketches of the texts that other texts have too; ``degree`` sums a text's bucket sizes."""
    posted = texts.select(F.explode("sketch").alias("value"), "key", "n")
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    shared = materialize(shared, "shared")
    found = materialize(maybe_in(posted, "value", shared.select("value")).join(shared, "value"), "found")
    out = found.select("value", "key", "n").join(found.groupBy("key").agg(F.sum("texts").alias("degree")), "key")
    out = materialize(out, "postings")
    forget(shared, found, collect=False)
    return out


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, text) of the needed (key, first_id), once each."""
    needed = materialize(needed, "needed")
    texts = docs.select(content_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = needed.withColumnRenamed("key", "needed_key")
    texts = maybe_in(texts, "key", needed)
    texts = texts.join(n, (texts["key"] == n["needed_key"]) & texts["id"].eqNullSafe(n["first_id"]))
    out = materialize(texts.dropDuplicates(["needed_key", "first_id"]).select("key", "text"), "candidate-texts")
    forget(needed, collect=False)
    return out


def _first_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): each text and the pivot of most of its buckets.

    A bucket's pivot is its text of greatest degree: of a family of copies that are edited apart, the one nearest to all.
    """
    pivots = postings.groupBy("value").agg(F.max(F.struct("degree", "key", "n")).alias("p"))
    met = postings.join(pivots, "value").filter((F.col("key") != F.col("p.key")) & _near_in_size(F.col("n"), F.col("p.n")))
    met = met.groupBy("key", F.col("p.key").alias("pivot")).agg(F.count(F.lit(1)).alias("times"), F.max("p.degree").alias("degree"))
    best = met.groupBy("key").agg(F.max(F.struct("times", "degree", "pivot")).alias("best"))
    return best.select(F.greatest("key", "best.pivot").alias("a"), F.least("key", "best.pivot").alias("b"))


def _rooted(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the root of each key's group; a text without links is its own group."""
    return df.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _open(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(value, key, n, degree, root, texts) of the buckets that hold several groups."""
    rooted = _rooted(postings, groups)
    several = rooted.groupBy("value").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count(F.lit(1)).alias("texts"))
    return rooted.join(several.filter(F.col("first") != F.col("last")).select("value", "texts"), "value")


def _small_pairs(opened: DataFrame) -> DataFrame:
    """(a, b): all pairs across groups in buckets of at most ``SMALL`` texts, where their sizes allow a link."""
    a, b = (opened.filter(F.col("texts") <= SMALL).alias(x) for x in "ab")
    met = (F.col("a.value") == F.col("b.value")) & (F.col("a.key") > F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _near_in_size(F.col("a.n"), F.col("b.n"))
    return a.join(b, met).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def _posts(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """(place, key, n, rest, own, before): where texts of a bucket whose words can overlap enough meet; nothing is drawn.

    Buckets of one passage hold much the same texts: those with the same text of greatest degree are one cluster, and a
    text is posted once a cluster.

    Words are labelled by occurrence. Texts of n and m words with an edit distance of at most E = (1 - ``SIMILARITY``)
    max(n, m) have max(n, m) - E labelled words in common. Sort these by one order a cluster: at the first common one,
    both texts have at least as many left, itself included. So only each text's first fifth is posted, and pairs meet
    where both have enough left. Any order gives the same links; this one makes few meet: words of the cluster's chosen
    text, and so what a cluster shares, come last, and before that the rarest come first. How rare a word is, is told by
    its cell, one of 2 ** ``CELLS_LOG2`` by its hash: every word is counted, and a task reports, once for all its texts, the
    count of the most frequent word of each cell, summed over batches. So there are at most so many counts a task, however
    many different words there are.
    """

    def labelled(text: str) -> np.ndarray:
        w = words_of(text)
        return _labels(np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w)), np.zeros(len(w), np.int64)).view(np.int64)

    def short(h: np.ndarray) -> np.ndarray:
        return (h >> 32).astype(np.int32)

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"top": batch["key"], "common": [np.unique(short(labelled(t)))[:COMMON] for t in batch["text"]]})

    def cell(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << CELLS_LOG2, np.int64)
        for batch in batches:
            h, c = np.unique(np.concatenate([np.zeros(0, np.int64), *map(labelled, batch["text"])]), return_counts=True)
            most = np.zeros_like(cells)
            np.maximum.at(most, cell(h), c)
            cells += most
        yield pd.DataFrame({"cell": np.flatnonzero(cells), "c": cells[cells > 0]})

    tops = opened.groupBy("value").agg(F.max(F.struct("degree", "key")).alias("t")).select("value", F.col("t.key").alias("top"))
    member = materialize(opened.join(tops, "value").select("key", "n", "top").distinct(), "members")
    common = texts.join(member.select(F.col("top").alias("key")).distinct(), "key").mapInPandas(shared, "top binary, common array<int>")
    per_text = member.join(common, "top").groupBy("key", "n")  # at most ``SKETCHES`` clusters
    per_text = per_text.agg(F.collect_list(F.struct(F.xxhash64("top").alias("cluster"), "common")).alias("clusters"))
    held = materialize(texts.join(per_text, "key"), "held")
    counts = held.select("text").mapInPandas(counted, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    often = np.zeros(1 << CELLS_LOG2, np.int64)
    often[counts["cell"].to_numpy(np.int64)] = counts["c"]

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, owners, rests, own = [], [], [], []
            for i, (n, clusters, text) in enumerate(zip(batch["n"], batch["clusters"], batch["text"], strict=True)):
                h = labelled(text)
                freq = often[cell(h)]
                for c in clusters:
                    last = np.isin(short(h), c["common"])
                    first = h[np.lexsort((h, freq, last))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]]
                    cluster = np.full(len(first), c["cluster"], np.int64)
                    places.append((cluster, _mix(first.view(np.uint64) ^ _mix(cluster.view(np.uint64))).view(np.int64)))
                    owners.append(np.full(len(first), i))
                    rests.append(n - np.arange(len(first)))
                    own.append(np.full(len(first), n - last.sum()))
            if owners:
                of = np.concatenate(owners)
                cluster, place = (np.concatenate(x) for x in zip(*places, strict=True))
                yield pd.DataFrame({"cluster": cluster, "place": place, "key": batch["key"].to_numpy()[of], "n": batch["n"].to_numpy()[of], "rest": np.concatenate(rests), "own": np.concatenate(own)})

    # Dealt by key: a text makes many rows, and the file splits of a small table would be few tasks.
    tasks = max(2 * held.sparkSession.sparkContext.defaultParallelism, held.count() // DEALT)
    posts = materialize(held.repartition(tasks, "key").mapInPandas(posted, "cluster long, place long, key binary, n long, rest long, own long"), "posts")
    places = materialize(posts.groupBy("place").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("place"), "places")
    earlier = W.partitionBy("cluster", "key").orderBy(F.desc("rest")).rowsBetween(-BEFORE, -1)
    met = maybe_in(posts, "place", places).withColumn("before", F.collect_list("place").over(earlier))  # a few more pass, and meet nobody
    met = materialize(met.drop("cluster"), "met")
    forget(member, held, posts, places)
    return met


def _meetings(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): the texts of different groups that meet, the greater first.

    Two texts meet where the first word stands that they have in common: not where they share a word before it. Of two
    groups at a place one is not its largest: a is of such a group, so a large family never meets itself.
    """
    here = W.partitionBy("place")
    met = _rooted(posts, groups).withColumn("size", F.count(F.lit(1)).over(W.partitionBy("place", "root")))
    met = met.withColumn("largest", F.max(F.struct("size", "root")).over(here)["root"]).withColumn("other", F.min("root").over(here) != F.max("root").over(here))
    met = materialize(met.filter("other").drop("size", "other"), "rooted")
    a, b = met.filter(F.col("root") != F.col("largest")).alias("a"), met.alias("b")
    once = (F.col("b.root") == F.col("b.largest")) | (F.col("a.key") > F.col("b.key"))
    need = SIMILARITY * F.greatest("a.n", "b.n") - 1e-9
    # What is left of both: of their own words, and of those that the cluster shares.
    left = F.least(F.col("a.rest") - F.col("a.n") + F.col("a.own"), F.col("b.rest") - F.col("b.n") + F.col("b.own"))
    left = F.greatest(left, F.lit(0)) + F.least(F.col("a.n") - F.col("a.own"), F.col("b.n") - F.col("b.own"))
    enough = (F.col("a.root") != F.col("b.root")) & once & (F.least("a.rest", "b.rest") >= need) & (left >= need)
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & enough & ~F.arrays_overlap("a.before", "b.before"))
    return met.select(F.greatest("a.key", "b.key").alias("a"), F.least("a.key", "b.key").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment passes; only the texts that they name are sent."""
    ends = materialize(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "ends")
    named = maybe_in(texts, "key", ends)
    left = named.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = named.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    links = pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(_verify, "a binary, b binary")
    links = materialize(links, "links")
    forget(ends, collect=False)
    return links


# --- classes ---------------------------------------------------------------------------------------------------------


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) of ``docs``, and per distinct text (key, first_id, class_key, class_id)."""

    @F.pandas_udf("struct<n:long,sketch:array<long>>")
    def sketched(text: pd.Series) -> pd.DataFrame:
        return sketches(text)

    bound_batches(docs.sparkSession)
    with scratch() as keep:
        rows = docs.select("doc_id", content_key(F.col("text")).alias("key"), sketched("text").alias("s")).select("doc_id", "key", "s.n", "s.sketch")
        rows = materialize(rows, "sketches")
        reps = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
        reps = materialize(reps, "texts")
        groups = _groups(docs, reps)
        named = reps.select("key", "first_id").join(groups.withColumnRenamed("node", "key"), "key", "left")
        named = materialize(named.select("key", "first_id", F.coalesce("root", "key").alias("class_key")), "named")
        ids = named.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
        classes = materialize(named.join(ids, "class_key"), "classes")
        keep(rows, classes)
    return rows.select("doc_id", "key"), classes


def _groups(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, root) of every distinct text that has a link."""
    postings = _shared(reps)
    texts = _texts(docs, postings.select("key").distinct().join(reps.select("key", "first_id"), "key"))
    tried = links = groups = None

    def link(pairs: DataFrame) -> None:
        """Compare the pairs that have not been compared, and bring the groups up to date."""
        nonlocal tried, links, groups
        pairs = materialize(pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        new = _verified(pairs, texts)
        collect_garbage(docs.sparkSession)  # the texts that were sent
        tried, links = (pairs, new) if tried is None else (tried.unionByName(pairs), links.unionByName(new))
        groups = components(links)

    link(_first_pairs(postings))
    opened = materialize(_open(postings, groups), "open")
    hot = opened.filter(F.col("texts") > SMALL)
    pairs = _small_pairs(opened)
    link(pairs if hot.isEmpty() else pairs.unionByName(_meetings(_posts(hot, texts), groups)))
    return groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least id of the row's class, for every row of ``docs`` (doc_id, text)."""
    rows, classes = near_classes(docs)
    return rows.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of least id, and of its repetitions any one."""
    with scratch() as keep:
        rows, classes = near_classes(docs)
        # Of the texts that share the class's least id, the least key.
        first = classes.filter(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("key").alias("key"))
        first = first.join(classes.select("key", "class_id"), "key").select("key", "class_id")
        c = rows.groupBy(F.col("key").alias("k"), "doc_id").agg(F.count(F.lit(1)).alias("rows_"))
        chosen = first.join(c, (c["k"] == first["key"]) & c["doc_id"].eqNullSafe(first["class_id"]))
        chosen = chosen.select(F.col("key").alias("_omh_key"), F.col("doc_id").alias("_omh_id"), F.col("rows_").alias("_omh_rows"))
        chosen = materialize(chosen, "chosen")
        keep(chosen)
    keyed = docs.withColumn("_omh_text", content_key(F.col("text")))
    kept = keyed.join(chosen, (keyed["_omh_text"] == chosen["_omh_key"]) & keyed["doc_id"].eqNullSafe(chosen["_omh_id"]))
    if chosen.filter("_omh_rows > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.filter("_omh_rows = 1").select(*docs.columns)
    return once.unionByName(kept.filter("_omh_rows > 1").dropDuplicates(["_omh_key", "_omh_id"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
