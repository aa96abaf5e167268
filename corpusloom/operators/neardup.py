"""Near duplicates by banded MinHash of word shingles: classes, link counts and one document of each class.

A text's set of five-word shingles gets 128 minima of keyed hashes, in 16 bands of 8. Sets that agree in a band are candidates
and are compared exactly: a link is a Jaccard similarity of at least the threshold. At 0.8 a pair shares a band with a
probability of 1 - (1 - 0.8⁸)¹⁶ = 0.947, at 0.85 of 0.994; ``corpus_rules.shingle_jaccard`` is the exact join.

At scale: texts of equal sets meet once, by weight. A pair counts in its first common band alone, which the bands of both
tell, so no list of pairs is made: a block (``functions.blocks``) reports for each text how many links it has there, and a
root. Band keys are all that is written of every text; texts are read again, and shingled, for those only that meet a
partner which they have not met before. A bounded filter of these stands in front of the join that fetches them.
A passage or a family that fills a bucket is split into parts. Components are found by alternating stars.

Edge cases: texts that are null, empty or white space have no words and no links; a text of one to four words has one
shingle; each row is a document, repeated ones and those without an id too, and these link like any other; a class whose
documents all lack an id has a null class id; of rows that tie for the least id any one is kept; further columns pass
:func:`keep_one` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.blocks import components, each_block, into_blocks, local_roots, new_pairs, together
from ..functions.tables import written
from .corpus_rules import words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 8
PART = 1024  # texts of a part of a bucket, about
PART_SHINGLES = 4_000_000  # shingles of a part, about
SLICE = 1 << 15  # shingles whose minima are taken together, about
COLUMNS = 2048  # shingles of a block that are compared together


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set of 64-bit shingles; no set is empty."""
    seeds = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out, at = np.empty((len(sets), BANDS), np.int64), 0
    while at < len(sets):
        upto, n = at + 1, len(sets[at])
        while upto < len(sets) and n + len(sets[upto]) <= SLICE:
            n += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto]).view(np.uint64)
        starts = np.r_[0, np.cumsum([len(s) for s in sets[at : upto - 1]])].astype(np.int64)
        for band in range(BANDS):
            key = np.full(upto - at, band, np.uint64)
            for seed in seeds[band * ROWS : (band + 1) * ROWS]:
                key = _mix(key ^ np.minimum.reduceat(_mix(flat ^ seed), starts))
            out[at:upto, band] = key.view(np.int64)
        at = upto
    return out


def _words(text: str) -> Column:
    """Hashes of a text's words."""
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def shingles(h: np.ndarray) -> np.ndarray:
    """The sorted set of a text's shingles, from its words; fewer words than a shingle has are one."""
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.int64)
    h, out = np.asarray(h, np.int64).view(np.uint64), np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out.view(np.int64))


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of shingles, a digest of their set and its band keys; both are null without words."""
    for batch in batches:
        sets = [shingles(h) for h in batch["h"]]
        bits = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
        keys: list[bytes | None] = [None] * len(sets)
        if some := [i for i, s in enumerate(sets) if len(s)]:
            for i, k in zip(some, band_keys([sets[i] for i in some]), strict=True):
                keys[i] = k.tobytes()
        yield batch.drop(columns="h").assign(n=[len(s) for s in sets], bits=bits, keys=keys)


def _with_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="h").assign(shingles=[shingles(h).tobytes() for h in batch["h"]])


def _dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch["keys"]), np.int64).reshape(-1, BANDS)
        for band in range(BANDS):
            yield pd.DataFrame({"band": band, "key": keys[:, band], "node": batch["node"], "n": batch["n"], "keys": batch["keys"]})


def _may_link(n: np.ndarray, threshold: float):
    """Whether the sizes of two sets allow the threshold."""
    return lambda a, b: np.minimum(n[a][:, None], n[b]) >= threshold * np.maximum(n[a][:, None], n[b]) - 1e-9


def _candidates(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in each_block(batches):
            keys = np.frombuffer(b"".join(rows["keys"]), np.int64).reshape(-1, BANDS)
            i, j = new_pairs(block, rows["part"].to_numpy(), keys, _may_link(rows["n"].to_numpy(), threshold))
            at = np.unique(np.r_[i, j])
            if len(at):
                band, key, low, high = block
                yield pd.DataFrame({"band": band, "key": key, "low": low, "high": high, "part": rows["part"].to_numpy()[at], "node": rows["node"].to_numpy()[at]})

    return run


def _similar(sets: list[np.ndarray], n: np.ndarray, threshold: float):
    """Whether the Jaccard similarity of two sets reaches the threshold, for all pairs of two lists of rows."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    values, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1  # the others are in one set
    order = np.argsort(column[shared], kind="stable")
    owner, column = owner[shared][order], column[shared][order]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    width = int(column[-1]) + 1 if len(column) else 0
    ends = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = np.zeros((len(a), len(b)), np.float32)
        for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            here = np.zeros((len(sets), COLUMNS), np.float32)
            here[owner[lo:hi], column[lo:hi] - k * COLUMNS] = 1
            common += here[a] @ here[b].T
        return common >= threshold * (n[a][:, None] + n[b] - common) - 1e-6

    return linked


def _links(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in each_block(batches):
            rows = rows.sort_values("node", ignore_index=True)
            sets = [np.frombuffer(s, np.int64) for s in rows["shingles"]]
            keys = np.frombuffer(b"".join(rows["keys"]), np.int64).reshape(-1, BANDS)
            node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
            i, j = new_pairs(block, rows["part"].to_numpy(), keys, _similar(sets, rows["n"].to_numpy(), threshold))
            if len(i):
                linked = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
                root, at = local_roots(len(rows), i, j), np.unique(np.r_[i, j])
                yield pd.DataFrame({"node": node[at], "linked": linked[at].astype(np.int64), "root": node[root[at]]})

    return run


def _content(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classes(docs: DataFrame, threshold: float, part: int) -> DataFrame:
    """(row, id, n_links, class_id, kept) of ``docs`` (row, id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("row", "id", _content("text").alias("content"), _words("text").alias("h"))
    rows = written(rows.mapInPandas(_sketched, f"row long, id {kind}, content binary, n long, bits binary, keys binary"), "sketches")
    sets = rows.filter(F.col("bits").isNotNull()).groupBy("bits").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min(F.struct("content", "id")).alias("at"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")
    )
    sets = written(sets, "sets")
    dealt = sets.select("node", "n", "keys").mapInPandas(_dealt, "band int, key long, node long, n long, keys binary")
    met = together(into_blocks(dealt, "node", "n", part, PART_SHINGLES)).mapInPandas(_candidates(threshold), "band int, key long, low int, high int, part int, node long")
    met = written(met, "met")
    needed = written(met.select("node").distinct().join(sets, "node").select("node", "weight", "n", "keys", F.col("at.content").alias("needed"), F.col("at.id").alias("first_id")), "needed")
    again = bloom.maybe_seen(docs.select("id", "text", _content("text").alias("content")), "content", bloom.build(needed, "needed")).filter("maybe")
    again = again.join(needed.select("node", "needed", "first_id"), (F.col("content") == F.col("needed")) & F.col("id").eqNullSafe(F.col("first_id")))
    again = again.groupBy("node").agg(F.any_value("text").alias("text"))  # of a row that is there several times
    found = written(again.select("node", _words("text").alias("h")).mapInPandas(_with_shingles, "node long, shingles binary"), "shingles")
    known = needed.select("node", "weight", "n", "keys").join(found, "node")
    links = written(together(met.join(known, "node")).mapInPandas(_links(threshold), "node long, linked long, root long"), "links")
    counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    nodes = sets.select("bits", "node", "weight").join(counts, "node", "left").join(components(links, "node", "root"), "node", "left")
    nodes = nodes.select("bits", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("class"))
    found = rows.select("row", "id", "bits").join(nodes, "bits", "left")
    found = found.select("row", "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("class", "row").alias("class"))
    found = written(found, "classes")
    # A row with an id goes before one without.
    chosen = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first"))
    return found.join(chosen, "class").select("row", "id", "n_links", F.col("first.id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_classes(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """(``key``, n_links, class_id, kept) of every row of ``docs`` (``key``, text).

    ``n_links`` counts the other rows at the threshold, ``class_id`` is the least id that links reach, and one row of a class
    is kept.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), "text")
    return _classes(rows, threshold, part).drop("row").withColumnRenamed("id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """``docs`` with one row of each class: the one of least id, and of its repetitions any one."""
    rows = written(docs.withColumn("_neardup_row", F.monotonically_increasing_id()), "documents")
    classes = _classes(rows.select(F.col("_neardup_row").alias("row"), F.col(key).alias("id"), "text"), threshold, part)
    return rows.join(classes.filter("kept").select(F.col("row").alias("_neardup_row")), "_neardup_row").select(*docs.columns)
