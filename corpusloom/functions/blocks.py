"""Pairs within buckets, counted block by block, and the components that they make.

A bucket is the rows that share a band and a key. One that is too large is split into parts, and each pair of parts is a
block: a task holds two parts at most, and a pair of rows meets in exactly one block of the bucket. What comes out of a block
is a row for each of its rows, never one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

BLOCK = ("band", "key", "low", "high")


def into_blocks(rows: DataFrame, by: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """``rows`` (band, key and others) of buckets of two and more, with part, low and high; a row is there once for each part it meets.

    A part holds about ``most_rows`` rows, and about ``most_size`` of the sum of ``size``. Rows are dealt by the hash of ``by``.
    """
    buckets = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_size")).filter("_n > 1")
    parts = F.ceil(F.greatest(F.col("_n") / most_rows, F.col("_size") / most_size)).cast("int")
    placed = rows.join(buckets.select("band", "key", parts.alias("_parts")), ["band", "key"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return placed.withColumn("low", F.least("part", "_other")).withColumn("high", F.greatest("part", "_other")).drop("_parts", "_other")


def together(rows: DataFrame) -> DataFrame:
    """The rows of a block side by side in one task."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *BLOCK).sortWithinPartitions(*BLOCK)


def each_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, ...], pd.DataFrame]]:
    """(band, key, low, high) and rows of the blocks of a sorted partition, whatever batches they come in."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        k = batch[list(BLOCK)].to_numpy(np.int64)
        starts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(k)] if len(k) else []
        for i, j in zip(starts, starts[1:], strict=False):
            name = tuple(k[i].tolist())
            if held and name != key:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = name
            held.append(batch.iloc[i:j])
    if held:
        yield key, pd.concat(held, ignore_index=True)


def new_pairs(block: tuple[int, ...], part: np.ndarray, keys: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block, each once: those of no common earlier band, by ``keys`` (a column a band), that ``linked`` names.

    ``linked(a, b)`` gives, for rows ``a`` against rows ``b``, the matrix of those that are linked.
    """
    band, _, low, high = block
    a, b = np.flatnonzero(part == low), np.flatnonzero(part == high)
    if not len(a) or not len(b):
        return a[:0], b[:0]
    ok = linked(a, b)
    for t in range(band):
        ok &= keys[a, t][:, None] != keys[b, t]
    i, j = np.nonzero(np.triu(ok, 1) if low == high else ok)
    return a[i], b[j]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's connected group."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node of its component.

    Every node points to the least node that it knows of among its neighbours and theirs, in turns, until nothing changes:
    links are first turned to the least neighbour of their greater end, then of their lesser one.
    """
    x, y = F.col(a), F.col(b)
    edges = written(links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    while True:
        # Large star: the neighbours above a node point to the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        # Small star: a node and the nodes below it point to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = small
