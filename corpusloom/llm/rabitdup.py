"""Near duplicates of embeddings by randomised-rotation binary codes.

A unit vector is rotated into a wider space and coded by the signs of its coordinates. Beside the code stands its correction
factor, the inner product of the vector and its code. Divided by its factor, a code that is rotated back is an unbiased
stand-in for its vector; each vector has two codes of independent rotations, and the inner product of the first of one with
the second of another estimates their cosine without bias. What is left is as small as the factors and the width of the code
say (:func:`deviations`). A pair whose estimate lies more than ``SURE`` such deviations below the threshold is refused; all
others are computed again from the vectors, in double precision.

Bits of the codes are the keys of buckets too: a band of bits is a bucket, and two vectors at the threshold share one of the
bands with a probability of at least 1 - ``MISSED``, closer ones more likely. A pair counts in its first common band alone,
which both codes tell, so that no list of pairs is kept: a block reports for each vector how many links it has there, and
a root for each local group.

At scale: equal vectors meet once, by weight. The number of bits of a band follows the number of vectors, so that chance
puts about ``LOAD`` of them into a bucket. Only codes and factors are dealt out by band, a few bands at a time; vectors follow for
those that have a candidate. Buckets of more than ``PART`` vectors are split into parts, and every pair of parts is a block
of its own, so a task holds two parts at most. A group of m different vectors that are all near each other has m² / 2 links to
count; its blocks hold m² / ``PART`` rows a band.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and come back as they
are; only vectors of one length are compared; of the rows that share an id the least usable vector counts and they give one
row; rows without an id link with nothing and each give a row with a null component; further columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, scratch
from .orderminhash import components

SIMILAR = 0.9
MISSED = 0.001  # probability that a pair at the threshold shares no band
SURE = 4.0  # deviations below the threshold at which an estimate refuses a pair
LOAD = 128  # vectors that chance puts into a bucket, about
PART = 1024  # vectors of a part of a bucket, about
ROUND = 8  # bands that are dealt out at a time
WIDTH = 256  # bits of a code, at least
SEED = 20
BUCKET = ("band", "key", "dim", "low", "high")
CODES = "node long, weight long, dim int, vec binary, code binary, factors binary"


class Bands:
    """Which bits of the two codes make the key of each band."""

    def __init__(self, vectors: int, similar: float = SIMILAR, missed: float = MISSED, load: int = LOAD):
        self.bits = max(0, ceil(log2(max(1, vectors / load))))
        meets = (1 - acos(similar) / pi) ** self.bits
        self.number = 1 if meets == 1 else ceil(log(missed) / log(1 - meets))
        #: Bits repeat between bands only where these are very many, and then no bit is in more than about eight.
        self.least_width = 64 * ceil(self.bits * self.number / 8 / 128)

    def width(self, dim: int) -> int:
        return max(WIDTH, 64 * ceil(dim / 64), self.least_width)

    def keys(self, code: np.ndarray, upto: int) -> np.ndarray:
        """Keys of the first bands, a column each, of codes whose bits are the columns."""
        chosen = _choice(code.shape[1], self.bits, self.number)[:upto]
        if not self.bits:
            return np.zeros((len(code), upto), np.int64)
        out = np.zeros((len(code), upto), np.int64)
        for b in range(self.bits):
            out |= code[:, chosen[:, b]].astype(np.int64) << b
        return out


@lru_cache(maxsize=8)
def _choice(width: int, bits: int, number: int) -> np.ndarray:
    r = np.random.default_rng(SEED)
    rows = max(1, width // max(1, bits))  # disjoint bands of one permutation
    turns = [r.permutation(width)[: rows * bits].reshape(rows, bits) for _ in range(ceil(number / rows))]
    return np.concatenate(turns)[:number]


@lru_cache(maxsize=8)
def rotations(dim: int, width: int) -> np.ndarray:
    """Two random rotations of ``dim`` coordinates, filled up with zeros, into ``width``."""
    r = np.random.default_rng([SEED, dim, width])
    return np.stack([np.linalg.qr(r.normal(size=(width, dim)))[0] for _ in range(2)])


def encode(unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of both codes side by side, and their correction factors, of unit vectors."""
    turned = np.einsum("pwd,nd->npw", rotations(unit.shape[1], width), unit)
    factors = np.abs(turned).sum(axis=2) / np.sqrt(width)
    return (turned > 0).reshape(len(unit), -1), factors.astype(np.float32)


def decode(code: np.ndarray, factors: np.ndarray, dim: int) -> np.ndarray:
    """Both stand-ins of each vector, (2, n, dim); each is unbiased and independent of the other."""
    width = code.shape[1] // 2
    signs = (code.reshape(len(code), 2, width) * np.float32(2) - np.float32(1)) / np.float32(np.sqrt(width))
    back = rotations(dim, width).astype(np.float32)
    return np.stack([signs[:, p] @ back[p] / factors[:, p, None] for p in range(2)])


def deviations(factors: np.ndarray, other: np.ndarray, width: int, similar: float = SIMILAR) -> np.ndarray:
    """Standard deviations of the estimates of all pairs of two sets, at a cosine of ``similar``.

    The part of a code across its vector is (1 - f²) / f² in square after the correction and has a random direction among
    ``width`` - 1. That the estimate is the mean of two is left as a margin.
    """
    a, b = ((1 / np.square(x.min(axis=1), dtype=np.float64) - 1) for x in (factors, other))
    return np.sqrt(((1 - similar**2) * (a[:, None] + b) + a[:, None] * b) / (width - 1))


def unit_rows(vec: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# --- rows --------------------------------------------------------------------------------------------------------------


def _usable(e):
    big = float("inf")
    return e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(e, lambda x: x != 0)


def _coded(bands: Bands):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len)
            for dim, rows in batch.groupby(dims.rename("dim")):
                vec = [np.asarray(x, np.float64).tobytes() for x in rows["embedding"]]
                code, factors = encode(unit_rows(vec), bands.width(dim))
                yield pd.DataFrame({
                    "node": rows["node"], "weight": rows["weight"], "dim": dim, "vec": vec,
                    "code": [x.tobytes() for x in np.packbits(code, axis=1)], "factors": [x.tobytes() for x in factors],
                })

    return run


def _bits(code) -> np.ndarray:
    code = list(code)
    return np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1)


def _dealt(bands: Bands, lo: int, hi: int):
    """A row for each vector and band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                keys = bands.keys(_bits(rows["code"]), hi)
                for band in range(lo, hi):
                    yield pd.DataFrame({"band": band, "key": keys[:, band], "dim": dim, "node": rows["node"].to_numpy(), "code": rows["code"].to_numpy(), "factors": rows["factors"].to_numpy()})

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each block of a sorted partition, whatever batches they come in."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[list(BUCKET)].to_numpy(np.int64)
        starts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        for i, j in zip(starts, starts[1:], strict=False):
            yield tuple(k[i].tolist()), batch.iloc[i:j]
        held = batch.iloc[starts[-1] :]
    if held is not None and len(held):
        yield tuple(held[list(BUCKET)].to_numpy(np.int64)[0].tolist()), held


def _sides(rows: pd.DataFrame, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    part = rows["part"].to_numpy()
    return np.flatnonzero(part == low), np.flatnonzero(part == high)


def _new(bands: Bands, code: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Whether pairs of rows share no earlier band."""
    keys, fresh = bands.keys(code, band), np.ones(len(i), bool)
    for t in range(band):
        fresh &= keys[i, t] != keys[j, t]
    return fresh


def _candidates(bands: Bands, similar: float):
    """The vectors of each block that have a partner which its estimate does not refuse, and which is met here first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (band, key, dim, low, high), rows in _blocks(batches):
            if len(rows) < 2:
                continue
            a, b = _sides(rows, low, high)
            if not len(a) or not len(b):
                continue
            code, factors = _bits(rows["code"]), np.frombuffer(b"".join(rows["factors"]), np.float32).reshape(-1, 2)
            first, second = decode(code, factors, dim)
            estimate = (first[a] @ second[b].T + second[a] @ first[b].T) / 2
            i, j = np.nonzero(estimate >= similar - SURE * deviations(factors[a], factors[b], code.shape[1] // 2, similar))
            i, j = a[i], b[j]
            on = (i < j) if low == high else np.ones(len(i), bool)
            i, j = i[on], j[on]
            fresh = _new(bands, code, i, j, band)
            at = np.unique(np.r_[i[fresh], j[fresh]])
            if len(at):
                yield pd.DataFrame({"band": band, "key": key, "dim": dim, "low": low, "high": high, "part": rows["part"].to_numpy()[at], "node": rows["node"].to_numpy()[at]})

    return run


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's connected group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(bands: Bands, similar: float):
    """Exact cosines within each block: (node, linked, root), the weight of a vector's links and its group's least node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (band, _, _, low, high), rows in _blocks(batches):
            rows = rows.iloc[np.argsort(rows["node"].to_numpy())]
            a, b = _sides(rows, low, high)
            unit, weight, node = unit_rows(list(rows["vec"])), rows["weight"].to_numpy(), rows["node"].to_numpy()
            i, j = np.nonzero(unit[a] @ unit[b].T >= similar)
            i, j = a[i], b[j]
            on = (i < j) if low == high else np.ones(len(i), bool)
            i, j = i[on], j[on]
            fresh = _new(bands, _bits(rows["code"]), i, j, band)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            linked = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
            root, at = _local_roots(len(rows), i, j), np.unique(np.r_[i, j])
            yield pd.DataFrame({"node": node[at], "linked": linked[at].astype(np.int64), "root": node[root[at]]})

    return run


# --- links -------------------------------------------------------------------------------------------------------------


def _round(codes: DataFrame, bands: Bands, lo: int, hi: int, similar: float, part: int) -> DataFrame:
    """(node, linked, root) of the pairs whose first common band is one of these."""
    spark = codes.sparkSession
    dealt = codes.select("node", "dim", "code", "factors").mapInPandas(_dealt(bands, lo, hi), "band int, key long, dim int, node long, code binary, factors binary")
    sizes = dealt.groupBy("band", "key", "dim").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > part).select("band", "key", "dim", F.ceil(F.col("n") / part).alias("parts"))
    placed = dealt.join(large, ["band", "key", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    placed = placed.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "parts")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *BUCKET).sortWithinPartitions(*BUCKET)

    found = together(placed).mapInPandas(_candidates(bands, similar), "band int, key long, dim int, low int, high int, part int, node long")
    known = found.join(codes.select("node", "weight", "vec", "code"), "node")
    return together(known).mapInPandas(_links(bands, similar), "node long, linked long, root long")


def near_vectors(table: DataFrame, similar: float = SIMILAR, key: str = "vec_id", vector: str = "embedding", part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of ``table`` (``key``, ``vector``)."""
    spark = table.sparkSession
    with scratch() as keep:
        rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
        rows = rows.withColumn("embedding", F.when(_usable(F.col("embedding")), F.col("embedding")))
        nameless = rows.filter(F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        named = rows.filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        digest = F.unhex(F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))).cast("binary")))
        named = materialize(named.withColumn("bits", F.when(F.col("embedding").isNotNull(), digest)), "vectors")
        distinct = named.filter(F.col("bits").isNotNull()).groupBy("bits")
        distinct = distinct.agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
        distinct = materialize(distinct, "distinct-vectors")
        bands = Bands(distinct.count())
        codes = materialize(distinct.select("node", "weight", "embedding").mapInPandas(_coded(bands), CODES), "codes")
        links = None
        for lo in range(0, bands.number, ROUND):
            new = materialize(_round(codes, bands, lo, min(lo + ROUND, bands.number), similar, part), "links")
            links = new if links is None else links.unionByName(new)
        counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        nodes = distinct.select("bits", "node", "weight").join(counts, "node", "left").join(roots, "node", "left")
        nodes = materialize(nodes.select("bits", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")), "nodes")
        out = named.select("vec_id", "bits").join(nodes, "bits", "left")  # unusable vectors find no node
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        out = materialize(out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(nameless), "near-vectors")
        keep(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: links, component and verdict of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
