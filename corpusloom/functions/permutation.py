"""A keyed permutation of 0 to n - 1 that is computed number by number, and its inverse.

A number below the next power of four is cut into two halves, which a Feistel network mixes with keyed rounds: that is a
bijection whatever the round function is. A result that is not below n is mixed again until it is; that walk stays on one
cycle and ends, because the cycle holds the number that it began with. So an epoch's order needs no sort, a rank's row is
found without the other rows, and any number of workers agree on it.

A null, or a number outside 0 to n - 1, has no place: null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: A well-mixing 32-bit finisher.
FACTORS = (0x7FEB352D, 0x846CA68B)
LOW = 0xFFFFFFFF


def keys(seed: int | str) -> list[int]:
    """A 32-bit key a round."""
    return [int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    bits = max(1, -(-max(1, n - 1).bit_length() // 2))
    if bits > 31:
        raise ValueError("numbers below 2^62 only")
    return bits


def _mixed(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    t = (x + np.uint64(key)) & np.uint64(LOW)
    t = ((t ^ (t >> np.uint64(16))) * np.uint64(FACTORS[0])) & np.uint64(LOW)
    t = ((t ^ (t >> np.uint64(15))) * np.uint64(FACTORS[1])) & np.uint64(LOW)
    return (t ^ (t >> np.uint64(16))) & np.uint64(mask)


def _network(x: np.ndarray, bits: int, round_keys: list[int], back: bool) -> np.ndarray:
    mask, shift = (1 << bits) - 1, np.uint64(bits)
    left, right = x >> shift, x & np.uint64(mask)
    if back:
        for key in reversed(round_keys):
            left, right = right ^ _mixed(left, key, mask), left
    else:
        for key in round_keys:
            left, right = right, left ^ _mixed(right, key, mask)
    return left << shift | right


def permuted(x: np.ndarray, n: int, seed: int | str, back: bool = False) -> np.ndarray:
    """Places of numbers below ``n``, or with ``back`` the numbers at places."""
    out, bits, round_keys = x.astype(np.uint64), half_bits(n), keys(seed)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], bits, round_keys, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permutation(col: Column, n: int, seed: int | str, back: bool = False) -> Column:
    """The place of ``col`` in the permutation of 0 to ``n`` - 1, or with ``back`` the number at that place."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(np.int64), n, seed, back))

    inside = (col >= 0) & (col < n)
    return F.when(inside, run(F.when(inside, col.cast("long")).otherwise(F.lit(0).cast("long"))))


def permutation_sql(source: str, col: str, seed: int | str, name: str = "place") -> str:
    """Common table expressions for DuckDB: ``permuted`` is the table ``source`` (all numbers below its count in ``col``) with ``name``."""

    def network(inner: str) -> str:
        for key in keys(seed):
            inner = f"SELECT *, (r + {key}::UBIGINT) & {LOW}::UBIGINT AS t FROM ({inner})"
            for shift, factor in ((16, FACTORS[0]), (15, FACTORS[1])):
                inner = f"SELECT * REPLACE (((xor(t, t >> {shift})) * {factor}::UBIGINT) & {LOW}::UBIGINT AS t) FROM ({inner})"
            inner = f"SELECT * EXCLUDE (l, r, t), r AS l, xor(l, xor(t, t >> 16) & ((1::UBIGINT << bits) - 1)) AS r FROM ({inner})"
        return f"SELECT {col}, n, bits, (l << bits) | r AS x FROM ({inner})"

    split = lambda x, table: f"SELECT {col}, n, bits, {x} >> bits AS l, {x} & ((1::UBIGINT << bits) - 1) AS r FROM {table}"
    return (
        f"sized AS (SELECT *, count(*) OVER () AS n, greatest(1, ceil(ceil(log2(count(*) OVER ())) / 2))::UBIGINT AS bits FROM {source}), "
        f"walk({col}, n, bits, x) AS ({network(split(f'{col}::UBIGINT', 'sized'))} UNION ALL {network(split('x', 'walk WHERE x >= n'))}), "
        f"permuted AS (SELECT {col}, n, x::BIGINT AS {name} FROM walk WHERE x < n)"
    )
