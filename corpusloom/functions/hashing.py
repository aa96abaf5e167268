"""Keyed hashes that stand in for random draws: the same in every run, on every cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_digest(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def u01(seed: int | str, key: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(key_digest(seed, key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def u01_sql(seed: int | str, key: str) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"
