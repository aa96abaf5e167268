"""Running totals and row numbers over a total order without sorting everything in one task.

A table of up to ``ROWS`` rows is one range. A larger one is cut into ranges at quantiles of a sample, one for ``ROWS`` rows
and ``GRID`` at most; beyond that ranges grow, and Spark sorts them on disk. A key value that spans several quantiles, or a
null that does, is cut further by the first tie breaker, a number or a text, so ties do not meet in one task either. Totals
run within a range; what lies before a range is summed over one row a range. The sample decides where ranges end and
nothing else. A stream may be split further by ``within`` columns; a null there is a stream like any other. Null keys come
first. Pass narrow rows: a key, what is counted and a row number, and join the result back.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID = 4096  # ranges at most
ROWS = 100_000  # of a range, about
SAMPLED = 32  # rows of the sample for each range, which the driver sorts
SEED = 1


def past_cuts(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at or below ``key``, plus one; 0 for a null. Looks at two rows of about the root of their number."""
    if not cuts:
        return F.when(key.isNull(), F.lit(0)).otherwise(F.lit(1))
    step = isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    group = F.size(F.filter(lit([g[0] for g in groups]), lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(F.array(*map(lit, groups)), F.greatest(group, F.lit(1))), lambda c: c <= key))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.greatest(group - 1, F.lit(0)) * step + inside + 1)


def _quantiles(values: list, parts: int) -> list:
    values = sorted(values)
    return [values[len(values) * i // parts] for i in range(1, parts)] if values else []


def range_bucket(df: DataFrame, key: str, ties: tuple[str, ...] = ()) -> Column:
    """Number of the range of a numeric ``key``, and of the first of ``ties`` within a frequent key, rising with the order."""
    n = df.count()
    ranges = min(GRID, -(-n // ROWS))
    if ranges < 2:
        return F.lit(0)
    splits = [t for t in ties[:1] if isinstance(df.schema[t].dataType, T.NumericType | T.StringType)]
    sample = df.select(key, *splits).sample(min(1.0, SAMPLED * ranges / n), SEED).collect()
    keys = _quantiles([r[0] for r in sample if r[0] is not None], ranges)
    cuts, often = sorted(set(keys)), {a for a, b in zip(keys, keys[1:], strict=False) if a == b}
    nulls = sum(r[0] is None for r in sample) * ranges > 2 * len(sample)
    if not splits or not (often or nulls):
        return past_cuts(F.col(key), cuts)
    held = [r[1] for r in sample if r[1] is not None and (r[0] in often or nulls and r[0] is None)]
    parts = sorted(set(_quantiles(held, max(2, ranges * len(held) // max(1, len(sample))))))
    frequent = F.col(key).isin(*often) if often else F.lit(False)
    # A range starts at a frequent key: its rows come first there, in parts, and the others after them.
    part = F.when(frequent | F.lit(nulls) & F.col(key).isNull(), past_cuts(F.col(splits[0]), parts)).otherwise(F.lit(len(parts) + 2))
    return past_cuts(F.col(key), cuts) * (len(parts) + 3) + part


def running_total(df: DataFrame, value: Column, key: str, name: str, within: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, in the order of ``key`` and then ``ties``.

    ``df`` is read three times; pass a written table where it is costly.
    """
    df = df.withColumn("_range", range_bucket(df, key, ties)).withColumn("_value", value)
    rows = W.partitionBy(*within, "_range").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*within, "_range").agg(F.sum("_value").alias("_sum"))
    # One row a range and stream: small, so the window over it is too.
    before = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    names = {c: f"_of_{i}" for i, c in enumerate(within)}
    sums = sums.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = df.withColumn("_local", F.coalesce(F.sum("_value").over(rows), F.lit(0))).join(sums, same).drop("_of", *names.values())
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_range", "_value", "_local", "_before")


def row_index(df: DataFrame, key: str, name: str, within: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the number of rows before, from 0."""
    return running_total(df, F.lit(1).cast("long"), key, name, within, ties)

