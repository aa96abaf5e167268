"""Mergeable sketches by domain: how many different keys there are, and quantiles of measures, over runs.

A run leaves a row a domain: its rows, a HyperLogLog sketch of its keys and a KLL sketch of each measure. Rows of several
runs merge without looking at their data again, and a sketch has a fixed size whatever it has seen. Beside them stand the
exact ways: ``curation.seen_counts`` and ``corpus_rules.perplexity_band``.

With the defaults the number of keys is within 3 % and the rank of a quantile within 1.5 % nearly always; domains of few rows are
exact. Which rows a KLL sketch keeps is drawn, so close quantiles may differ from run to run.

Edge cases: null keys and measures are not counted; null domains are one domain; a domain without any measure has null
quantiles; an empty table leaves no rows, and merges with others; measures that are no numbers (NaN) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 13  # of the sketch of keys
KLL_K = 400


def sketched(rows: DataFrame, domain: str, key: Column, measures: dict[str, Column], log_k: int = LOG_K, k: int = KLL_K) -> DataFrame:
    """(``domain``, n, keys, and a sketch for each measure), one row a domain; sketches are made on the map side."""
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    return rows.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, log_k).alias("keys"), *[F.kll_sketch_agg_double(number(c), k).alias(name) for name, c in measures.items()]
    )


def merged(sketches: DataFrame, domain: str, measures: tuple[str, ...]) -> DataFrame:
    """Rows of several runs as one row a domain."""
    return sketches.groupBy(domain).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), *[F.kll_merge_agg_double(m).alias(m) for m in measures])


def estimates(sketches: DataFrame, domain: str, measures: tuple[str, ...], ranks: tuple[float, ...] = (0.05, 0.5, 0.8)) -> DataFrame:
    """(``domain``, n, n_keys, and ``measure``_``rank`` in per cent for each)."""
    def quantile(m: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(m) > 0, F.kll_sketch_get_quantile_double(m, F.lit(q))).alias(f"{m}_{round(100 * q)}")

    return sketches.select(domain, "n", F.hll_sketch_estimate("keys").alias("n_keys"), *[quantile(m, q) for m in measures for q in ranks])


def band(rows: DataFrame, measure: str, sketches: DataFrame, bottom: float = 0.05, top: float = 0.20) -> DataFrame:
    """Rows whose measure lies between the quantiles of all domains together: one look at each row, and no sort."""
    whole = sketches.agg(F.kll_merge_agg_double(measure).alias("s")).filter(F.kll_sketch_get_n_double("s") > 0)
    ends = whole.select(F.kll_sketch_get_quantile_double("s", F.lit(bottom)).alias("_low"), F.kll_sketch_get_quantile_double("s", F.lit(1 - top)).alias("_high"))
    return rows.join(F.broadcast(ends), (F.col(measure) >= F.col("_low")) & (F.col(measure) < F.col("_high"))).drop("_low", "_high")  # one row
