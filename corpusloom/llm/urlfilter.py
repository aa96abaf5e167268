"""URL filters by a sort-merge range join.

A host reversed by label, every label closed by a terminator, turns "this host and its subdomains" into one interval of
the canonical key. URLs and rules are dealt into the same key ranges, sorted together, and one sweep over each range
keeps a stack of the rule hosts that are open at the current key; nested hosts nest on the stack. A path is then looked
up among the paths of the open hosts, so the work per URL depends on the nesting only.

Ranges come from a sample of the keys; a key so frequent that it fills several ranges is dealt over all of them.

Edge cases: a null URL and one without "://" have an empty host and path, fit no rule and get the default verdict; a URL
without a path fits no rule, because every rule path starts with "/"; very long URLs are read whole; of rules that fit, the
longest host wins and then the longest path, so none tie; repeated rows are judged one by one; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLED_KEYS_PER_RANGE = 40


def host_and_path(url):
    """Columns host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host):
    """Labels from last to first, each closed by U+0000; U+0000 and U+0001 within a label are escaped."""
    safe = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x03")), F.lit("\x00"), F.lit("\x01\x02"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.")), "\x00"), F.lit("\x00"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, key and kind (rules before URLs)."""
    now, stack = None, []  # of [end of interval, host length, {path: (rule, verdict)}, path lengths from longest]
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("span", "key", "kind", "host", "path", "verdict")]
        out, at = [], []
        for i, (span, key, kind, host, path, verdict) in enumerate(zip(*cols, strict=True)):
            if span != now:
                now, stack = span, []
            while stack and key >= stack[-1][0]:
                stack.pop()
            if kind == 0:
                end = key[:-1] + "\x01"
                if not stack or stack[-1][0] != end:
                    stack.append([end, len(host), {}, []])
                stack[-1][2].setdefault(path, (host + path, verdict))
                if -len(path) not in stack[-1][3]:
                    bisect.insort(stack[-1][3], -len(path))
                continue
            best = None
            for _, n, paths, lengths in stack:
                for k in lengths:
                    if len(path) >= -k and (hit := paths.get(path[:-k])):
                        if best is None or (len(hit[0]), n) > best[0]:
                            best = ((len(hit[0]), n), hit)
                        break
            out.append(best[1] if best else (None, verdict))
            at.append(i)
        kept = batch.take(pa.array(at, pa.int64()))
        verdicts = [pa.array([x[k] for x in out], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([kept.column("page_id"), kept.column("host"), kept.column("path"), *verdicts], names=["page_id", "host", "path", "rule", "verdict"])


def _range_of(cuts: list[str]):
    """key, luck -> number of its range. Range i holds cuts[i-1] <= key < cuts[i]; a key that is several cuts in a row is
    dealt over all their ranges by ``luck``."""

    @F.pandas_udf("int")
    def number(key: pd.Series, luck: pd.Series) -> pd.Series:
        out = []
        for k, x in zip(key, luck, strict=True):
            lo, hi = bisect.bisect_left(cuts, k), bisect.bisect_right(cuts, k)
            out.append(lo + 1 + x % (hi - lo) if hi > lo else hi)
        return pd.Series(out)

    return number


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, host, path) rows as a DataFrame; larger lists are read from a table with these columns."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); the longest rule that fits wins."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, urls.count())
    want = SAMPLED_KEYS_PER_RANGE * ranges
    share = F.pmod(F.xxhash64("page_id", "path"), F.lit(max(1, n // want))) == 0  # for cut points only
    sample = [r[0] for r in urls.filter(share).select("key").orderBy(F.xxhash64("page_id", "path")).limit(2 * want).collect()]
    sample.sort()
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    number = _range_of(cuts)
    dealt = urls.withColumn("span", number("key", F.xxhash64("page_id", "path")))
    dealt = dealt.select("span", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(default).alias("verdict"))
    opened = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), "path").withColumn("key", host_key(F.col("host")))
    opened = opened.withColumn("until", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("\x01")))
    zero = F.lit(0).cast("long")
    opened = opened.withColumn("span", F.explode(F.sequence(number("key", zero), number("until", zero))))
    opened = opened.select("span", "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict")
    return (
        dealt.unionByName(opened)
        .repartition(ranges, "span")
        .sortWithinPartitions("span", "key", "kind", "path", "page_id")
        .mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the verdict on every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN suffix('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN suffix('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN suffix('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN suffix('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
