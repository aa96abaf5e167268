"""Fill-in-middle transformation by an escaped marker that is injected after every token.

A delimiter and an escape character are escaped in the text, ``regexp_replace`` appends the delimiter after each token,
and the delimiters are counted. ``substring_index`` extracts the tokens up to a rank, from a rank, or between two; what it
gives is unescaped and the parts are put together. Both characters are no white space and neither are their escapes, so
escaping moves no token border. All of it is column expressions on one row: nothing is shuffled.

The cuts, and whether and how a document is transformed, follow from the digest of the seed and ``doc_id``.
A text that contains one of the three marks is left plain, so a transformed document can always be taken apart again.

Edge cases: null texts count as empty; an empty text is plain with no tokens; a null id is digested as an empty string;
texts of any length are cut whole; white space at the end is a token of its own; repeated rows give the same row again;
further columns pass :func:`transform` whatever their names, but for those that it adds; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token is white space and a word, or white space at the end; marks of prefix, suffix and middle.
TOKEN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST = 50, 80  # per cent that are transformed, and of these per cent with the suffix first
SEED = 42
DELIMITER, ESCAPE = "\x01", "\x02"


def _replace(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by))


def escape(text: Column) -> Column:
    """``text`` without the delimiter, one to one."""
    return _replace(_replace(text, ESCAPE, ESCAPE + "e"), DELIMITER, ESCAPE + "d")


def unescape(part: Column) -> Column:
    """The original of an escaped part, whose delimiters go."""
    return _replace(_replace(_replace(part, DELIMITER, ""), ESCAPE + "d", DELIMITER), ESCAPE + "e", ESCAPE)


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _between(marked: Column, n: Column, first: Column, last: Column) -> Column:
    """Tokens ``first`` to ``last`` (from 0, end exclusive); both are counted from the nearer end by substring_index."""
    upto = F.when(last == n, marked).otherwise(F.call_function("substring_index", marked, F.lit(DELIMITER), last))
    # The part up to `last` holds last - 1 delimiters, or one more if it is all of the text and ends with one.
    inner = last - first + F.when(last == n, F.lit(1)).otherwise(F.lit(0))
    return F.when(first >= last, F.lit("")).otherwise(unescape(F.call_function("substring_index", upto, F.lit(DELIMITER), -inner)))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``fim``: n tokens, form (plain, psm or spm), prefix, middle and suffix, and the output."""
    body = F.coalesce(F.col(text), F.lit(""))
    escaped = docs.withColumn("fim", F.struct(body.alias("body"), escape(body).alias("escaped"), F.array(*draws(seed, F.col(key))).alias("h")))
    marked = escaped.withColumn("fim", F.struct("fim.body", "fim.h", F.length("fim.escaped").alias("chars"), F.regexp_replace("fim.escaped", TOKEN, "$0" + DELIMITER).alias("marked")))
    n = (F.length("fim.marked") - F.col("fim.chars")).cast("int")  # delimiters
    h1, h2, h3, h4 = (F.col("fim.h")[i] for i in range(4))
    holds = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("fim.body", F.lit(mark))
    form = F.when((F.col("fim.body") == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    counted = marked.withColumn("fim", F.struct("fim.body", "fim.marked", "fim.h", n.alias("n"), form.alias("form")))
    units = F.col("fim.n")
    cut = lambda h: (h % (units + 1)).cast("int")
    ranked = counted.withColumn("fim", F.struct("fim.*", F.least(cut(h1), cut(h2)).alias("lo"), F.greatest(cut(h1), cut(h2)).alias("hi")))
    m, lo, hi, at = F.col("fim.marked"), F.col("fim.lo"), F.col("fim.hi"), F.col("fim.form")
    part = lambda a, b: F.when(at != "plain", _between(m, units, a, b))
    parts = ranked.withColumn("fim", F.struct("fim.body", "fim.n", "fim.form", part(F.lit(0), lo).alias("prefix"), part(lo, hi).alias("middle"), part(hi, units).alias("suffix")))
    p, m, s = (F.col(f"fim.{x}") for x in ("prefix", "middle", "suffix"))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(at == "plain", F.col("fim.body")).when(at == "psm", psm).otherwise(spm)
    return parts.withColumn("fim", F.struct(F.col("fim.n").cast("long").alias("n"), "fim.form", "fim.prefix", "fim.middle", "fim.suffix", output.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text of an output."""
    index = lambda x, mark, k: F.substring_index(x, mark, k)
    middle = index(output, MIDDLE, -1)
    front = index(output, MIDDLE, 1)
    psm = F.concat(index(index(front, PREFIX, -1), SUFFIX, 1), middle, index(front, SUFFIX, -1))
    spm = F.concat(index(front, PREFIX, -1), middle, index(index(front, SUFFIX, -1), PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents transformed, digested, restored and digested again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = transform(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select(
        "doc_id", "fim.n", "fim.form",
        F.length("fim.prefix").cast("long").alias("prefix_chars"), F.length("fim.middle").cast("long").alias("middle_chars"),
        sha(F.col("fim.output")).alias("output_sha256"), sha(restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(u[1:lo], '') END AS a,
        CASE WHEN form <> 'plain' THEN array_to_string(u[lo + 1:hi], '') END AS m,
        CASE WHEN form <> 'plain' THEN array_to_string(u[hi + 1:], '') END AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(a) AS BIGINT) AS prefix_chars, CAST(length(m) AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(body) AS restored_sha256
FROM p
"""
