import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    """Brute force: (n, form, prefix, middle, suffix, output)."""
    text = text or ""
    u = TOKEN.findall(text)
    d = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    cuts = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, None, text
    p, m, s = "".join(u[: cuts[0]]), "".join(u[cuts[0] : cuts[1]]), "".join(u[cuts[1] :])
    if h[3] % 100 < 80:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def check(rows):
    for r in rows:
        got = r["fim"]
        want = plain(r["doc_id"], r["text"])
        assert (got["n"], got["form"], got["prefix"], got["middle"], got["suffix"], got["output"]) == want, r["doc_id"]
        assert r["again"] == (r["text"] or "")


def done(docs):
    return fim.transform(docs).withColumn("again", fim.restore(F.col("fim.output"), F.col("fim.form"))).select("doc_id", "text", "fim", "again")


def test_against_brute_force(spark):
    r = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x00", "\x01", "\x02", "\x01d", "\x02e", "d", "e", "<", "P>", "<P", "<S", ">", "M", "é", "\U0001f600", "\xa0", "\x1c", "$0", "\\"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(1500)]
    rows += [(i, "x<P>y z") for i in range(1500, 1510)] + [(i, "one two three four five six") for i in range(1510, 1600)]
    got = done(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    check(got)
    assert {x["fim"]["form"] for x in got} == {"plain", "psm", "spm"}


def test_edge_cases(odd_docs, clashing, no_docs, odd_rows):
    for docs in (odd_docs, clashing):
        got = done(docs).collect()
        assert len(got) == len(odd_rows)
        check(got)
    assert set(clashing.columns) <= set(fim.transform(clashing).columns)
    assert done(no_docs).count() == 0


def test_very_long_texts(spark):
    texts = ["w " * 1_500_000, "x" * 3_000_000, " " * 2_000_000, "\x01" * 300_000 + " " + "\x02" * 300_000]
    rows = [(i * 10 + k, t) for i, t in enumerate(texts) for k in range(2)]
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(done(got).collect())


def test_rates(spark):
    rows = [(i, "a b c d e f g h") for i in range(4000)]
    got = done(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("fim.form").count().collect()
    n = {r["form"]: r["count"] for r in got}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 1600) < 200


def test_query_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = fim.query(spark, "/root/testdata/sf0.01")
    want = con.execute(fim.ORACLE)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
