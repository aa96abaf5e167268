import random
from collections import Counter

from corpusloom.llm import urlfilter as uf


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
        path = rest[n : n + m]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_against_brute_force(spark):
    r = random.Random(5)
    hosts = ["net", "example.net", "www.example.net", "a.b.example.net", "example.com", "org", "x.org", "notexample.net", "exa\x00mple.net", "a\x01.net", "net.", "", "NET"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/x?y", "/fr/#a", "?q", "#/en/", "/en\n/"]
    urls = [r.choice(["http://", "https://", "", "x://y://"]) + r.choice(hosts) + r.choice(paths) for _ in range(600)]
    urls += ["http://hot.example.net/en/"] * 900 + [None, "", "://", "://net/"]
    rules = [*uf.RULES, ("block", "example.net", "/en/x"), ("allow", "a.b.example.net", "/"), ("block", "exa\x00mple.net", "/"), ("block", "www.example.net", "/e")]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "kind") for i, u in enumerate(urls)], "page_id long, url string, kind string")
    for ranges in (1, 7):
        out = uf.judge_urls(pages, uf.rule_table(spark, rules), ranges=ranges).collect()
        want = Counter((i if i % 50 else None, *brute(u, rules)) for i, u in enumerate(urls))
        assert Counter(map(tuple, out)) == want
    assert Counter(map(tuple, uf.judge_urls(pages, uf.rule_table(spark, [])).collect())) == Counter((i if i % 50 else None, *brute(u, [])) for i, u in enumerate(urls))


def test_large_ids_and_no_rows(spark):
    big = 2**62 + 1
    pages = spark.createDataFrame([(big, "http://a.net/"), (None, None)], "page_id long, url string")
    out = {r["page_id"]: r["rule"] for r in uf.judge_urls(pages, uf.rule_table(spark, uf.RULES)).collect()}
    assert out == {big: "net/", None: None}
    assert uf.judge_urls(pages.limit(0), uf.rule_table(spark, uf.RULES)).count() == 0
