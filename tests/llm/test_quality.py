import math
import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import quality as qu


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab \n\t#é|\x0b") for _ in range(r.randint(0, 80)))
        assert qu.word_rules(text) == brute(text)


def test_odd_rows(spark, odd_docs, clashing, no_docs, odd_rows, labels):
    for docs in (odd_docs, clashing):
        out = qu.quality_stats(docs, labels).select("doc_id", "quality_rules.*").collect()
        small = [r for r in odd_rows if len(r[1] or "") < 10_000]
        got = sorted((tuple(r)[:6] for r in out if r["n_words"] < 20_000), key=repr)
        assert got == sorted(((r[0], *brute(r[1])) for r in small), key=repr)
        assert len(out) == len(odd_rows)
        for r in out:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert qu.quality_stats(no_docs, labels).count() == 0
    assert qu.quality_stats(odd_docs, labels.limit(0)).filter("quality_rules.llr != 0").count() == 0


def test_ratio_tells_junk_from_prose(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "re", "th", "in", "er", "on"]) for _ in range(r.randint(1, 4)))
    good = [(i, " ".join(word() for _ in range(80)) + ".") for i in range(300)]
    junk = [(i, " ".join(word() + "$$$" for _ in range(80))) for i in range(300, 340)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 340, 2)], "doc_id long, quality int")
    out = qu.quality_stats(docs, labels).select("doc_id", "quality_rules.*").collect()
    assert all(x["kept"] == (x["doc_id"] < 300) for x in out)
    weights = qu.fit_weights(docs, labels)
    assert np.isfinite(weights).all()
    text = good[0][1].encode()
    h = qu.trigrams(np.frombuffer(text, np.uint8))
    assert len(h) == len(text) - 2 and np.isclose(next(x["llr"] for x in out if x["doc_id"] == 0), weights[h].mean())


def test_ratio_against_brute_force(spark, odd_docs, odd_rows, labels, label_rows):
    """Buckets, counts, smoothing and mean in plain integers and floats, without the operator's functions."""

    def buckets(text):
        data, out = (text or "").encode("utf-8", "surrogatepass"), []
        for a, b, c in zip(data, data[1:], data[2:]):
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            h ^= h >> 15
            out.append(h * 0x2C1B3C6D % 2**32 >> 17)
        return out

    good = {i for i, q, _ in label_rows if q == 1}
    raw, target = Counter(), Counter()
    for i, text, *_ in odd_rows:
        got = buckets(text)
        raw.update(got)
        if i in good:
            target.update(got)
    n = 2**15
    weight = lambda b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    want = Counter()
    for i, text, *_ in odd_rows:
        got = buckets(text)
        llr = sum(map(weight, got)) / len(got) if got else 0.0
        failed = brute(text)[0] < 50 or 100 * brute(text)[4] > 50 * brute(text)[0] if len(text or "") < 10_000 else False
        want[i, round(llr, 6), not failed and llr >= qu.THRESHOLD] += 1
    out = qu.quality_stats(odd_docs, labels).select("doc_id", "quality_rules.*").collect()
    assert Counter((x["doc_id"], round(x["llr"], 6), x["kept"]) for x in out) == want
