import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import packing as pk
from corpusloom.llm.bpe import vocabulary_path

from .test_bpe import fuzz

tokenizers = pytest.importorskip("tokenizers")
NAME = "word_bpe_49k.json"


def fewest(items, capacity):
    """Exact bin packing of a few items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def layout(rows, counts):
    """Places of all pieces, as the lookup in Spark reads the plan."""
    out = defaultdict(list)
    for n, c in counts.items():
        for r in range(c):
            seg = [s for s in rows.tolist() if s[0] == n and s[1] <= r][-1]
            out[seg[3] + (r - seg[1]) // seg[2]].append((seg[4] + (r - seg[1]) % seg[2] * n, n))
    return out


def test_reduction_never_loses_and_plan_is_tight():
    r, worse = random.Random(1), 0
    for _ in range(600):
        capacity = r.choice([10, 20, 37])
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        counts = dict(Counter(items))
        best = fewest(items, capacity)
        fixed, left = pk.reduce_dominated(counts, capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for t, _ in fixed) + fewest(rest, capacity) == best
        rows, used = pk.plan(counts, capacity)
        bins = layout(rows, counts)
        assert len(bins) == used >= best
        worse += used > best
        for got in bins.values():
            at = 0
            for offset, n in sorted(got):
                assert offset == at
                at += n
            assert at <= capacity
    assert worse < 12


def test_plan_is_small_for_any_number_of_pieces():
    r = np.random.default_rng(0)
    x = np.clip(r.lognormal(6.2, 0.9, 2_000_000).astype(int), 1, 2048)
    counts = dict(zip(*[a.tolist() for a in np.unique(x, return_counts=True)]))
    rows, used = pk.plan(counts)
    assert len(rows) < 20_000 and used < 1.01 * x.sum() / 2048


def test_words_equal_the_library():
    own, library = pk.Words(vocabulary_path(NAME)), tokenizers.Tokenizer.from_file(vocabulary_path(NAME))
    texts = [*fuzz(8000, 3), "<|startoftext|>a b", "<|STARTOFTEXT|> A", "Σας ΣΑΣ σΣ", "it's IT'S can't'll", "é É", "Å Ω"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == want


def test_odd_rows(spark, odd_docs, clashing, no_docs, odd_rows):
    library = tokenizers.Tokenizer.from_file(vocabulary_path(NAME))
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    for docs in (odd_docs, clashing):
        out = pk.pack_documents(docs).collect()
        assert Counter(tuple(r)[:5] for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for got in bins.values():
            at = 0
            for offset, n in sorted(got):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(bins) == len({r["sequence_id"] for r in out}) <= -(-sum(r["length"] for r in out) // 2048) + 1
    assert pk.pack_documents(no_docs).count() == 0


def test_one_length_is_numbered_in_buckets(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same words here' AS text")
    out = pk.pack_documents(docs).collect()
    per = Counter(r["sequence_id"] for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 5000 and max(per.values()) == 2048 // out[0]["length"]
