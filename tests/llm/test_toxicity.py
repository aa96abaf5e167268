import random
import zlib

import numpy as np

from corpusloom.llm import toxicity as tx


def test_isotonic_is_the_nearest_rising_function():
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y = r.permutation(12).astype(float), r.integers(0, 2, 12).astype(float)
        xs, ys = tx.isotonic(x, y)
        got = np.interp(np.sort(x), xs, ys)
        want = np.array([max(min(y[np.argsort(x)][i : j + 1].mean() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])
        assert np.allclose(got, want)


def test_trees_learn_a_rule_and_probabilities():
    r = np.random.default_rng(1)
    x = r.random((4000, len(tx.NAMES)))
    y = ((x[:, 1] > 0.6) ^ (x[:, 4] > 0.8)).astype(int)
    fold = np.arange(4000) % 5 == 0
    p = tx.fit(x, y, fold).score(x)
    assert ((p > 0.5) == y).mean() > 0.97 and p.min() >= 0 and p.max() <= 1


def corpus(n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "re", "th", "in", "er", "on", "es"]) for _ in range(r.randint(1, 5)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        if toxic := i % 4 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "zorgblat", "zorgbing", "moron"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out_of = lambda lab: {r["doc_id"]: r for r in tx.with_toxicity(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).withColumn("h", tx.held_out(d["doc_id"])).collect()}
    out = out_of(labels)
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r["h"]} == set(held)
    right = sum((out[i]["toxicity_score"] >= tx.DECISION) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    again = out_of(flipped)
    assert all(again[i]["toxicity_score"] == out[i]["toxicity_score"] for i in out)


def test_odd_rows(spark, odd_docs, clashing, no_docs, odd_rows, labels):
    for docs in (odd_docs, clashing):
        out = tx.with_toxicity(docs, labels).collect()
        assert len(out) == len(odd_rows) and all(0 <= r["toxicity_score"] <= 1 for r in out)
    assert tx.with_toxicity(odd_docs, labels.limit(0)).filter("toxicity_score != 0").count() == 0
    assert tx.with_toxicity(no_docs, labels).count() == 0


def test_features():
    lex = tx.Lexicon({"zorg": 3.0}, {})
    got = dict(zip(tx.NAMES, tx.features("You IDIOT!! 1d10t zorg sooooo far far far far from me s.t.u.p.i.d", lex)))
    assert got["insult_count"] == 1 and got["learned_count"] == 1 and got["near_you"] == 2
    assert got["undone_count"] == 2 and got["run_rate"] > 0 and got["exclaim_rate"] > 0
    assert tx.features(None, lex) == tx.features("", lex) == [0.0] * len(tx.NAMES)


def test_letter_runs():
    for text, want in (("", 0), ("aab", 0), ("aaa", 1), ("aaaa", 1), ("aaabbb", 2), ("aaa aaa", 2), ("111", 0), ("ééé", 0), ("xaaayyy zzz", 3)):
        assert tx.letter_runs(text) == want, text


def test_calibration_fold_is_unseen_and_ids_count_once(spark):
    docs, labels = corpus(300)
    d, lab = spark.createDataFrame(docs + [(0, "another text of an id"), (5, None)] * 3, "doc_id long, text string"), spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    rows = tx.training_rows(d, lab).collect()
    ids = [x["doc_id"] for x in rows]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert 0.1 < sum(x["fold"] for x in rows) / len(rows) < 0.35
    assert len(tx.training_rows(d, lab, 50).collect()) == 50
    marked = spark.createDataFrame([(x["doc_id"], x["text"] + (" foldword" * (x["toxic"] and x["fold"])), x["toxic"], x["fold"]) for x in rows], "doc_id long, text string, toxic int, fold boolean")
    assert "foldword" in tx.learn_lexicon(marked, support=1).words
    assert "foldword" not in tx.learn_lexicon(marked.filter("NOT fold"), support=1).words
    seen = {x["doc_id"]: x["text"] for x in rows}
    lex, _ = tx.train_model(marked.select("doc_id", "text"), lab)
    assert "foldword" not in lex.words and seen


def test_score_against_brute_force():
    """Trees walked node by node, steps interpolated by hand."""
    r = np.random.default_rng(5)
    x = r.random((1500, len(tx.NAMES)))
    y = (x[:, 2] + 0.3 * r.random(1500) > 0.7).astype(int)
    trees = tx.fit(x, y, np.arange(1500) % 5 == 0, rounds=12)
    for row, got in zip(x[:100], trees.score(x[:100]), strict=True):
        total = trees.prior
        for f, b, leaf in zip(trees.feature, trees.bin, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                right = sum(row[f[node]] > c for c in trees.cuts[f[node]]) > b[node]
                node = 2 * node + 2 if right else 2 * node + 1
            total += leaf[node - len(f)]
        below = [k for k, s in enumerate(trees.steps_x) if s <= total]
        if not below:
            want = trees.steps_y[0]
        elif below[-1] == len(trees.steps_x) - 1:
            want = trees.steps_y[-1]
        else:
            (a, c), (p, q) = trees.steps_x[below[-1] :][:2], trees.steps_y[below[-1] :][:2]
            want = p + (q - p) * (total - a) / (c - a)
        assert abs(got - min(1, max(0, want))) < 1e-9
