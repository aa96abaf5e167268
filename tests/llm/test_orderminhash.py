import random
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import orderminhash as om

from .conftest import DOCS, doc, words


def distance(a, b):
    """Edit distance by dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    """Of two texts, by their words; independent of the operator."""
    x, y = a.split(), b.split()
    return 1 - distance(x, y) / max(len(x), len(y)) if x and y else 0.0


def brute_classes(rows):
    """Connected components over all pairs of texts."""
    texts = sorted({r[1] or "" for r in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if abs(len(a.split()) - len(b.split())) <= 0.2 * max(len(a.split()), len(b.split())) and similarity(a, b) >= 0.8 - 1e-9:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for r in rows:
        ids[root(r[1] or "")].append(r[0])
    low = {t: min((i for i in got if i is not None), default=None) for t, got in ids.items()}
    return Counter((r[0], low[root(r[1] or "")]) for r in rows)


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randint(0, 9999)}"
    return " ".join(w)


def changed(words, edits, r):
    """``words`` after random substitutions, deletions and insertions."""
    w = list(words)
    for _ in range(edits):
        kind, at = r.random(), r.randrange(len(w))
        if kind < 0.5:
            w[at] = f"new{r.randint(0, 9999)}"
        elif kind < 0.75 and len(w) > 1:
            del w[at]
        else:
            w.insert(at, f"new{r.randint(0, 9999)}")
    return w


def test_alignment_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(400):
        a = [r.randint(0, 9) for _ in range(r.randint(1, 40))]
        b = changed(a, r.randint(0, 12), r) if r.random() < 0.8 else [r.randint(0, 9) for _ in range(r.randint(1, 40))]
        true = distance(a, b)
        for most in (0, 1, 3, 6, 10, 60):
            assert om.banded_distance(a, b, most) == (true if true <= most else None)
        near = 1 - true / max(len(a), len(b))
        assert abs(om.similarity(a, b) - (near if near >= 0.8 - 1e-9 else 0.0)) < 1e-12
    assert om.similarity([], []) == om.similarity([1], []) == 0.0


def test_alignment_of_long_texts():
    r = random.Random(2)
    a = [r.randint(0, 5000) for _ in range(30_000)]
    b = a[:]
    for at in r.sample(range(30_000), 4000):
        b[at] = -1
    assert om.similarity(a, b) == 1 - 4000 / 30_000
    assert om.similarity(a, a[:23_000]) == 0.0 and om.similarity(a, a[:25_000]) == 25 / 30


def test_recall_of_edited_copies(spark):
    """A sweep of 1 to 15 % edited words: at least nine of ten copies are found at every rate, and nothing else."""
    r, rows, rate = random.Random(3), [], {}
    for percent in range(1, 16):
        for _ in range(12):
            base = words(r.randint(60, 300), r.random()).split()
            rate[len(rows) // 2] = percent
            rows.append(doc(len(rows), " ".join(base)))
            rows.append(doc(len(rows), " ".join(changed(base, len(base) * percent // 100, r))))
    out = {x["doc_id"]: x["class_id"] for x in om.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(c in (i, i - 1) and (c == i or i % 2) for i, c in out.items())
    found = Counter(rate[i // 2] for i, c in out.items() if c != i)
    assert sum(found.values()) >= 0.95 * len(rate) and min(found[p] for p in range(1, 16)) >= 11


def test_sketches_follow_order():
    a = words(400, 3).split()
    near, turned = " ".join(a[:200] + ["x"] + a[200:]), " ".join(a[200:] + a[:200])
    same = lambda s, t: sum(x == y for x, y in zip(*om.sketches([s, t])["sketch"], strict=True))
    assert same(" ".join(a), near) >= 40 > same(" ".join(a), turned)
    assert [len(s) for s in om.sketches(["", None, " \n", "one", "a b\tc d e f"])["sketch"]] == [0, 0, 0, om.SKETCHES, om.SKETCHES]


def test_sketches_do_not_depend_on_their_neighbours():
    r = random.Random(7)
    texts = [words(r.choice([1, 3, 4, 5, 6, 7, 40, 400]), i) for i in range(200)] + ["a a a a a a a", words(100_000, 5)]
    together = om.sketches(texts)
    for t, n, s in zip(texts, together["n"], together["sketch"], strict=True):
        alone = om.sketches([t])
        assert n == alone["n"][0] == len(t.split()) and (s == alone["sketch"][0]).all()


def test_sketch_by_its_definition():
    """The shingles taken are the two of least hash, in text order; equal shingles differ by occurrence."""
    for text in ("a b c d e f g h", "x y x y x y x y x y x y z"):
        w = om.words_of(text)
        plain = [np.uint64(0)] * (len(w) - 4)
        for i in range(len(plain)):
            h = np.zeros(1, np.uint64)
            for x in w[i : i + 5]:
                h = om._mix(h ^ np.uint64(om.xxh64_intdigest(x)))
            plain[i] = h[0]
        for s, got in enumerate(om.sketches([text])["sketch"][0]):
            labelled = [om._mix(np.array([(int(p) + plain[:i].count(p) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0] for i, p in enumerate(plain)]
            rank = [(int(x ^ om._SEEDS[s]) * int(om._FACTORS[s])) % 2**64 for x in labelled]
            value = om._SEEDS[s]
            for at in sorted(sorted(range(len(rank)), key=rank.__getitem__)[:2]):
                value = om._mix(np.array([value ^ plain[at]], np.uint64))[0]
            assert np.int64(got) == value.astype(np.int64)


def test_classes_against_brute_force(spark):
    r = random.Random(8)
    rows, n = [], 0
    for f in range(12):
        base = words(r.randint(6, 160), 100 + f)
        for k in range(r.choice([1, 2, 3, 9])):
            rows.append(doc(n, base if k < 2 else edited(base, r.randint(1, 3), r)))
            n += 1
    out = om.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, out)) == brute_classes(rows)


def test_large_family_of_copies(spark):
    r = random.Random(9)
    base = words(150, 77)
    rows = [doc(i, base if i % 3 == 0 else edited(base, r.randint(0, 2), r)) for i in range(400)]
    out = om.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {x["class_id"] for x in out} == {0}


def around_passage(shared, sizes, seed, families=12, others=150):
    """Texts of one passage and ``sizes`` own words. Ids of a family follow each other."""
    r, passage, rows = random.Random(seed), words(shared, seed), []
    own = lambda k: " ".join(f"own{r.randint(0, 10**9)}" for _ in range(k))
    for _ in range(families):
        tail = own(r.choice(sizes)).split()
        for _ in range(2):
            rows.append(doc(len(rows), passage + " " + " ".join(tail[: len(tail) // 2]) + " " + own(len(tail) - len(tail) // 2)))
    return rows + [doc(len(rows) + i, passage + " " + own(r.choice(sizes))) for i in range(others)]


def test_last_pairs_are_all_that_can_be_similar(spark):
    rows = around_passage(100, [56, 60, 64], 5, others=40)
    true = {(a, b) for a in range(len(rows)) for b in range(a) if om.similarity(rows[a][1].split(), rows[b][1].split())}
    name = lambda i: b"%04d" % i
    texts = spark.createDataFrame([(name(i), r[1]) for i, r in enumerate(rows)], "key binary, text string")

    def met(values, root, count):
        opened = [(v, name(i), len(r[1].split()), 1, root(i), count) for i, r in enumerate(rows) for v in values]
        opened = spark.createDataFrame(opened, "value long, key binary, n long, degree long, root binary, texts long")
        if count <= om.SMALL:
            return {(int(x["a"]), int(x["b"])) for x in om._small_pairs(opened).collect()}
        groups = spark.createDataFrame([(name(i), root(i)) for i in range(len(rows))], "node binary, root binary")
        out = om._meetings(om._posts(opened, texts), groups).collect()
        assert len(set(out)) == len(out) or len(values) > 1  # once a cluster
        return {(int(x["a"]), int(x["b"])) for x in out}

    everyone = met([1, 2], name, len(rows))  # one hot bucket, or two
    assert {(2 * i + 1, 2 * i) for i in range(12)} <= true <= everyone
    assert len(everyone) < len(rows) ** 2 / 20
    family = met([1], lambda i: b"f" if i < 24 else name(i), len(rows))
    assert {p for p in true if p[0] >= 24} <= family and all(a >= 24 for a, b in family)
    near_in_size = {(a, b) for a in range(len(rows)) for b in range(a) if 5 * min(n := [len(rows[x][1].split()) for x in (a, b)]) >= 4 * max(n)}
    assert met([1], name, om.SMALL) == near_in_size  # a small bucket is compared pair by pair


def test_counts_of_words_do_not_grow_with_the_words(spark, monkeypatch):
    """A task reports as many counts as there are cells at most, and any order of words meets all pairs."""
    rows = around_passage(100, [56, 60, 64], 6, others=60)
    true = {(a, b) for a in range(len(rows)) for b in range(a) if om.similarity(rows[a][1].split(), rows[b][1].split())}
    name = lambda i: b"%04d" % i
    texts = spark.createDataFrame([(name(i), r[1]) for i, r in enumerate(rows)], "key binary, text string")
    opened = spark.createDataFrame([(1, name(i), len(r[1].split()), 1, name(i), len(rows)) for i, r in enumerate(rows)], "value long, key binary, n long, degree long, root binary, texts long")
    groups = spark.createDataFrame([(name(i), name(i)) for i in range(len(rows))], "node binary, root binary")
    plain, made = type(texts).mapInPandas, []

    def watched(df, f, schema):
        out = plain(df, f, schema)
        if f.__name__ == "counted":
            made.append((out.count(), df.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(type(texts), "mapInPandas", watched)
    for bits in (1, 6, 16):
        monkeypatch.setattr(om, "CELLS_LOG2", bits, raising=False)
        found = {(int(x["a"]), int(x["b"])) for x in om._meetings(om._posts(opened, texts), groups).collect()}
        assert {(2 * i + 1, 2 * i) for i in range(12)} <= true <= found
        counts, tasks = made.pop()
        assert 0 < counts <= tasks << bits


def test_families_around_a_passage(spark):
    rows = around_passage(100, [56, 60, 64], 5)
    out = {x["doc_id"]: x["class_id"] for x in om.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {r[0]: r[0] - r[0] % 2 if r[0] < 24 else r[0] for r in rows}


def test_odd_rows_and_keep_one(spark, odd_docs, clashing, no_docs, odd_rows):
    want = brute_classes([x for x in odd_rows if len(x[1] or "") < 10_000])
    for docs in (odd_docs, clashing):
        out = om.near_duplicates(docs).collect()
        assert len(out) == len(odd_rows)
        assert Counter(tuple(x) for x in out if x["doc_id"] != 7) == want
        kept = om.keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({c for _, c in want}) + 1
    assert om.near_duplicates(no_docs).count() == 0 and om.keep_one(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(f"{a:03}", f"{b:03}") for a, b in ((r.randint(0, 150), r.randint(0, 150)) for _ in range(90))] + [("h000", f"h{i:03}") for i in range(1, 300)]
    pairs = [p for p in pairs if p[0] != p[1]]
    parent = {}

    def root(x):
        return x if parent.setdefault(x, x) == x else root(parent[x])

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = om.components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert len(got) == len({g["node"] for g in got})
    assert {g["node"]: g["root"] for g in got} == {x: root(x) for p in pairs for x in p}
