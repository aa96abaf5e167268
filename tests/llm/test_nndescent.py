import math

import numpy as np
import pytest

from corpusloom.llm import nndescent as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, wanted=20, every=20):
    good = {}
    for i, e, *_ in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = [float(np.float32(x)) for x in e]
            good[i] = min(good.get(i, v), v)
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    out = {}
    for q in ids:
        if q % every == 0:
            s = x @ np.array(good[q])
            out[q] = sorted(((-a, i) for a, i in zip(s, ids) if i != q))[:wanted]
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        near = {r["vec_id"] for r in got if r["query_id"] == q}
        hit += len(near & {i for _, i in best})
        total += len(best)
    return hit / total


def check_form(got, rows):
    vec = {i: e for i, e, *_ in rows}
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append(r)
        assert r["vec_id"] != r["query_id"]
    for q, rs in per.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        keys = [(-r["score"], r["vec_id"]) for r in rs]
        assert keys == sorted(keys)
    return per, vec


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    got = nn.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    check_form(got, rows)
    want = brute(rows)
    assert len(got) == 20 * len(want)
    assert recall(got, want) >= 0.95
    for row in got[:200]:
        exact = float(np.dot(np.array(rows[row["query_id"]][1], np.float64), np.array(rows[row["vec_id"]][1], np.float64)))
        assert abs(row["score"] - exact) < 1e-12


def test_lengths_matter(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 12)) * r.uniform(0.2, 3, size=(1500, 1))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    assert recall(nn.nearest(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows)) >= 0.9


def test_copies_and_odd_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, x[i if i % 3 else 0].tolist(), 0) for i in range(300)]
    bad = [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 8, 0), (1060, [float("nan")] * 8, 0), (1080, [None] * 8, 0), (1100, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (1120, [float("inf")] * 8, 0)]
    table = spark.createDataFrame(rows + bad, SCHEMA)
    for extra in (table, table.selectExpr("*", "1 AS node", "2 AS u", "'x' AS vec", "0 AS score")):
        got = nn.nearest(extra).collect()
        per, _ = check_form(got, rows)
        assert set(per) == {i for i in range(0, 300, 20)}
        want = brute(rows)
        for q, best in want.items():
            assert np.allclose([row["score"] for row in per[q]], [-s for s, _ in best])
        copies = [row["vec_id"] for row in per[0]]
        assert copies[:3] == [3, 6, 9]


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows(spark, n):
    rows = [(i * 20, [float(i + 1), 1.0], 0) for i in range(n)]
    got = nn.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == n * (n - 1)
    want = brute(rows)
    per, _ = check_form(got, rows)
    assert all([r["vec_id"] for r in per[q]] == [i for _, i in want[q]] for q in per)


def test_free_queries_start_anywhere(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    members, nodes = nn.build_nodes(nn.valid_vectors(table))
    edges, blocks = nn.build_graph(nodes)
    q = r.normal(size=(5, 8)).astype(np.float32)
    queries = spark.createDataFrame([(k, bytes(np.r_[v, np.float32(0)].tobytes())) for k, v in enumerate(q)], "q long, vec binary")
    ids = {m["node"]: m["vec_id"] for m in members.select("node", "vec_id").collect()}
    found = nn.search(queries, nodes, edges, blocks).collect()
    for k, v in enumerate(q):
        best = sorted((f for f in found if f["q"] == k), key=lambda f: -f["score"])[:10]
        assert len({ids[f["node"]] for f in best} & set(np.argsort(-(x @ v))[:10].tolist())) >= 9


def test_adjacency_is_bounded():
    import pandas as pd

    lists = pd.DataFrame({"owner": [1] * 500 + [2, 2, 2], "member": [*range(2, 502), 3, 3, 4], "new": True, "back": [False] * 5 + [True] * 495 + [False, True, True]})
    got = nn._adjacent(32)(lists)
    near = dict(zip(got["owner"], got["near"], strict=True))
    assert len(near[1]) == 37 and set(range(2, 7)) <= set(near[1]) and sorted(near[2]) == [3, 4]
