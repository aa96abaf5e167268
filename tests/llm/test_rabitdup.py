import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import rabitdup as rd

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(e):
    return bool(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)


def brute(rows, similar=rd.SIMILAR):
    """All pairs, vector by vector."""
    best = {}
    for i, e, *_ in rows:
        if i is not None:
            e = [float(np.float32(x)) for x in e] if usable(e) else None
            old = best.get(i)
            best[i] = e if old is None else old if e is None else min(old, e)
    near = {i: set() for i in best}
    for i, j in combinations(sorted(k for k in best if best[k]), 2):
        x, y = np.array(best[i]), np.array(best[j])
        if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= similar:
            near[i].add(j)
            near[j].add(i)
    least = {}
    for i in sorted(near):
        todo = [] if i in least else [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += near[k]
    out = [(i, len(near[i]), least[i], least[i] == i) for i in near]
    return sorted(out + [(None, 0, None, True) for r in rows if r[0] is None], key=repr)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def families(n, dim, seed, noise=0.03):
    """Random vectors and edited copies of some, with chains that fade out."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = list(x)
    for k in range(0, n, 7):
        v = x[k]
        for _ in range(int(r.integers(1, 6))):
            v = v + noise * r.normal(size=dim)
            out.append(v * r.uniform(0.1, 30))
    return [(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(out)]


def test_codes_estimate_without_bias():
    r = np.random.default_rng(3)
    x = rd.unit_rows([v.tobytes() for v in r.normal(size=(4000, 64))])
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * side
    a, b = (rd.encode(v, 256) for v in (x, y))
    a, b = (rd.decode(bits, f, 64) for bits, f in (a, b))
    estimate = ((a[0] * b[1]).sum(axis=1) + (a[1] * b[0]).sum(axis=1)) / 2
    assert abs(estimate.mean() - 0.9) < 0.003
    fx, fy = rd.encode(x, 256)[1], rd.encode(y, 256)[1]
    sigma = rd.deviations(fx[:500], fy[:500], 256).diagonal()
    assert (estimate[:500] >= 0.9 - rd.SURE * sigma).all()
    assert estimate.std() < sigma.mean() < 2.5 * estimate.std()  # a bound, and no wide one
    far = (a[0] * np.roll(b[1], 1, axis=0)).sum(axis=1)
    assert (far < 0.9 - rd.SURE * sigma.mean()).mean() > 0.999


def test_bands_follow_the_number_of_vectors():
    assert (rd.Bands(0).bits, rd.Bands(100).number) == (0, 1)
    for n in (1000, 51_282, 10**9):
        bands = rd.Bands(n)
        p = 1 - math.acos(0.9) / math.pi
        assert (1 - p**bands.bits) ** bands.number <= rd.MISSED
        assert n / 2**bands.bits <= rd.LOAD
        chosen = rd._choice(2 * bands.width(64), bands.bits, bands.number)
        assert chosen.shape == (bands.number, bands.bits)
        assert np.bincount(chosen.ravel()).max() <= 9


def test_pairs_at_the_threshold_share_a_band():
    r = np.random.default_rng(5)
    x = rd.unit_rows([v.tobytes() for v in r.normal(size=(3000, 64))])
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.901 * x + math.sqrt(1 - 0.901**2) * side
    for n in (51_282, 10**8):
        bands = rd.Bands(n)
        keys = [bands.keys(rd.encode(v, bands.width(64))[0], bands.number) for v in (x, y)]
        assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.99


@pytest.mark.parametrize("part", [rd.PART, 20])
def test_against_brute_force(spark, part):
    rows = families(700, 48, 1)
    rows += [(5000 + i, rows[i % 3][1], 0) for i in range(60)]  # equal vectors
    r = np.random.default_rng(2)
    rows += [(9000 + i, [float(np.float32(a)) for a in rows[10][1] + 0.02 * r.normal(size=48)], 0) for i in range(90)]  # one family
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, out = brute(rows), got(rd.near_vectors(df, part=part))
    assert [x[0] for x in out] == [x[0] for x in want]
    linked = sum(x[1] for x in want)
    assert linked > 9000 and all(a[1] <= b[1] for a, b in zip(out, want, strict=True))  # no link below the threshold
    assert sum(x[1] for x in out) >= 0.999 * linked
    assert sum(a != b for a, b in zip(out, want, strict=True)) <= 5


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0),
        (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (None, [1.0, 0.0], 0), (None, None, 0), (10, [1.0, -0.0], 0),
        (11, [0.0, 1.0], 0), (11, [1.0, 0.0], 0), (12, [1.0, 0.1], 0), (13, [-1.0, 0.0], 0), (14, [1e30, 1e30], 0), (15, [1e-30, 1e-30], 0), (16, None, 0), (16, [0.0, 5.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(rd.near_vectors(df)) == want
    for name in ("node", "bits", "weight", "dim", "band", "key", "part", "low", "high", "root", "n_links", "kept", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(rd.near_vectors(df)) == want
    assert got(rd.near_vectors(df.filter("false"))) == []
    assert got(rd.near_vectors(df.filter("vec_id = 4"))) == [(4, 0, 4, True)]


def test_chains_are_one_component(spark):
    angle = math.radians(20)  # neighbours are linked, others are not
    rows = [(17 - k, [math.cos(k * angle), math.sin(k * angle)], 0) for k in range(15)]
    assert got(rd.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
