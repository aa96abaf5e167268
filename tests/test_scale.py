"""Shards and random access, array files, permutations, near duplicates and next fit, against brute force."""

import io
import os
import random
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import blocks, bloom, ordering, permutation, tables
from corpusloom.operators import chat, curation, mixture, neardup, packing
from corpusloom.plans.incremental import CleanStore
from corpusloom.sources import npy
from corpusloom.sources.shards import ShardStore

# --- shards --------------------------------------------------------------------------------------------------------


def filled(spark, path, sizes=(25, 0, 7), shard=10):
    store, at = ShardStore(spark, str(path)), 0
    for n in sizes:
        rows = spark.range(at, at + n).select((1000 - F.col("id")).alias("key"), F.concat(F.lit("v"), F.col("id")).alias("value"))
        store.append(rows.withColumn("order", F.lit(0)).select("order", "key", "value"), ("order", "key"), shard)
        at += n
    return store


def values(n_first=25, n_second=7):
    """The rows of :func:`filled` in order: keys fall, so the last come first in each batch."""
    return [f"v{i}" for i in reversed(range(n_first))] + [f"v{i}" for i in reversed(range(n_first, n_first + n_second))]


def test_shards_are_numbered_on(spark, tmp_path):
    store = filled(spark, tmp_path)
    got = [(r["shard_id"], r["rows"], r["start"], r["stop"]) for r in store.manifest().orderBy("shard_id").collect()]
    assert got == [(0, 10, 0, 10), (1, 10, 10, 20), (2, 5, 20, 25), (3, 7, 25, 32)] and store.total() == 32


def test_rows_are_found_by_index(spark, tmp_path):
    store, want = filled(spark, tmp_path), values()
    asked = [0, 31, 9, 10, 24, 25, 32, 100, -1, -33, 5, 5, None]
    wanted = spark.createDataFrame([(i, "mine", "x") for i in asked], "idx long, value string, shard_id string")  # clashing names
    got = store.locate(wanted)
    assert set(got.columns) == {"idx", "value", "shard_id", "row_in_shard", "order", "key"}
    assert sorted((r["idx"], r["key"], r["value"], r["shard_id"]) for r in got.collect()) == sorted((i, 1000 - int(want[i % 32][1:]), "mine", "x") for i in asked if i is not None)
    plain = store.locate(spark.createDataFrame([(i,) for i in range(64)], "idx long"))
    assert [r["value"] for r in plain.orderBy("idx").collect()] == want * 2


def test_only_asked_shards_are_opened(spark, tmp_path):
    store, want = filled(spark, tmp_path), values()
    for folder, _, names in os.walk(tmp_path / "data"):
        for name in names:
            if "shard_id=1" not in folder and not name.startswith("_"):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"broken")
    got = store.locate(spark.createDataFrame([(12,), (17,)], "idx long")).orderBy("idx").collect()
    assert [r["value"] for r in got] == [want[12], want[17]]


def test_what_a_lost_job_leaves_is_not_read(spark, tmp_path):
    store, want = filled(spark, tmp_path), values()
    spark.createDataFrame([(0, 0, "ghost", 12, 2)], "order int, key long, value string, shard_id long, row_in_shard long").write.partitionBy("shard_id").parquet(str(tmp_path / "data/batch=lost"))
    got = store.locate(spark.range(40).withColumnRenamed("id", "idx"))
    assert {r["value"] for r in got.collect()} == set(want)
    assert ShardStore(spark, str(tmp_path / "none")).locate(spark.range(3).withColumnRenamed("id", "idx")).collect() == []


def test_written_tables_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path / "shared"))
    left = lambda: os.listdir(tmp_path / "shared/corpusloom")
    with tables.tables_of(spark):
        docs = spark.createDataFrame([(i, [i] * 5) for i in range(20)], "doc_id long, ids array<int>")
        assert packing.pack(docs, 16).count() == 8 and left()
        with tables.tables_of(spark):
            chat.next_fit_bins(docs.select(F.col("doc_id").alias("conv_id"), F.lit(3).alias("length")), 7).collect()
    assert left() == []
    filled(spark, tmp_path / "store")
    CleanStore(spark, str(tmp_path / "clean")).add(spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string"), "b")
    assert left() == []


# --- permutations --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 255, 1000, 4097])
def test_permutation_is_one(n):
    x = np.arange(n)
    y = permutation.permuted(x, n, "e")
    assert sorted(y.tolist()) == x.tolist()
    assert permutation.permuted(y, n, "e", True).tolist() == x.tolist()
    assert n < 100 or y.tolist() != x.tolist() != permutation.permuted(x, n, "f").tolist()


def test_permutation_spreads():
    y = permutation.permuted(np.arange(40_000), 40_000, 9)
    assert abs(np.corrcoef(np.arange(40_000), y)[0, 1]) < 0.02
    assert abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.02
    big = permutation.permuted(np.arange(10**12, 10**12 + 1000), 10**13, 9)
    assert len(set(big.tolist())) == 1000 and (big < 10**13).all() and permutation.permuted(big, 10**13, 9, True)[0] == 10**12


def test_permutation_of_columns(spark, tmp_path):
    df = spark.createDataFrame([(None,), (-1,), (0,), (4,), (5,)], "i long")
    got = [r[0] for r in df.select(permutation.permutation(F.col("i"), 5, 1)).collect()]
    assert got[0] is got[1] is got[4] is None and got[2] == permutation.permuted(np.array([0]), 5, 1)[0]
    store, want = filled(spark, tmp_path), values()
    ranks = permutation.permuted(np.arange(32), 32, "s").tolist()
    rows = mixture.epoch_slice(store, 8, 16, "s").orderBy("rank").collect()
    assert [r["value"] for r in rows] == [want[ranks.index(k)] for k in range(8, 16)]
    assert mixture.epoch_slice(store, 30, 99, "s").count() == 2 and mixture.epoch_slice(store, 32, 99, "s").count() == 0


# --- array files ---------------------------------------------------------------------------------------------------


def save(path, array):
    with open(path, "wb") as f:
        np.save(f, array)


def read(spark, path, **options):
    return {(os.path.basename(r["file"]), r["row"]): list(r["ids"]) for r in npy.scan_token_arrays(spark, str(path), **options).collect()}


def test_arrays_are_read_in_slices(spark, tmp_path):
    a = np.arange(70, dtype=np.uint32).reshape(10, 7)
    save(tmp_path / "a.npy", a)
    save(tmp_path / "b.npy", np.asfortranarray(a + 100))
    save(tmp_path / "c.npy", np.arange(11, dtype=np.uint16))
    save(tmp_path / "d.npy", np.zeros((0, 7), np.uint32))
    save(tmp_path / "e.npy", np.array([{}], dtype=object))
    (tmp_path / "f.npy").write_bytes(b"no array")
    (tmp_path / "g.txt").write_bytes(b"other")
    want = {("a.npy", i): a[i].tolist() for i in range(10)} | {("b.npy", i): (a[i] + 100).tolist() for i in range(10)}
    one = {("c.npy", 0): list(range(11))}
    for rows in (1, 3, 10, 4096):
        assert read(spark, tmp_path, slice_rows=rows) == want | one
    assert read(spark, tmp_path, length=4) == want | {("c.npy", 0): [0, 1, 2, 3], ("c.npy", 1): [4, 5, 6, 7], ("c.npy", 2): [8, 9, 10]}
    assert read(spark, tmp_path, width=7) == want
    assert read(spark, tmp_path, width=8) == {}
    df = npy.scan_token_arrays(spark, str(tmp_path / "a.npy"), slice_rows=3)
    assert df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="FileNotFoundError"):
        read(spark, tmp_path / "none")


def test_filters_leave_out_slices(spark, tmp_path):
    save(tmp_path / "a.npy", np.arange(40, dtype=np.uint32).reshape(20, 2))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = npy.scan_token_arrays(spark, str(tmp_path), slice_rows=4)
        assert df.filter("row = 9").rdd.getNumPartitions() == 1
        assert [list(r["ids"]) for r in df.filter("row = 9").collect()] == [[18, 19]]
        assert sorted(r["row"] for r in df.filter("row > 6 AND row <= 12").collect()) == list(range(7, 13))
        assert df.filter("row > 6 AND row <= 12").rdd.getNumPartitions() == 3
        assert df.filter("row IN (3, 19)").count() == 2 and df.filter("row > 100").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("save_as", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save_as):
    ids = np.arange(30, dtype=np.uint32).reshape(6, 5)
    save_as(tmp_path / "a.npz", input_ids=ids, loss_mask=(ids % 2).astype(np.uint8))
    save_as(tmp_path / "b.npz", input_ids=ids)
    save_as(tmp_path / "c.npz", input_ids=ids, loss_mask=ids[:3])
    with zipfile.ZipFile(tmp_path / "d.npz", "w") as z:
        z.writestr("input_ids.npy", b"broken")
    df = npy.scan_token_arrays(spark, str(tmp_path), ("input_ids", "loss_mask"), glob="*.npz", slice_rows=4)
    rows = df.orderBy("row").collect()
    assert [list(r["input_ids"]) for r in rows] == ids.tolist() and [list(r["loss_mask"]) for r in rows] == (ids % 2).tolist()
    assert df.rdd.getNumPartitions() == (2 if save_as is np.savez else 1)


def sequences(spark, n=23, width=3, size=5):
    rows = [(i // size, i % size, [i] * width) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "shard_id long, row_in_shard long, input_ids array<int>")


def test_shards_are_written(spark, tmp_path):
    npy.write_token_shards(sequences(spark), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"train_shard_{i:04d}.npy" for i in range(5)]
    got = np.concatenate([np.load(tmp_path / f"train_shard_{i:04d}.npy") for i in range(5)])
    assert got.dtype == np.uint32 and got.tolist() == [[i] * 3 for i in range(23)]
    npy.write_token_shards(sequences(spark, 7), str(tmp_path))  # replaces all
    npy.write_token_shards(sequences(spark, 4), str(tmp_path), "val")
    assert sorted(os.listdir(tmp_path)) == ["train_shard_0000.npy", "train_shard_0001.npy", "val_shard_0000.npy"]
    with pytest.raises(Exception, match="written twice"):
        npy.write_token_shards(sequences(spark, 4), str(tmp_path), overwrite=False)
    assert len(os.listdir(tmp_path)) == 3


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    good = sequences(spark)
    for bad, why in (
        (good.filter("NOT (shard_id = 2 AND row_in_shard = 1)"), "dense"),
        (good.unionByName(good.limit(1)), "dense"),
        (good.withColumn("input_ids", F.when((F.col("shard_id") == 3) & (F.col("row_in_shard") == 2), F.array(F.lit(1))).otherwise(F.col("input_ids"))), "one width"),
        (good.withColumn("input_ids", F.when((F.col("shard_id") != 3) | (F.col("row_in_shard") != 2), F.col("input_ids"))), "no tokens"),
    ):
        with pytest.raises(Exception, match=why):
            npy.write_token_shards(bad, str(tmp_path / "x"))
        assert not os.path.exists(tmp_path / "x") or os.listdir(tmp_path / "x") == []


def test_headers_are_what_numpy_reads():
    a = np.arange(12, dtype=np.int64).reshape(3, 4)
    f = io.BytesIO()
    np.save(f, a)
    f.seek(0)
    [at] = npy.layouts(f, "a.npy", ["ids"], None)
    assert (at.rows, at.width, at.last) == (3, 4, 4) and npy._sought(f, at, 1, 3).tolist() == list(range(4, 12))


# --- near duplicates -----------------------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    near = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out, seen = [], set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += near[k]
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], len(near[k]), min(ids) if ids else None) for k in group]
    return sorted(out, key=repr)


def corpus(seed=6):
    r = random.Random(seed)
    fresh = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    passage, texts = fresh(120), []
    for _ in range(20):
        tail = fresh(40)
        texts += [passage + tail[:30] + fresh(10) for _ in range(3)]
    base = fresh(300)
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randint(0, 299)] = "edited"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_minhash_classes_against_brute_force(spark):
    texts = corpus()
    rows = list(enumerate([*texts, texts[0], texts[3], "a b", "a b", "a b c"]))
    rows += [(None, texts[100]), (None, texts[5]), (7, texts[7]), (500, None), (501, ""), (502, " \n "), (None, None), (503, "only once " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_classes(rows)
    for part in (neardup.PART, 9):
        out = neardup.near_classes(df, part=part).collect()
        got = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in out), key=repr)
        linked = sum(x[1] for x in want)
        assert len(got) == len(want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
        assert sum(x[1] for x in got) >= 0.95 * linked > 3000
        assert sum(a != b for a, b in zip(got, want, strict=True)) < 0.2 * len(want)
        kept = defaultdict(int)
        for r in out:
            kept[r["class_id"]] += r["kept"]
        assert all(n == 1 for c, n in kept.items() if c is not None)
    clashing = df.withColumns({c: F.lit("clash") for c in ("id", "row", "node", "band", "key", "part", "n", "class", "bits", "root")})
    kept = neardup.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r["kept"] for r in out)
    assert neardup.near_classes(df.filter("false")).collect() == []


def test_bands_meet_as_computed():
    r = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        both, a, b = (r.integers(-(2**62), 2**62, n) for n in (160, 20, 20))  # 160 of 200
        keys = neardup.band_keys([np.r_[both, a], np.r_[b, both]])
        hits += (keys[0] == keys[1]).any()
    assert 0.9 < hits / 300 <= 0.99
    long = [r.integers(-(2**62), 2**62, n) for n in (1, 40_000, 3, 70_000)]
    assert (neardup.band_keys(long) == np.concatenate([neardup.band_keys([s]) for s in long])).all()


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(25)] + [(7, 7), (500, 501), (501, 500)]
    got = {x["node"]: x["root"] for x in blocks.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for i in sorted(near):
        todo = [] if i in want else [i]
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = i
                todo += near[k]
    assert got == want
    assert blocks.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- next fit and order --------------------------------------------------------------------------------------------


def tokens_of(seqs):
    return sorted(t for s in seqs for t in s if t)


@pytest.mark.parametrize("rows_of_range", [ordering.ROWS, 9])
def test_next_fit_keeps_every_token_once(spark, monkeypatch, rows_of_range):
    monkeypatch.setattr(ordering, "ROWS", rows_of_range)
    r, at = random.Random(2), 0
    rows = []
    for i in [1, 1, None, 2, None, None, 3, 3, 3, *[5] * 40, *range(6, 30)]:
        n = r.choice([1, 3, 8, 8, 20])
        rows.append((i, list(range(at + 1, at + n + 1)), [7] * n))
        at += n
    rows += [(2, rows[3][1], rows[3][2]), (40, [], []), (41, None, None), (42, [at + 1, at + 2], None)]
    df = spark.createDataFrame(rows, "conv_id long, input_ids array<int>, labels array<int>")
    got = chat.pack_next_fit(df, 10).collect()
    assert tokens_of(x["input_ids"] for x in got) == sorted(t for _, ids, _ in rows for t in (ids or [])[: 10 if len(ids or []) > 10 else None])
    assert sorted(x["seq_id"] for x in got) == list(range(len(got)))
    assert all(len(x["input_ids"]) == len(x["labels"]) == 10 for x in got)
    first = next(x for x in got if x["seq_id"] == 0)
    assert any(list(first["input_ids"])[: len(ids)] == ids[:10] for i, ids, _ in rows if i is None)
    again = chat.pack_next_fit(df.repartition(5), 10).collect()  # equal rows of equal ids: the order does not hang on files
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_ranges_split_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 50)
    r = random.Random(8)
    rows = [(r.choice([None, 1, 1, 1, 2, 9]), f"t{r.randint(0, 10**6)}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, t string, i long")
    got = ordering.row_index(df, "k", "at", ties=("t", "i")).orderBy("at").collect()
    assert [(x["k"], x["t"], x["i"]) for x in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    sizes = df.groupBy(ordering.range_bucket(df, "k", ("t",)).alias("b")).count().collect()
    assert len(sizes) > 20 and max(x["count"] for x in sizes) < 400


def test_pack_over_ranges(spark, monkeypatch):
    docs = [(i % 17, i, [i] * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, tie long, ids array<int>")
    flat = [t for _, _, ids in sorted(docs) for t in [1, *ids, 2]]
    want = [flat[k : k + 16] for k in range(0, len(flat) // 16 * 16, 16)]
    for rows in (ordering.ROWS, 40):
        monkeypatch.setattr(ordering, "ROWS", rows)
        assert [list(x["input_ids"]) for x in packing.pack(df, 16, ties=("tie",)).orderBy("seq_id").collect()] == want


# --- curation in batches -------------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, text string"


def prose(i):
    return f"Some words of document number {i} that go on and on for long enough to pass. " * 4


def test_batches_keep_what_one_run_keeps(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), r.choice([prose(r.randint(0, 60)), "short", "", None])) for i in range(400)]
    rows += [(7, "a", prose(7)), (7, "a", prose(7)), (None, "b", prose(1000)), (None, "b", prose(1000))]
    df = spark.createDataFrame(rows, DOCS)
    one = curation.curate(df).select("source", "text").collect()
    for words in (1, 64, 1 << 20):  # a full filter only sends more keys to the join
        store = CleanStore(spark, str(tmp_path / f"store-{words}"), words)
        cuts = [df.filter("doc_id < 150 OR doc_id IS NULL"), df.filter("doc_id >= 150 AND doc_id < 160"), df.filter("false"), df.filter("doc_id >= 160"), df]
        for k, part in enumerate(cuts):
            counts = store.add(part, f"b{k}")
            assert counts["n_read"] == counts["quality_fail"] + counts["dup_inside"] + counts["dup_before"] + counts["n_kept"]
        got = store.clean(df.schema).select("source", "text").collect()
        assert sorted(got, key=repr) == sorted(one, key=repr)
        assert store.add(df, "b0")["n_kept"] == store.batches().filter("batch = 'b0'").first()["n_kept"]  # it is there
        assert [x["n_kept"] for x in store.batches().orderBy("number").collect()][-1] == 0
    (tmp_path / "store-64/clean/lost").mkdir()
    df.limit(5).write.mode("overwrite").parquet(str(tmp_path / "store-64/clean/lost"))
    assert CleanStore(spark, str(tmp_path / "store-64"), 64).clean(df.schema).count() == len(one)


def test_a_filter_never_says_no_to_an_old_key(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    seen = bloom.build(keys, "key", 1024)
    assert bloom.maybe_seen(keys, "key", seen, words=1024).filter("NOT maybe").isEmpty()
    other = spark.range(3000, 23_000).selectExpr("concat('k', id) AS key")
    share = bloom.maybe_seen(other, "key", seen, words=1024).filter("maybe").count() / 20_000
    assert share < 0.1
    none = bloom.maybe_seen(keys.unionByName(spark.sql("SELECT CAST(NULL AS string) AS key")), "key", seen.filter("false"), words=1024)
    assert none.filter("maybe").isEmpty() and none.count() == 3001
    half = bloom.merge(bloom.build(keys.limit(0), "key", 1024).unionByName(seen))
    assert half.exceptAll(seen).isEmpty()


# --- n-gram models -------------------------------------------------------------------------------------------------


def brute_perplexity(train, held, order, discount=0.75):
    import math

    split = lambda t: [w for w in (t or "").replace("\n", " ").split(" ") if w]
    grams = lambda t, k: list(zip(*[(["\n"] * (k - 1) + split(t))[i:] for i in range(k)])) if split(t) else []
    counts = [defaultdict(int) for _ in range(order + 1)]
    for t in train:
        for g in grams(t, order):
            for k in range(1, order + 1):
                counts[k][g[order - k :]] += 1
    total, types = [defaultdict(int) for _ in range(order + 1)], [defaultdict(int) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            types[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if k == 1:
            return (counts[1][g] + 1) / (total[1][()] + types[1][()] + 1)
        low, t = p(g[1:]), total[k].get(g[:-1])
        return low if not t else max(counts[k].get(g, 0) - discount, 0) / t + discount * types[k][g[:-1]] / t * low

    out = []
    for key, t in held:
        g = grams(t, order)
        if g:
            out.append((key, len(g), round(math.exp(-sum(math.log(p(x)) for x in g) / len(g)), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_against_brute_force(spark, monkeypatch, order):
    from corpusloom.operators import ngram

    r = random.Random(order)
    text = lambda: " ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(1, 30)))
    train = [text() for _ in range(40)] + [None, "", " \n "]
    held = [(i, text() + r.choice(["", " new words", "\nx"])) for i in range(20)] + [(3, "a b"), (3, "a b"), (None, "c"), (30, None), (31, ""), (32, "a " * 3000)]
    monkeypatch.setattr(ngram, "FREQUENT", 5)
    model = ngram.fit(spark.createDataFrame([(t,) for t in train], "text string"), order)
    df = spark.createDataFrame(held, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("w1", "p", "n", "c", "total")})
    got = sorted(((x["doc_id"], x["n_words"], round(x["perplexity"], 6)) for x in ngram.perplexity(df, model).collect()), key=repr)
    assert len(got) == len(brute_perplexity(train, held, order))
    assert [g[:2] for g in got] == [w[:2] for w in brute_perplexity(train, held, order)]
    assert all(abs(a[2] - b[2]) < 1e-5 * b[2] for a, b in zip(got, brute_perplexity(train, held, order), strict=True))


def test_longer_contexts_predict_better(spark):
    from corpusloom.plans import catalog

    mean = lambda n: catalog.held_out_perplexity(spark, "/root/testdata/sf0.01", n).agg((F.sum(F.log("perplexity") * F.col("n_words")) / F.sum("n_words"))).first()[0]
    one, two, three = (mean(n) for n in (1, 2, 3))
    print("held-out nats a word:", one, two, three)
    assert two < one and three < one


def test_a_model_of_nothing(spark):
    from corpusloom.operators import ngram

    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [x["perplexity"] for x in ngram.perplexity(some, ngram.fit(none)).collect()] == [1.0]
    assert ngram.perplexity(none, ngram.fit(some)).collect() == []


# --- languages -----------------------------------------------------------------------------------------------------


def test_languages_are_told_on_texts_that_were_held_out(spark):
    from corpusloom.plans import catalog

    got = catalog.QUERIES["language_identified"](spark, "/root/testdata/sf0.01").filter("held_out AND language IS NOT NULL").toPandas()
    long = got[got["margin"].notna()]
    right = (long["lang"] == long["language"]).mean()
    print("held-out accuracy:", right, "of", len(long))
    assert len(long) > 250 and right > 0.9


def test_language_edge_cases(spark):
    from corpusloom.operators import language

    texts = {"en": "the quick brown fox jumps over the lazy dog and runs", "de": "der schnelle braune fuchs springt über den faulen hund"}
    rows = [(i, texts[k], k) for i, k in enumerate(["en", "de"] * 20)] + [(None, texts["en"], "xx"), (99, texts["en"], None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ("de", "en")
    asked = spark.createDataFrame([(None,), ("",), ("ab",), ("\U0001f600\U0001f600\U0001f600",), ("THE LAZY DOG 12",), ("der faule Hund",), ("the dog " * 400_000,)], "text string")
    got = [(r["f"]["language"], r["f"]["margin"]) for r in asked.select(language.identify(F.col("text"), model).alias("f")).collect()]
    assert got[:3] == [(None, None)] * 3 and got[3][0] in model.names and [g[0] for g in got[4:]] == ["en", "de", "en"]
    assert all(g[1] >= 0 for g in got[3:])
    long = "x" * (language.PIECE + 5) + "the end"
    assert language.counted(long).sum() == len(long) - 2
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.names == () and language.score("the dog", none) == (None, None)


# --- personal data -------------------------------------------------------------------------------------------------


def found_in(spark, texts):
    from corpusloom.operators import personal

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = df.withColumn("s", personal.personal_spans(F.col("text"))).withColumn("r", personal.redacted(F.col("text"), F.col("s"))).orderBy("i").collect()
    return [(None if r["s"] is None else [(s["kind"], s["found"], s["start"]) for s in r["s"]], r["r"]) for r in out]


def test_personal_data_is_checked(spark):
    texts = [
        "mail a.b+c@ex-ample.co.uk, 4111 1111 1111 1111 or 4111 1111 1111 1112.",
        "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, GB82WEST12345698765432",
        "at 10.0.0.255 not 10.0.0.256 nor 1.2.3",
        "call +49 (0)30 1234567 or (555) 123-4567 or 030/123; number 1234567890123, 2024-01-30, 3.14159265358, 1-2-3-4-5",
        "né\U0001f600 x@y.de", "", None, "[EMAIL] [PHONE]", "a@b.co" * 3, "x@y.de " * 3000,
    ]
    got = found_in(spark, texts)
    assert [s[:2] for s in got[0][0]] == [("email", "a.b+c@ex-ample.co.uk"), ("card", "4111 1111 1111 1111")]
    assert got[0][1] == "mail [EMAIL], [CARD] or 4111 1111 1111 1112."
    assert [s[1] for s in got[1][0]] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s[:2] for s in got[2][0]] == [("ip", "10.0.0.255")]
    assert [s[1] for s in got[3][0]] == ["+49 (0)30 1234567", "(555) 123-4567"] and got[3][1].startswith("call [PHONE] or [PHONE] or 030/123; number 1234567890123, 2024")
    assert got[4] == ([("email", "x@y.de", 4)], "né\U0001f600 [EMAIL]")
    assert got[5] == ([], "") and got[6] == (None, None) and got[7] == ([], "[EMAIL] [PHONE]")
    assert got[9][1] == "[EMAIL] " * 3000
    for t, (spans, _) in zip(texts, got, strict=True):
        assert all(t[at : at + len(found)] == found for _, found, at in spans or [])


def test_plain_numbers_are_seldom_personal(spark):
    r = random.Random(1)
    cards = [" ".join(str(r.randint(0, 9999)).zfill(4) for _ in range(4)) for _ in range(500)]
    plain = [str(r.randint(10**8, 10**12)) for _ in range(300)] + [f"{r.randint(0, 999)}.{r.randint(0, 10**9)}" for _ in range(300)] + [f"{r.randint(1900, 2100)}-{r.randint(10, 12)}-{r.randint(10, 28)}" for _ in range(300)]
    hits = lambda texts: sum(bool(s) for s, _ in found_in(spark, texts))
    assert 20 < hits([f"no {c} here" for c in cards]) < 90  # one in ten fits by chance
    assert hits([f"no {p} here" for p in plain]) == 0


# --- sketches ------------------------------------------------------------------------------------------------------


def test_sketches_of_runs_merge(spark):
    from corpusloom.operators import sketches

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("d"), (F.col("id") % 20_000).alias("k"), ((F.col("id") * 7919) % 60_000).cast("double").alias("x"))
    make = lambda r: sketches.sketched(r, "d", F.col("k"), {"x": F.col("x")})
    runs = [make(rows.filter(f"x % 4 = {i}")) for i in range(4)] + [make(rows.limit(0))]
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    whole = sketches.merged(whole, "d", ("x",))
    got = {r["d"]: r for r in sketches.estimates(whole, "d", ("x",)).collect()}
    exact = {r["d"]: r for r in rows.groupBy("d").agg(F.count_distinct("k").alias("k"), F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"a", "b", None}
    for d, r in got.items():
        assert r["n"] == exact[d]["n"] and abs(r["n_keys"] - exact[d]["k"]) < 0.04 * exact[d]["k"]
        assert all(abs(r[f"x_{q}"] - 600 * q) < 1500 for q in (5, 50, 80))
    kept = sketches.band(rows, "x", whole).count()
    assert abs(kept - 45_000) < 2000
    few = sketches.estimates(make(spark.createDataFrame([("a", 1, float("nan")), ("a", None, None), ("a", 1, None)], "d string, k long, x double")), "d", ("x",)).first()
    assert (few["n"], few["n_keys"], few["x_50"]) == (3, 1, None)
