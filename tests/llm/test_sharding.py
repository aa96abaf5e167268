from collections import Counter, defaultdict
import zlib

import pytest

from corpusloom.llm import sharding as sh

from .conftest import plain


def check(rows, out, shards=8):
    assert len(out) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
    for got in places.values():
        assert sorted(got) == list(range(len(got)))


def test_odd_rows(spark, odd_docs, clashing, no_docs, odd_rows):
    check(odd_rows, sh.shard_documents(odd_docs)[0].collect())
    check(odd_rows, sh.shard_documents(clashing)[0].collect())
    assert sh.shard_documents(no_docs)[0].count() == 0


def test_bytes_are_near_equal(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 900 as int)) AS text")
    out = sh.shard_documents(docs)[0].groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.001 * sum(sizes)


def test_map_versions(spark, tmp_path):
    weight = {i: (i * 7919) % 1000 + 1 for i in range(512)}
    first = sh.plan_map(weight, 8, 512)
    grown = sh.grow_map(first, weight)
    assert {b for a, b in zip(first.owner, grown.owner) if a != b} == {8}  # rows move into the new shard only
    assert max(grown.loads(weight)) < 1.1 * sum(weight.values()) / 9
    heavy = {i: w * (5 if first.owner[i] == 0 else 1) for i, w in weight.items()}
    even = sh.rebalance_map(first, heavy)
    assert max(even.loads(heavy)) < 1.03 * sum(heavy.values()) / 8
    moved = sum(a != b for a, b in zip(first.owner, even.owner))
    assert 0 < moved < 512 // 4
    path = str(tmp_path / "map")
    sh.save_map(spark, first, path)
    sh.save_map(spark, grown, path)
    assert sh.load_map(spark, path) == grown
    assert sh.load_map(spark, path, 1) == first
    with pytest.raises(ValueError):
        sh.plan_map(weight, 0, 512)


def test_same_again(spark, odd_docs):
    assert plain(sh.shard_documents(odd_docs)[0]) == plain(sh.shard_documents(odd_docs)[0])


def test_a_row_repeated_over_and_over_is_dealt_out(spark):
    docs = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, repeat('y', 300), 'x') AS text")
    out, slot_map = sh.shard_documents(docs)
    rows = out.collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values())
    assert max(Counter(r["virtual_slot"] for r in rows).values()) < 100


def test_a_slot_follows_from_the_record(spark):
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'y', 'x') AS text")
    names = ["doc_id", "size", "text_crc32", "copy", "virtual_slot"]
    one, other = (sorted(map(tuple, sh.slotted(docs.repartition(n)).select(*names).collect())) for n in (1, 13))
    assert one == other  # whatever the files
    assert sorted(r[3] for r in one if r[0] == 7 and r[2] == zlib.crc32(b"y")) == list(range(2000))
    more = sh.slotted(docs.unionByName(spark.createDataFrame([(7, "y"), (-1, "new")], "doc_id long, text string"))).select(*names)
    assert len(set(map(tuple, more.collect())) - set(one)) == 2  # no record moves when others come


def test_the_edited_map_moves_rows_to_the_new_shard_only(spark):
    rows = sh.query(spark, "/root/testdata/sf0.001").collect()
    moved = [r for r in rows if r["shard"] != r["shard_of_nine"]]
    assert moved and {r["shard_of_nine"] for r in moved} == {8}
    loads = Counter()
    for r in rows:
        loads[r["shard_of_nine"]] += r["size"]
    assert loads[8] < sum(loads.values()) / 8
