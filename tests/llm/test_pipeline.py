import random
from collections import defaultdict

import corpus_pipeline as cp
from corpusloom.llm import orderminhash as om
from corpusloom.llm import quality as qu
from corpusloom.llm import secrets as se
from corpusloom.llm import toxicity as tx
from corpusloom.llm.common import BATCH, BATCH_BYTES, bound_batches

from .conftest import DOCS, doc
from .test_orderminhash import brute_classes


def write_corpus(spark, path):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["an", "re", "th", "in", "er", "on", "es", "ti"]) for _ in range(r.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(420):
        text = prose(r.randint(60, 200))
        kind = i % 7
        if kind == 1:
            text = " ".join(w + "$$$" for w in text.split())
        if kind == 2:
            w = text.split()
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "zorgblat", "moron"]))
            text = " ".join(w)
        if kind == 3:
            text = rows[-3][1] if i % 2 else rows[-3][1] + " tail"
        if kind == 4:
            text += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
        if kind == 5:
            text = prose(r.randint(0, 40))
        rows.append(doc(i, text))
        labels.append((i, int(kind not in (1, 5)), int(kind == 2)))
    rows += [doc(500, None), doc(501, ""), doc(None, prose(80))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    path = str(tmp_path)
    rows = write_corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, path)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/out-{k}")
        docs = spark.read.parquet(f"{path}/out-{k}")
        seen[name] = docs.collect()

    good = {x["doc_id"] for x in seen["quality_rules"]}
    for i, text, *_ in rows:
        stats = qu.word_rules(text or "")
        if qu.base_failed(stats[0], stats[4]) or (i is not None and i < 420 and i % 7 == 1):
            assert i not in good
        else:
            assert i in good
    clean = {x["doc_id"] for x in seen["toxicity"]}
    toxic = {i for i in good if i is not None and i < 420 and i % 7 == 2}
    assert not clean & toxic and good - toxic == clean
    before = [tuple(x) for x in seen["toxicity"]]
    groups = defaultdict(set)
    for (i, c), _ in brute_classes(before).items():
        groups[c].add(i)
    assert {x["doc_id"] for x in seen["order_minhash"]} == set(groups)
    assert len(seen["order_minhash"]) == len(groups) < len(before)
    text_of = {x["doc_id"]: x["text"] for x in seen["order_minhash"]}
    net = se.train_network()
    for x in seen["secret_scans"]:
        assert x["text"] == se.redact(text_of[x["doc_id"]], se.scan([text_of[x["doc_id"]]], net)[0])
        assert "24be6443" not in x["text"] and x["n_chars"] == len(x["text"])
    final = seen["best_fit_packing"]
    assert {x["doc_id"] for x in final} == set(text_of)
    again = cp.run(spark, path).collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["piece"])
    assert sorted(map(key, again)) == sorted(map(key, final))


def test_constants_are_the_operators_own():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "order_minhash", "secret_scans", "best_fit_packing"]
    assert cp.ORACLE_SQL is None and tx.DECISION == 0.7 and om.SIMILARITY == 0.8 and om.WORDS == 5


def test_texts_reach_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    """Of 10 MB of texts in one partition no batch has more than BATCH_BYTES; each stage sees to it by itself."""
    write_corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        spark.conf.unset(BATCH)
        stage(spark, docs, str(tmp_path))
        assert int(spark.conf.get(BATCH).rstrip("b")) == BATCH_BYTES, name

    seen, sketches = f"{tmp_path}/seen", om.sketches

    def spy(texts):
        with open(seen, "a") as f:
            f.write(f"{sum(map(len, texts))}\n")
        return sketches(texts)

    spark.conf.unset(BATCH)
    monkeypatch.setattr(om, "sketches", spy)
    long = "word " * 5000
    spark.createDataFrame([doc(i, long) for i in range(400)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/long.parquet")
    assert om.near_duplicates(spark.read.parquet(f"{tmp_path}/long.parquet")).filter("class_id = 0").count() == 400
    sizes = list(map(int, open(seen)))
    assert sum(sizes) >= 400 * len(long) and max(sizes) <= BATCH_BYTES + len(long)


def test_a_lower_bound_of_batches_stays(spark):
    for set_, kept in (("1m", "1m"), ("512k", "512k"), ("8m", str(BATCH_BYTES)), ("1048576b", "1048576b")):
        spark.conf.set(BATCH, set_)
        bound_batches(spark)
        assert spark.conf.get(BATCH) == kept
    spark.conf.unset(BATCH)


def test_stages_on_odd_rows(spark, clashing, no_docs, tmp_path, odd_rows, labels):
    """Nulls, empty and long texts, ties, repeated rows and clashing names pass through every stage; so does an empty table."""
    path = str(tmp_path)
    clashing.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clash = [c for c in docs.columns if c not in odd_rows_columns]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.select(*clash).distinct().collect() in ([], [tuple(["clash"] * len(clash))]), name
        assert out.count() <= len(odd_rows)
    assert cp.STAGES[3][1](spark, docs, path).filter("text IS NULL").count() == sum(r[1] is None for r in odd_rows)
    assert cp.STAGES[3][1](spark, docs.drop("n_chars"), path).columns == [c for c in docs.columns if c != "n_chars"]
    good = {r["doc_id"] for r in cp.STAGES[0][1](spark, docs, path).collect()}
    assert good <= {r[0] for r in odd_rows} and not good & {3, 4, 5, 6}
    packed = cp.STAGES[-1][1](spark, docs, path)
    assert packed.select("doc_id", "piece").count() >= len(odd_rows)
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, path).count() == 0
    no_docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert cp.run(spark, path).count() == 0


odd_rows_columns = [c.split()[0] for c in DOCS.split(", ")]
