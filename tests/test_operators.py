import math
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.ordering import running_total
from corpusloom.operators import chat, corpus_rules, curation, mixture, packing, preference, telemetry, tokens
from corpusloom.plans import catalog


def test_character_classes(spark):
    """Letters, digits and white space agree with Python's over all planes, but for characters of newer Unicode tables."""
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in points[::37] + points[:3000]], "c int, text string").distinct()
    out = rows.select("c", tx.letters(F.col("text")).alias("a"), tx.symbols(F.col("text")).alias("s"), (tx.strip(F.col("text")) == "").alias("w")).collect()
    off = 0
    for r in out:
        ch = chr(r["c"])
        assert r["w"] == ch.isspace() or ch in "\x1c\x1d\x1e\x1f", hex(r["c"])
        if unicodedata.category(ch) != "Cn":
            off += r["a"] != ch.isalpha()
            off += r["s"] != (not (ch.isalnum() or ch.isspace()))
    assert off < 0.02 * len(out)


def test_reasons_at_the_bounds(spark):
    texts = ["a" * 149, "a" * 150, "a" * 60 + "1" * 40 + "b" * 50, "a" * 89 + "1" * 61, "a" * 100 + "\n" * 50, "a" * 135 + "#" * 15, "a" * 134 + "#" * 16, "", None, "a" * 1_000_001]
    want = ["length", None, None, "alpha", "newline", None, "symbol", "length", "length", "length"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r["r"] for r in df.select("i", curation.reason(F.col("text")).alias("r")).orderBy("i").collect()] == want


def test_dedup(spark):
    rows = [(3, "a", " same "), (1, "a", "same"), (2, "b", "same"), (4, "a", "x" * 600 + "1"), (5, "a", "x" * 600 + "2"), (6, "a", None), (7, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    kept = curation.curate(docs, filtered=False)
    assert ids(kept) == [1, 2, 4]
    assert ids(curation.curate(docs, filtered=False, domain=None)) == [1, 4]
    assert ids(curation.dedup_exact(kept)) == ids(kept)


def test_running_total(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.randint(0, 50), i, r.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long")
    got = {x["i"]: x["t"] for x in running_total(df, F.col("v"), "k", "t", ("g",), ("i",)).collect()}
    for g in "abc":
        total = 0
        for _, k, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            assert got[i] == total
            total += v
    assert running_total(df.limit(0), F.col("v"), "k", "t").count() == 0


def sequential(docs, length, keep_tail):
    buffer, out = [], []
    for ids in docs:
        buffer += [1, *ids, 2]
        while len(buffer) >= length:
            out.append(buffer[:length])
            buffer = buffer[length:]
    return [*out, buffer + [0] * (length - len(buffer))] if keep_tail and buffer else out


@pytest.mark.parametrize("keep_tail", [False, True])
def test_packing_is_the_sequential_buffer(spark, keep_tail):
    r = random.Random(3)
    docs = [(i, [r.randint(13, 99) for _ in range(r.choice([0, 1, 3, 20, 90]))]) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    got = packing.pack(df, 16, keep_tail=keep_tail).orderBy("seq_id").collect()
    want = sequential([d for _, d in docs], 16, keep_tail)
    assert [list(x["input_ids"]) for x in got] == want
    stats = packing.pack_stats(df, 16).first()
    assert stats["sequences"] * 16 + stats["buffer_fill"] == stats["tokens_consumed"] == sum(len(d) + 2 for _, d in docs)
    assert packing.pack(df.limit(0), 16).count() == 0
    skipped = packing.pack(df, 16, skip_empty=True).count()
    assert skipped == sum(len(d) + 2 for _, d in docs if d) // 16


def test_shards_and_splits(spark):
    rows = spark.range(10).withColumnRenamed("id", "seq_id")
    out = packing.shard(rows, 4, first_shard=2)
    assert [(r["shard_id"], r["row_in_shard"]) for r in out.orderBy("seq_id").collect()] == [(2 + i // 4, i % 4) for i in range(10)]
    assert packing.next_shard(out) == 5 and packing.next_shard(out.limit(0)) == 0
    units = spark.createDataFrame([(f"f{i}", j) for i in range(9) for j in range(3)], "file string, j int")
    split = packing.split_units(units, "file", 0.001)
    assert split.filter("split = 'val'").select("file").distinct().count() == 1 and split.count() == 27


def test_tokens(spark):
    assert tokens.vocabulary_size() == 206_464 and tokens.vocabulary_size("lite") == 50_048
    df = spark.createDataFrame([("aé\U0001f600",), ("",), (None,)], "text string")
    for t in (tokens.CodePoints(), tokens.Utf8Bytes()):
        rows = df.select("text", tokens.encode(F.col("text"), t).alias("ids")).select("text", "ids", tokens.decode(F.col("ids"), t).alias("back")).collect()
        assert [r["back"] for r in rows] == ["aé\U0001f600", "", ""]
        assert len(rows[0]["ids"]) == len(t.ids("aé\U0001f600"))
    ids = F.array(F.lit(20), F.lit(21))
    row = df.limit(1).select(tokens.wrap(ids, max_length=3).alias("cut"), tokens.unshift(tokens.wrap(ids)).alias("raw"), tokens.shift(F.array(F.lit(0))).alias("up")).first()
    assert list(row["cut"]) == [1, 20, 21] and list(row["raw"]) == [None, 7, 8, None] and list(row["up"]) == [13]
    config = tokens.TokenizerConfig(max_length=7)
    assert tokens.TokenizerConfig.from_json(config.to_json().replace("{", '{"more": 1,', 1)) == config


def test_mixture(spark):
    assert mixture.phase_weights(2) == mixture.PHASE2 and math.isclose(sum(mixture.PHASE2.values()), 1)
    assert mixture.phase_weights(3, {"books_long", "arxiv"}) == {"books_long": 0.07, "arxiv": 0.06}
    assert mixture.phase_weights(1, {"books"}) == {"books": 0.30}
    assert mixture.normalized({"a": 1, "b": 3}) == [("a", 0.25), ("b", 1.0)]
    plan = mixture.mixture_plan(spark, 8000, {"a": 2, "b": 1, "c": 1}, 9)
    share = {r["domain"]: r["count"] / 8000 for r in plan.groupBy("domain").count().collect()}
    assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.25) < 0.03
    assert mixture.mixture_plan(spark, 10, {"only": 0.3}).filter("domain != 'only'").count() == 0
    assert mixture.gradient_accumulation(1, 8, 512, 4) == 1 and mixture.gradient_accumulation(2**20, 8, 2048, 4) == 16
    assert mixture.autoscaled_batch(2**20, 8, 512, 3) == 524_286 and mixture.autoscaled_batch(10, 8, 512, 2) == 8192
    assert mixture.phase_rows(4097, 2048) == 2


def test_chat(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "ab"), (2, 0, "stranger", ""), (2, 1, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    c = {ch: ord(ch) + 13 for ch in "suab"}
    got = {r["conv_id"]: r for r in chat.conversations(df, generation_prompt=True).collect()}
    assert list(got[1]["input_ids"]) == [1, 4, c["s"], 5, 6, c["u"], 7, 8, c["a"], c["b"], 9, 8]
    assert list(got[1]["labels"]) == [-100] * 8 + [c["a"], c["b"], 9, -100]
    assert list(got[2]["input_ids"]) == [1, 6, 7, 6, 7, 8]
    cut = {r["conv_id"]: r for r in chat.conversations(df, loss_on_prompt=True, max_length=6).collect()}
    assert list(cut[1]["labels"]) == [1, -100, c["s"], 5, -100, c["u"]] and len(cut[1]["input_ids"]) == 6
    with pytest.raises(ValueError):
        chat.collator("other")
    assert chat.collator("pretrain") is chat.stack and chat.collator("sft") is chat.collate and chat.collator("dpo") is preference.collate_pairs


def sequential_next_fit(rows, capacity):
    out, ids, labels = [], [], []
    pad = lambda xs, v: (xs + [v] * capacity)[:capacity]
    for i, lab in rows:
        if ids and len(ids) + len(i) > capacity:
            out.append((pad(ids, 0), pad(labels, -100)))
            ids, labels = [], []
        ids, labels = ids + i, labels + lab
    for k in range(0, len(ids), capacity):
        out.append((pad(ids[k : k + capacity], 0), pad(labels[k : k + capacity], -100)))
    return out


def test_next_fit(spark):
    r = random.Random(4)
    for last in (5, 60):
        rows = []
        for i in range(40):
            n = r.choice([2, 7, 15, 30]) if i < 39 else last
            rows.append((i, [r.randint(1, 9) for _ in range(n)], [r.choice([-100, 3]) for _ in range(n)]))
        df = spark.createDataFrame(rows, "conv_id long, input_ids array<int>, labels array<int>")
        got = chat.pack_next_fit(df, 24).orderBy("seq_id").collect()
        assert [(list(x["input_ids"]), list(x["labels"])) for x in got] == sequential_next_fit([(i, lab) for _, i, lab in rows], 24)


def test_preferences(spark):
    df = spark.createDataFrame([(1, [5, 6], [7], [8, 9, 9], None), (2, None, None, None, [1, 5, 7])], "i int, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>, chosen_full_ids array<int>")
    df = df.withColumn("rejected_full_ids", F.when(F.col("i") == 2, F.array(F.lit(1), F.lit(5), F.lit(8))))
    df = df.withColumn("chosen_loss_mask", F.when(F.col("i") == 2, F.array(F.lit(0), F.lit(0), F.lit(1))))
    out = preference.pretokenized(df, 5).orderBy("i").collect()
    assert list(out[0]["chosen_input_ids"]) == [1, 5, 6, 7, 0] and list(out[0]["chosen_labels"]) == [-100, -100, -100, 7, -100]
    assert list(out[0]["rejected_input_ids"]) == [1, 5, 6, 8, 9] and list(out[0]["rejected_labels"]) == [-100, -100, -100, 8, 9]
    assert list(out[1]["chosen_labels"]) == [-100, -100, 7, -100, -100] and list(out[1]["rejected_labels"]) == [-100, 5, 8, -100, -100]
    logits = [1.0, 900.0, -3.0]
    got = spark.range(1).select(preference.log_softmax_at(F.array(*map(F.lit, logits)), F.lit(0)).alias("x"), preference.softplus(F.lit(800.0)).alias("y"), preference.softplus(F.lit(-800.0)).alias("z")).first()
    assert math.isclose(got["x"], -899.0) and got["y"] == 800.0 and got["z"] == 0.0
    with pytest.raises(ValueError):
        preference.pair_loss("other", F.lit(0.0), 0.1)
    both = spark.createDataFrame([("x", None), (None, [("user", "q"), ("assistant", "a")]), (None, None)], "t string, m array<struct<role string, content string>>")
    assert [r[0] for r in both.select(preference.last_content(F.col("t"), F.col("m"))).collect()] == ["x", "a", ""]


def test_telemetry(spark):
    lr = lambda t: spark.range(1).select(telemetry.learning_rate(F.lit(t), 1.0, 0.1, 100, 300, 2.0)).first()[0]
    assert math.isclose(lr(50), 2 * 0.55) and math.isclose(lr(100), 2.0) and math.isclose(lr(200), 2 * 0.55) and math.isclose(lr(10_000), 0.2)
    line = "[Ph2|Step 1,012] loss=2.5000 | ppl=12.18 | aux=0.1 | lr=3.00e-04 | gnorm=0.512 | tok/s=29,200 | MFU=41.2% | step=9ms | tokens=1.0B | mem=20.1/34.0GB"
    df = spark.createDataFrame([(line,), ("other",), (None,), ("[accum 1/8] micro-loss=2.25",)], "value string")
    [m] = telemetry.step_metrics(df).collect()
    assert tuple(m) == (2, 1012, 2.5, 3e-4, 0.512, 29_200, 41.2, 20.1)
    assert telemetry.micro_losses(df.withColumn("i", F.monotonically_increasing_id()), "i").first()["micro_loss"] == 2.25
    due = spark.range(1).select(telemetry.checkpoint_due(F.lit(150), 100, 20).alias("a"), telemetry.checkpoint_due(F.lit(110), 100, 20).alias("b"), telemetry.checkpoint_due(F.lit(150), 100, 20, F.lit(20.0)).alias("c")).first()
    assert tuple(due) == (False, True, True)
    m = telemetry.metered(F.lit(50), 100)
    assert spark.range(1).select(m["elapsed_str"]).first()[0] == "00h 00m 00s"
    unknown = spark.range(1).select(telemetry.peak_tflops(F.lit("X"), F.lit(10)), telemetry.peak_tflops(F.lit("h100 mig"), F.lit(66))).first()
    assert math.isclose(unknown[0], 3.84) and math.isclose(unknown[1], 494.5)


def test_near_duplicates_by_shingles(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(200)]
    near = base[:100] + ["other"] + base[101:]
    far = [f"w{r.randint(0, 500)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, ""), (5, None), (6, "a b"), (7, "a b")], "doc_id long, text string")
    got = {(x["key_a"], x["key_b"]): x["jaccard"] for x in corpus_rules.shingle_jaccard(docs).collect()}
    s = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert set(got) == {(1, 2), (6, 7)}
    assert math.isclose(got[1, 2], len(s(base) & s(near)) / len(s(base) | s(near)))


def test_near_duplicates_of_families_and_a_passage(spark):
    r = random.Random(6)
    fresh = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    passage, texts = fresh(120), []
    for _ in range(25):
        tail = fresh(40)
        texts += [passage + tail[:30] + fresh(10) for _ in range(3)]
    texts = [passage + fresh(40), *texts]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(i, i + 1) for i in range(1, 76, 3)} <= want
    assert {(x["key_a"], x["key_b"]) for x in corpus_rules.shingle_jaccard(docs).collect()} == want


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(catalog.budget_guard(spark, sf))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text and "Exchange" not in text
    assert "PushedFilters: [IsNotNull(text)" in plan(catalog.exact_dedup_by_domain(spark, sf))
    assert "CartesianProduct" not in plan(catalog.greedy_pack(spark, sf))


def test_lines_and_payload(spark):
    import json

    df = spark.createDataFrame([(i, 2, 1000 + i, 2.5 + i, 3e-4, 0.5, 29_200.0, 0.41, 20.0, 80.0) for i in range(3)], "i long, phase int, step long, loss double, lr double, gnorm double, tok_s double, mfu double, mem double, total double")
    lines = df.select("i", telemetry.step_line(*[F.col(c) for c in df.columns[1:]]).alias("value"))
    assert [r["step"] for r in telemetry.step_metrics(lines).orderBy("i").collect()] == [1000, 1001, 1002]
    payload = json.loads(telemetry.dashboard(lines, "i", F.lit(7200), 0).first()["payload"])
    assert payload["step"] == 1002 and payload["charts"]["loss"] == [2.5, 3.5, 4.5] and payload["logs"].count("\n") == 2
    assert payload["cost"]["elapsed_str"] == "02h 00m 00s"
    manifest = spark.createDataFrame([("books", 1234, None), ("arxiv", None, "gone")], "domain string, train_tokens long, error string")
    assert sorted(r["line"].split()[-1] for r in telemetry.summary_table(manifest).collect()) == ["gone", "tokens"]


def test_order_with_nulls_and_ties(spark):
    import random

    from corpusloom.functions import ordering

    r = random.Random(5)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 1, 1, 1, 1, 2, 3, 9]), i, r.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "stream string, k long, id long, n long")
    want, sums = {}, {}
    for stream, k, i, n in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        want[i] = sums.get(stream, 0)
        sums[stream] = want[i] + n
    for size in (ordering.ROWS, 100):
        ordering.ROWS, was = size, ordering.ROWS
        try:
            ranges = df.select(ordering.range_bucket(df, "k", ("id",)).alias("r")).groupBy("r").count().collect()
            got = ordering.running_total(df, F.col("n"), "k", "before", ("stream",), ("id",)).collect()
        finally:
            ordering.ROWS = was
        assert {x["id"]: x["before"] for x in got} == want and len(got) == len(rows)
        if size == 100:  # half of the rows share a key and do not meet in one range
            assert max(x["count"] for x in ranges) < 700


def test_past_cuts(spark):
    from bisect import bisect_right

    from corpusloom.functions.ordering import past_cuts

    for cuts in ([], [3], list(range(0, 40, 2)), list(range(100))):
        df = spark.range(-1, 50).withColumn("c", past_cuts(F.col("id"), cuts))
        assert [x["c"] for x in df.orderBy("id").collect()] == [bisect_right(cuts, i) + 1 for i in range(-1, 50)]
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(past_cuts(F.col("id"), [1, 2])).first()[0] == 0


def test_dedup_keeps_null_sources_and_one_of_repeated_rows(spark):
    rows = [(1, "x", "a"), (1, "x", "a"), (2, "x", "a"), (None, "y", "a"), (3, "y", "a"), (4, "x", None), (5, "x", None), (None, "z", None), (None, "z", None), (6, "w", "b"), (6, "w", "b2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, curation.dedup_exact(docs).collect()), key=repr)
    assert got == sorted([(1, "x", "a"), (None, "y", "a"), (4, "x", None), (None, "z", None), (6, "w", "b"), (6, "w", "b2")], key=repr)
    got = sorted(map(tuple, curation.dedup_exact(docs, domain=None).collect()), key=repr)
    assert [x[:2] for x in got] == [(1, "x"), (6, "w"), (None, "y"), (None, "z")]
    assert curation.dedup_exact(docs.limit(0)).count() == 0


def test_packing_keeps_streams_without_a_name(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "s", [7] * 5) for i in range(20)], "doc_id long, source string, ids array<int>")
    out = packing.pack(docs, 7, streams=("source",)).groupBy("source").count().collect()
    assert {x["source"]: x["count"] for x in out} == {None: 10, "s": 10}


def test_next_fit_over_ranges(spark):
    from corpusloom.functions import ordering

    r = random.Random(11)
    for most, capacity in ((9, 10), (30, 40), (60, 40)):
        lengths = [r.randint(1, most) for _ in range(700)]
        at, used, want = 0, 0, {}
        for i, n in enumerate(lengths):
            if used and used + n > capacity:
                at, used = at + 1, 0
            want[i] = (at, used)
            used += n
        rows = spark.createDataFrame(list(enumerate(lengths)), "conv_id long, length int")
        ordering.ROWS, was = 40, ordering.ROWS
        try:
            got = {x["conv_id"]: (x["bin"], x["start"]) for x in chat.next_fit_bins(rows, capacity).collect()}
        finally:
            ordering.ROWS = was
        assert got == want
    assert chat.next_fit_bins(rows.limit(0), 5).count() == 0


def test_collators_cut_and_pad(spark):
    rows = spark.createDataFrame([(0, i, list(range(n)), [7] * n) for i, n in enumerate((3, 9, 6))], "batch_id long, id long, input_ids array<int>, labels array<int>")
    out = {r["id"]: r for r in chat.collate(rows, max_length=5).collect()}
    assert out[0]["input_ids"] == [0, 1, 2, 0, 0] and out[0]["labels"] == [7, 7, 7, -100, -100] and out[0]["attention_mask"] == [1, 1, 1, 0, 0]
    assert out[1]["input_ids"] == out[2]["input_ids"] == [0, 1, 2, 3, 4]
    sides = rows.select("batch_id", "id", *[F.col(c).alias(f"{s}_{c}") for s in preference.SIDES for c in ("input_ids", "labels")])
    pair = preference.collate_pairs(sides, max_length=4).filter("id = 0").first()
    assert pair["rejected_input_ids"] == [0, 1, 2, 0] and pair["chosen_attention_mask"] == [1, 1, 1, 0]
    one = chat.stack(rows.filter("id = 0").withColumn("pos_in_batch", F.lit(0))).first()
    assert one["input_ids"] == one["labels"] == [[0, 1, 2]]


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from corpusloom.functions import tables

    conf = {"spark.master": "spark://host:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    with pytest.raises(ValueError):
        tables.shared_dir(session)
    conf["spark.checkpoint.dir"] = "s3://bucket/dir/"
    assert tables.shared_dir(session) == "s3://bucket/dir"
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert sorted(tables.written(df, "t").collect()) == sorted(df.collect())
