import json
import os

import numpy as np
import pytest

from corpusloom.sources import arrays, layout, text


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_documents(spark, tmp_path):
    base = str(tmp_path / "raw")
    lines = ['{"text": "one"}', "", "   ", "not json", '{"text": ""}', '{"other": 1}', "[1, 2]", '"plain"', '{"text": null}', '{"text": "tw\\u00f6"}']
    put(f"{base}/b.jsonl", "\n".join(lines))
    put(f"{base}/deep/a.json", '{"text": "three"}\n')
    put(f"{base}/c.txt", "  whole\nfile \n")
    put(f"{base}/bad.txt", b"a\xffb")
    put(f"{base}/ignored.csv", "x")
    out = text.read_documents(spark, base).orderBy("file_rank", "file", "line_no").collect()
    assert [r["text"] for r in out] == ["one", "twö", "three", "a�b", "whole\nfile"]
    bad = text.count_bad_lines(spark, base).collect()
    assert sum(r["bad_lines"] for r in bad) == 5
    assert [r["text"] for r in text.read_documents(spark, base, "other", (".jsonl",)).collect()] == ["1"]
    with pytest.raises(FileNotFoundError):
        text.read_documents(spark, str(tmp_path / "none"))
    put(str(tmp_path / "empty/x.csv"), "1")
    with pytest.raises(FileNotFoundError):
        text.read_documents(spark, str(tmp_path / "empty"))


def test_conversations_and_pairs(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    put(path, '{"messages": [{"role": "user", "content": "hi"}]}\n{"conversation": [{"role": "assistant", "content": "yo"}]}\n')
    rows = text.read_conversations(spark, path).collect()
    assert [r["messages"][0]["content"] for r in rows] == ["hi", "yo"]
    put(path, "{broken\n")
    with pytest.raises(Exception):
        text.read_conversations(spark, path).collect()
    raw = str(tmp_path / "p.txt")
    put(raw, '{"prompt": [{"role": "user", "content": "q"}], "chosen": "good", "rejected": [{"role": "assistant", "content": "a"}, {"role": "assistant", "content": "bad"}]}\n\n')
    [r] = text.read_raw_pairs(spark, raw).collect()
    assert r["chosen_text"] == "good" and r["rejected_text"] is None and r["rejected_msgs"][-1]["content"] == "bad" and r["prompt"][0]["role"] == "user"
    tok = str(tmp_path / "t.jsonl")
    put(tok, "\n".join(json.dumps({"prompt_ids": [i], "chosen_ids": [2], "rejected_ids": [3]}) for i in range(5)))
    assert text.read_token_pairs(spark, tok, 2).count() == 2


def test_logs(spark, tmp_path):
    put(str(tmp_path / "b.log"), "x\ny\n")
    assert [r["value"] for r in text.read_log(spark, str(tmp_path / "a.log"), str(tmp_path / "b.log")).orderBy("line_no").collect()] == ["x", "y"]
    assert text.read_log(spark, str(tmp_path / "none.log")).count() == 0


def test_arrays(spark, tmp_path):
    base = str(tmp_path)
    np.save(f"{base}/train_shard_0000.npy", np.arange(12, dtype=np.uint32).reshape(3, 4))
    np.save(f"{base}/train_shard_0001.npy", np.arange(10, dtype=np.uint32))
    np.save(f"{base}/train_shard_0002.npy", np.arange(12, dtype=np.uint32).reshape(2, 6))
    np.save(f"{base}/train_shard_0003.npy", np.zeros((2, 2, 2), np.uint32))
    put(f"{base}/train_shard_0004.npy", "no array")
    rows = arrays.read_packed(spark, base, 4).orderBy("file", "row").collect()
    assert [list(r["input_ids"]) for r in rows] == [*[list(range(4 * i, 4 * i + 4)) for i in range(3)], [0, 1, 2, 3], [4, 5, 6, 7], *[list(range(4 * i, 4 * i + 4)) for i in range(3)]]
    assert arrays.read_packed(spark, base, 4, "val").count() == len(rows)  # no file of the split: all files
    assert arrays.read_token_arrays(spark, base).count() == 3 + 1 + 2


def test_archives(spark, tmp_path):
    for k, width in enumerate((4, 5)):
        np.savez(str(tmp_path / f"s{k}.npz"), input_ids=np.ones((3, width), np.uint32), loss_mask=np.ones((3, width), np.uint8))
    assert arrays.read_sft(spark, str(tmp_path), 4).count() == 3
    assert arrays.read_sft(spark, str(tmp_path), 4, most=2).count() == 2


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(i // 2, i % 2, [i, i + 1]) for i in range(5)], "shard_id long, row_in_shard long, input_ids array<int>")
    done = arrays.export_npy(rows, str(tmp_path / "out")).orderBy("shard_id").collect()
    assert [r["rows"] for r in done] == [2, 2, 1]
    assert np.load(done[1]["file"]).tolist() == [[2, 3], [3, 4]]
    assert all(not f.endswith(".writing") for f in os.listdir(tmp_path / "out"))


def test_layout(spark, tmp_path):
    assert layout.resolve("/x", lambda p: True) == "/x"
    with pytest.raises(NotImplementedError):
        layout.resolve("hf://a/b", lambda p: True)
    with pytest.raises(FileNotFoundError):
        layout.resolve("a/b", lambda p: False)
    os.makedirs(tmp_path / "books")
    assert layout.present_domains(spark, str(tmp_path), ("books", "arxiv")) == ["books"]
    assert layout.detect_format(["a.npz", "train.jsonl"], "sft") == "npz" and layout.detect_format(["x/train.jsonl"], "sft") == "jsonl"
    assert layout.detect_format(["a.jsonl"], "dpo") == "tokens" and layout.detect_format(["a.txt"], "dpo") == "raw"
    with pytest.raises(FileNotFoundError):
        layout.detect_format(["x"], "sft")
    config = layout.ModelConfig(d_model=8, vocab_size=16, n_layers=2, attention_layers=(0,), dense_layers=(0,), expert_layers=(1,), recurrent_parameters=5)
    assert layout.load_settings(layout.ModelConfig, '{"d_model": 8, "unknown": 1}').d_model == 8
    assert config.parameters() == 128 + 5 + 2 * 8 * 64 * 20 + 3 * 8 * 2816 + 16 * 3 * 8 * 512
    folder = str(tmp_path / "step_1")
    put(str(tmp_path / "latest_checkpoint.json"), json.dumps({"latest_path": folder}))
    assert layout.latest_checkpoint(spark, str(tmp_path / "latest_checkpoint.json")) is None
    os.makedirs(folder)
    assert layout.latest_checkpoint(spark, str(tmp_path / "latest_checkpoint.json")) == folder
    once = str(tmp_path / "clean")
    first = layout.write_once(spark.createDataFrame([("a",)], "text string"), once)
    again = layout.write_once(spark.createDataFrame([("b",)], "text string"), once)
    assert [r["text"] for r in again.collect()] == [r["text"] for r in first.collect()] == ["a"]


def test_preference_arrays_and_first_rows(spark, tmp_path):
    base = str(tmp_path / "pairs")
    os.makedirs(base)
    for name, n in (("b", 3), ("a", 2)):
        np.savez(f"{base}/{name}.npz", **{k: np.full((n, 4), ord(name)) + np.arange(n)[:, None] for k in arrays.PAIR_ARRAYS})
    np.savez(f"{base}/c.npz", other=np.zeros(3))
    put(f"{base}/broken.npz", b"PK no archive")
    rows = arrays.read_preference_arrays(spark, base).collect()
    assert len(rows) == 5 and set(rows[0].asDict()) == {"file", "row", *arrays.PAIR_ARRAYS}
    first = arrays.read_preference_arrays(spark, base, 3).collect()
    assert [r["chosen_full_ids"][0] for r in first] == [97, 98, 98]
    for k in range(3):
        put(f"{base}/t{k}.jsonl", "\n".join(json.dumps({"prompt_ids": [10 * k + i], "chosen_ids": [2], "rejected_ids": [3]}) for i in range(4)))
    got = text.read_token_pairs(spark, f"{base}/*.jsonl", 6).collect()
    assert [r["prompt_ids"][0] for r in got] == [0, 1, 2, 3, 10, 11]


def test_preprocess_all(spark, tmp_path):
    from corpusloom.operators import packing
    from corpusloom.plans.preprocess import preprocess_all

    prose = lambda i: f"Some words of document {i} that go on and on for long enough. " * 5
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    lines = lambda key, ids: "\n".join(json.dumps({key: prose(i)}) for i in ids)
    put(f"{raw}/wikipedia/a.jsonl", lines("text", [1, 2, 1, 3]) + "\n" + json.dumps({"text": "too short"}) + "\nno json")
    put(f"{raw}/wikipedia/b.jsonl", lines("text", [3, 4]))
    put(f"{raw}/thestack/a.jsonl", lines("content", [7]) + "\n" + json.dumps({"content": "short code" * 9}))
    put(f"{raw}/stackexchange/a.jsonl", lines("body", [8, 9]))
    put(f"{raw}/books/nothing.csv", "1")
    manifest = {r["domain"]: r for r in preprocess_all(spark, raw, out, length=64, shard_size=3, fraction=0.5).collect()}
    assert set(manifest) == {"wikipedia", "thestack", "stackexchange", "books"}
    assert "FileNotFoundError" in manifest["books"]["error"] and manifest["wikipedia"]["error"] is None
    n = len(prose(1)) + 2
    wiki = spark.read.parquet(f"{out}/wikipedia").collect()
    assert len(wiki) == 3 * n // 64 + n // 64 and manifest["wikipedia"]["n_input_files"] == 2
    for split in ("train", "val"):
        mine = sorted((r["shard_id"], r["row_in_shard"]) for r in wiki if r["split"] == split)
        assert mine == [(k // 3, k % 3) for k in range(len(mine))] and len(mine) == manifest["wikipedia"][f"{split}_sequences"]
    assert len(spark.read.parquet(f"{out}/thestack").collect()) == (n + 90 + 2) // 64  # code is not filtered
    assert os.path.exists(f"{out}/preprocessing_manifest.json")
    m = manifest["wikipedia"]
    assert (m["n_documents"], m["n_bad"], m["n_rejected"], m["n_kept"]) == (7, 1, 1, 4) and m["elapsed_s"] >= m["read_s"] >= 0
    put(f"{raw}/books/a.jsonl", lines("text", [5, 6]))  # a second run does what the first could not, and nothing again
    put(f"{raw}/wikipedia/a.jsonl", "no longer read")
    again = {r["domain"]: r for r in preprocess_all(spark, raw, out, length=64, shard_size=3, fraction=0.5).collect()}
    assert again["wikipedia"] == manifest["wikipedia"] and again["books"]["error"] is None and again["books"]["n_documents"] == 2
    other = {r["domain"]: r for r in preprocess_all(spark, raw, out, ("stackexchange",), length=32, shard_size=3, fraction=0.5).collect()}
    assert other["stackexchange"]["seq_len"] == 32
    assert packing.next_shard(spark.read.parquet(f"{out}/wikipedia").filter("split = 'train'")) >= 1
