import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import crosstok

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
PARTS = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\n\n", "a", "the", "The", "'s", "1", "23", "é", "ü", "日本", "\U0001f600", "́", "\x1c", "\x85", "\xa0", "​", "　", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "!!", "...", "ing", "S", "\x00", "ß"]


@pytest.fixture(scope="module")
def pair():
    return crosstok.load(crosstok.FIRST, crosstok.SECOND)


def whole(pair, text):
    """Brute force: ids of both sides for a whole text, or None."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    want = (" " + text).encode()
    join = lambda table, ids: b"".join(table[i] for i in ids)
    return (a, b) if join(pair.bytes_a, a) == want == join(pair.bytes_b, b) else None


def aligned(pair, a, b):
    """Groups and links of a whole text, one token after the other."""
    def spans(table, ids):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at := at + len(table[i])))
        return out

    x, y = spans(pair.bytes_a, a), spans(pair.bytes_b, b)
    common = sorted({e for _, _, e in x} & {e for _, _, e in y})
    groups, i, k = [], 0, 0
    for end in common:
        of_a, of_b = [], []
        while i < len(x) and x[i][2] <= end:
            of_a.append(str(x[i][0]))
            i += 1
        while k < len(y) and y[k][2] <= end:
            of_b.append(str(y[k][0]))
            k += 1
        groups.append(",".join(of_a) + "|" + ",".join(of_b))
    links, k = [], 0
    for i, s, e in x:
        while k and y[k][1] > s:
            k -= 1
        while k < len(y) and y[k][2] <= s:
            k += 1
        j = k
        while j < len(y) and y[j][1] < e:
            links.append((i, y[j][0]))
            j += 1
    return groups, links


def brute(pair, rows):
    done, df = [], Counter()
    for doc_id, text in rows:
        got = whole(pair, text)
        if got is None:
            done.append((doc_id, 0, 0, [], []))
            continue
        groups, links = aligned(pair, *got)
        done.append((doc_id, len(got[0]), len(got[1]), groups, links))
        df.update(set(links))
    top = defaultdict(int)
    for (a, _), n in df.items():
        top[a] = max(top[a], n)
    out = []
    for doc_id, n_a, n_b, groups, links in done:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(df[x] == top[x[0]] for x in links), sum(df[x] for x in links), digest))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["x" * 5000, "é" * 999, " " * 300, "\n" * 50, "a \n b", "a▁b c", "trail ", "a\n", "▁", " ", "\n"]


def test_borders_are_proven(pair):
    assert " " in pair.breaks and "\n" in pair.breaks
    assert crosstok.borders([b"ab", b"a b"], [b"a"]) == "\n\t\r"
    assert crosstok.borders([b"ab"], [b" \n"]) == " \t\r"
    assert crosstok.borders([b"\xa0 "], [b"x\t"]) == "\n\r"  # half of a character is not known to be white space
    assert crosstok.borders(["\xa0 ".encode()], [b"  "]) == crosstok.CANDIDATES


def test_segments_have_the_tokens_of_their_text(pair):
    cut = crosstok.cutter(pair.breaks)
    for text in filter(None, fuzz(4000, 5)):
        segments = cut(text)
        assert "".join(segments) == " " + text
        a, b = pair.encode(segments)
        assert [i for x in a for i in x] == pair.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for x in b for i in x] == pair.b.encode(text), text
    assert cut("one two\nthree  four") == [" one", " two", "\nthree", "  four"]
    assert cut("a\xa0 b") == [" a\xa0 b"]
    assert crosstok.cutter("\n")("a b\nc") == [" a b\nc"]  # without the space nothing is cut


def test_varint():
    r = np.random.default_rng(1)
    x = np.r_[0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**31, r.integers(0, 2**34, 500)]
    raw, ends = crosstok.to_varint(x)
    assert crosstok.from_varint(raw).tolist() == x.tolist() and ends[-1] == len(raw)
    assert crosstok.from_varint(raw[ends[2] : ends[6]]).tolist() == x[3:7].tolist()
    lists = crosstok.unpack(crosstok.pack(x, x[:0], x[:3]), 3)
    assert [y.tolist() for y in lists] == [x.tolist(), [], x[:3].tolist()]
    assert crosstok.gather(np.array([0, 2, 2, 5]), np.arange(5), np.array([2, 0, 1, 2])).tolist() == [2, 3, 4, 0, 1, 2, 3, 4]
    assert crosstok.to_varint(x[:0])[0] == b"" and not len(crosstok.from_varint(b""))


@pytest.mark.parametrize("block,flat", [(crosstok.BLOCK, crosstok.FLAT), (300, 7)])
def test_against_brute_force(spark, pair, monkeypatch, block, flat):
    texts = fuzz(400, 7)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "the the ing"), (None, None), (9999, None), (10000, "the " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if block != crosstok.BLOCK:  # small blocks, by functions that take their bounds along
        monkeypatch.setattr(crosstok, "BLOCK", block)
        monkeypatch.setattr(crosstok, "FLAT", flat)
        monkeypatch.setattr(crosstok, "HELD", 100)
        frames = spark_free(pair, rows, 3)
        assert frames == brute(pair, rows)
        return
    assert got(crosstok.align_documents(docs, digest=True)) == brute(pair, rows)


def spark_free(pair, rows, parts):
    """The same functions on pandas frames, block by block."""
    import pandas as pd

    cut = crosstok.cutter(pair.breaks)
    blocks = []
    for part in range(parts):
        index = defaultdict()
        index.default_factory = index.__len__
        ids, lists, chars = [], [], 0
        for doc_id, text in rows[part::parts]:
            ids.append(doc_id)
            segments = cut(text) if text else []
            lists.append(np.fromiter(map(index.__getitem__, segments), np.int32, len(segments)))
            chars += len(text or "")
            if chars >= crosstok.BLOCK:
                blocks.append(pd.concat(crosstok._coded(len(blocks), ids, lists, index)))
                index.clear()
                ids, lists, chars = [], [], 0
        if ids:
            blocks.append(pd.concat(crosstok._coded(len(blocks), ids, lists, index)))
    everything = pd.concat(blocks)
    segments = everything[everything["segment"].notna()][["segment", "block", "idx"]].astype({"block": int, "idx": int}).sort_values("segment", ignore_index=True)
    crosstok._loaded[crosstok.FIRST, crosstok.SECOND] = pair
    batches = [segments.iloc[k : k + 30].reset_index(drop=True) for k in range(0, len(segments), 30)]
    aligned_ = pd.concat(crosstok.align_segments(crosstok.FIRST, crosstok.SECOND)(iter(batches)))
    composed, coded = [], []
    for k, b in enumerate(blocks):
        lists = b[b["row"].notna()][["block", "row", "doc_id", "size", "code"]]
        coded.append(lists.drop(columns="doc_id"))
        composed.append(crosstok.compose_block(True)(lists, aligned_[aligned_["block"] == k]))
    found = pd.concat(crosstok.found_pairs(c[c["found"].notna()] for c in composed))
    counts = found.groupby(["a", "b"], as_index=False)["df"].sum().rename(columns={"df": "count"})
    counts["best"] = (counts["count"] == counts.groupby("a")["count"].transform("max")).astype(int)
    known = found.merge(counts, on=["a", "b"])
    packed = pd.concat(crosstok.pack_counts(known.iloc[k : k + 50] for k in range(0, len(known), 50)))
    out = [crosstok.count_block(pd.concat([c, coded[k]]), packed[packed["block"] == k]) for k, c in enumerate(composed)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(None if pd.isna(r[n]) else r[n] for n in names) for _, r in pd.concat(out).iterrows()), key=repr)


def test_edge_cases(odd_docs, clashing, no_docs, odd_rows, pair):
    want = brute(pair, [(r[0], r[1]) for r in odd_rows])
    assert got(crosstok.align_documents(odd_docs, digest=True)) == want
    assert got(crosstok.align_documents(clashing, digest=True)) == want
    assert got(crosstok.align_documents(no_docs)) == []
    texts = {r["doc_id"]: r["groups"] for r in crosstok.align_documents(odd_docs.filter("doc_id = 6")).collect()}
    assert texts == {6: ";".join(aligned(pair, *whole(pair, "x"))[0])}
