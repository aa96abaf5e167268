import hashlib
import random

import pytest

from corpusloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
NAME = "byte_bpe_50k.json"
PARTS = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "'", "1", "23", "é", "ü", "日", "\U0001f600", "́", "\x1c", "\x85", "\xa0", "​", "<|endoftext|>", "!!", "...", "ing", "S", "\r\n", "\x00", "ß", "İ", "'LL", "ſ", "²", "Ⅷ"]


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path(NAME)
    return bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["x" * 3000, "ab" * 40_000, " " * 5000, "é" * 999]


def test_same_ids_and_round_trip(both):
    own, library = both
    texts = fuzz(8000, 1)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in own.encode_batch(texts)]
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert [x.tolist() for x in own.encode_batch(texts)] == want  # from the cache


def test_every_token_is_its_own_encoding(both):
    own, _ = both
    assert own.sound.all()
    assert all(own.merge(own.bytes_of[i]) == [i] for i in range(0, 50_256, 97))


def test_speculation_equals_merging(both):
    own, _ = both
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu ") for _ in range(r.randint(1, 90))) for _ in range(4000)]
    exact = [own.merge(w.encode()) for w in words]
    assert own.encode_words(words) == exact
    guess = [own.propose(w.encode()) for w in words]
    assert any(g == e for g, e in zip(guess, exact)) and any(g != e for g, e in zip(guess, exact))


def test_columns(spark, odd_docs, clashing, no_docs, odd_rows, both):
    _, library = both
    for docs in (odd_docs, clashing):
        out = docs.select("doc_id", "text", bpe.digest_column(NAME)("text").alias("d")).select("doc_id", "text", "d.*").collect()
        assert len(out) == len(odd_rows)
        for r in out:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
            assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    back = odd_docs.select("text", bpe.decode_column(NAME)(bpe.encode_column(NAME)("text")).alias("again")).collect()
    assert all(r["text"] == r["again"] for r in back)
    assert no_docs.select(bpe.encode_column(NAME)("text")).count() == 0
