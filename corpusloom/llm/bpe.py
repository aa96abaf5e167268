"""Byte-level BPE, encoding and decoding, by speculation and verification.

For each distinct word, greedy longest match proposes tokens. A proposal is the exact encoding if no merge could have
crossed any border between adjacent tokens. A border is crossed when a piece on the right edge of the left token and a
piece on the left edge of the right token merge while both exist: the merge must come before either piece is merged
within its own token. Merges of one rank run from left to right, so a tie goes to the piece further left. The test runs
on arrays, over all adjacent pairs of a batch at once; only words with a crossed border are merged exactly.

A text is cut at single spaces first: such a place always is a border of the pre-tokenizer unless white space stands on
both sides of the space; texts with such a space are cut by the pattern as a whole. Word results are kept in a cache
of bounded size per Python worker.

Edge cases: null and empty texts have no tokens (the digest of the empty string); special tokens in a text are encoded
as their id; very long texts and words are encoded whole; repeated rows are encoded alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000  # entries after which a worker's cache is emptied before the next texts
LONG = 64  # words of more characters are not cached, those of more bytes merge by a heap


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Cache:
    """Packed ids of strings; emptied when it has ``CACHE`` entries. Long strings are looked up but not kept."""

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def look_up(self, cut: list[list]) -> list[list[bytes]]:
        """For each list of strings, the list of their packed ids."""
        if len(self.known) > CACHE:
            self.known = {}
        get = self.known.get
        out = [list(map(get, strings)) for strings in cut]
        open_ = [[i for i, ids in enumerate(got) if ids is None] for got in out]
        new = list({strings[i] for strings, at in zip(cut, open_, strict=True) for i in at})
        if new:
            fresh = dict(zip(new, self.encode(new), strict=True))
            for strings, got, at in zip(cut, out, open_, strict=True):
                for i in at:
                    got[i] = fresh[strings[i]]
            self.known.update((s, ids) for s, ids in fresh.items() if isinstance(s, str) and len(s) <= LONG)
        return out

    def join(self, cut: list[list]) -> list[bytes]:
        return list(map(b"".join, self.look_up(cut)))


class Bpe:
    """One vocabulary. ``encode`` and ``decode`` take and give whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max(*vocab.values(), *added.values()) + 1
        self.bytes_of = [b""] * n
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t)
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.longest: dict[bytes, int] = {}  # longest token that begins with these two bytes
        for t in self.id_of:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 1))
        self.special = added
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.wide_space = regex.compile(r"\s (?=\s|\Z)")
        self.ranks = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self._edges(vocab, merges, n)
        self.word_cache = Cache(lambda words: list(map(pack_ids, self.encode_words(words))))
        self.cache = Cache(self._encode_pieces)

    def _edges(self, vocab, merges, n: int) -> None:
        """For each token, the pieces along its right and left edge, with the rank at which each is merged away."""
        parts = np.full((n, 2), -1, np.int64)
        rank = np.full(n, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if rank[i] < 0:
                rank[i], parts[i] = r, (vocab[a], vocab[b])
        never = len(merges) + 1
        self.n, self.edge = n, []
        for side in (1, 0):
            piece, gone = np.arange(n), np.full(n, never)
            levels = []
            while (piece >= 0).any():
                levels.append((piece.copy(), gone.copy()))
                gone = np.where(piece >= 0, rank[piece], never)
                piece = np.where(piece >= 0, parts[piece, side], -1)
            self.edge.append(levels)
        keys = np.array([a * n + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        # A token whose own bytes merge to something else is never a proposal that can stand.
        two = np.flatnonzero(rank >= 0)
        self.sound = np.ones(n, bool)
        self.sound[two] = [self.merge(self.bytes_of[i]) == [i] for i in two.tolist()]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether no merge crosses its border."""
        good = self.sound[left] & self.sound[right]
        for piece_l, gone_l in self.edge[0]:
            x, until_x = piece_l[left], gone_l[left]
            if not (x >= 0).any():
                break
            for piece_r, gone_r in self.edge[1]:
                y = piece_r[right]
                on = np.flatnonzero((x >= 0) & (y >= 0) & good)
                if not len(on):
                    break
                keys = x[on] * self.n + y[on]
                at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[at] == keys, self.merge_ranks[at], np.iinfo(np.int64).max)
                good[on] &= ~((rank < until_x[on]) & (rank <= gone_r[right[on]]))
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        out, at, n, get, longest = [], 0, len(word), self.id_of.get, self.longest.get
        while at < n:
            end = min(n, at + longest(word[at : at + 2], 1))
            while (i := get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, the lowest rank first, from left to right within a rank."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        return self._merge_short(ids) if len(ids) <= LONG else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, never = self.ranks.get, len(self.ranks)
        ranks = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[ids[i], ids[i + 1]]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[a, b], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := self.ranks.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Exact ids of pre-tokenized words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [self.propose(w) for w in raw]
        many = [k for k, ids in enumerate(out) if len(ids) > 1]
        if many:
            flat = np.fromiter(chain.from_iterable(out[k] for k in many), np.int64)
            ends = np.cumsum([len(out[k]) for k in many])
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[:-1] - 1] = False  # from one word to the next
            at = np.flatnonzero(inner)
            pairs, back = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
            bad = at[~self.compatible(pairs // self.n, pairs % self.n)[back]]
            for j in np.unique(np.searchsorted(ends, bad, side="right")).tolist():
                out[many[j]] = self.merge(raw[many[j]])
        return out

    def _pieces(self, text: str) -> list[str]:
        """Cuts of a text that the pre-tokenizer makes too; each holds one or more of its words."""
        if self.wide_space.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [*map(" ".__add__, rest)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Exact ids of whole texts."""
        cut: list[list[str | int]] = []
        for text in texts:
            if self.split_special and any(s in text for s in self.special):
                parts = self.split_special.split(text)
                cut.append([x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self._pieces(part))])
            else:
                cut.append(self._pieces(text) if text else [])
        return [np.frombuffer(raw, "<u4") for raw in self.cache.join(cut)]

    def _encode_pieces(self, pieces: list[str | int]) -> list[bytes]:
        """Packed ids of pieces that the cache does not have."""
        words = [self.words.findall(p) if isinstance(p, str) else [] for p in pieces]
        got = self.word_cache.join(words)
        return [ids if isinstance(p, str) else pack_ids([p]) for p, ids in zip(pieces, got, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The vocabulary at ``path``, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


STEP = 256  # texts encoded at once, to bound memory


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(name: str):
    """text -> array<int> of ids, null for null. ``name`` is resolved where the task runs."""

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        bpe, texts = tokenizer(vocabulary_path(name)), text.tolist()
        got = [x for k in range(0, len(texts), STEP) for x in bpe.encode_batch([t or "" for t in texts[k : k + STEP]])]
        return pd.Series([None if t is None else x for t, x in zip(texts, got, strict=True)])

    return encode


def decode_column(name: str):
    """array<int> -> text, null for null."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = tokenizer(vocabulary_path(name))
        return pd.Series([None if x is None else bpe.decode(x) for x in ids])

    return decode


def digest_column(name: str):
    """text -> n_tokens and the digests of the ids and of the text that they decode to, in one pass."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(text: pd.Series) -> pd.DataFrame:
        bpe, texts = tokenizer(vocabulary_path(name)), text.tolist()
        names = getattr(bpe, "names", None) or [str(i) for i in range(bpe.n)]
        bpe.names = names
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        out = []
        for k in range(0, len(texts), STEP):
            for ids in bpe.encode_batch([t or "" for t in texts[k : k + STEP]]):
                ids = ids.tolist()
                out.append((len(ids), sha(",".join(map(names.__getitem__, ids))), sha(bpe.decode(ids))))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents encoded, decoded and digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digest_column("byte_bpe_50k.json")("text").alias("d")).select("doc_id", "d.*")
