"""Alignment of two tokenizers over the same texts, by deduplicated segments.

A text is cut before white-space runs that follow other characters, before those characters only for which both
vocabularies prove that no entry can hold the cut (:func:`borders`): no merge crosses it, so each segment has the tokens
that it has within its text. Distinct segments of the whole corpus are tokenised and aligned once, by byte offsets; their
alignments are joined back and composed by document. Ends of segments are ends of tokens on both sides, so groups, links
and counts of a document are those of its segments, one after the other.

At scale: documents are read once, in blocks of ``BLOCK`` characters or one longer document, and become lists of the block's
segment numbers. What is shuffled is a row for each distinct segment of a block, never one for each occurrence, and the
lists. Rows of one segment, at most one a block, meet sorted in a task that streams through them; it aligns the segment once
and sends the alignments on packed by block: ids, and which side ends at each step. The number of documents that hold a
pair of ids linked is counted by block first. Nothing is sent to the driver, and no table is broadcast. The tables and the
shuffle files of the first half are dropped before the second.

Edge cases: a text that is null or empty, or whose joined tokens of either side do not give the text again (U+2581 is a
space to the second), has no tokens: zeros and no groups, and its links count nowhere. Special tokens' strings are plain
text. A text without white space is one segment of any length. Each row is a document, repeated ones and those without an
id too. Further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet, vocabulary_path
from .common import materialize, scratch

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 12_000_000  # characters of a block's documents, about
STEP = 4096  # segments tokenised at once
HELD = 200_000  # rows that a task packs at once, about
FLAT = 400_000  # segment occurrences whose pairs are counted at once, about
CANDIDATES = " \n\t\r"  # white space before which a text may be cut, where that is proven
#: White space by any notion that the pre-tokenizers of the first kind have, and format characters beside it.
WHITE = "\\s\x1c-\x1f\x85\u180e\u200b\ufeff"
CODED = "block long, row int, doc_id long, size int, code binary, idx int, segment string"
PACKED = "block long, packed binary"
COMPOSED = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, packed binary, found binary"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def to_varint(x: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2^56 as bytes of seven bits, and where each ends."""
    x = x.astype(np.int64)
    size, k, most = np.ones(len(x), np.int64), 1, int(x.max()) if len(x) else 0
    while most >> 7 * k:
        size += x >= 1 << 7 * k
        k += 1
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        on = np.flatnonzero(size > k)
        out[ends[on] - size[on] + k] = (x[on] >> 7 * k) & 127 | np.where(size[on] > k + 1, 128, 0)
    return out.tobytes(), ends


def from_varint(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def pack(*lists: np.ndarray) -> bytes:
    """Lists of numbers in one string of bytes."""
    parts = [to_varint(x)[0] for x in lists]
    return np.array([len(x) for x in parts], "<u8").tobytes() + b"".join(parts)


def unpack(raw: bytes, number: int) -> list[np.ndarray]:
    ends = np.r_[0, np.cumsum(np.frombuffer(raw, "<u8", number))].astype(np.int64) + 8 * number
    return [from_varint(raw[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def joined(each: list[list[np.ndarray]], number: int) -> list[np.ndarray]:
    """The lists of several strings, one after the other."""
    return [np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.int64) for k in range(number)]


def unpack_all(raws: list[bytes], number: int) -> list[np.ndarray]:
    return joined([unpack(raw, number) for raw in raws], number)


def gather(upto: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``values``, whose ends are ``upto`` (from 0), one after the other."""
    size = upto[which + 1] - upto[which]
    ends = np.cumsum(size)
    return values[np.repeat(upto[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers, as libraries load them, and the bytes of their ids."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {c: i for i, c in enumerate(byte_alphabet())}
        with open(first, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.bytes_a[i] = bytes(back[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("\u2581")
        self.breaks = borders(self.bytes_a, self.bytes_b)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids on both sides of segments that begin with one of the borders. The second tokenizer adds a space itself."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        spaced = [s[0] == " " for s in segments]
        b = self.b.encode([s[1:] if own else s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        # An empty rest is a lone space; before another border the added space stands by itself, and goes.
        return a, [ids or [self.space] if own else ids[1:] for ids, own in zip(b, spaced, strict=True)]

    def align(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Of distinct segments the number of links (0 where the tokens do not give the segment again) and of ids, then all
        steps and ids one after the other. Between two neighbouring ends of either side lies the overlap of one pair, and
        each overlap lies between two; a step says which side ends there: 1 the first, 2 the second, 3 both."""
        a, b = self.encode(segments)
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == t.encode() == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, t in zip(a, b, segments, strict=True)]
        at = [i for i, ok in enumerate(good) if ok]
        ids_a, ids_b = (np.array([i for k in at for i in x[k]], np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        both = np.union1d(ends_a, ends_b)
        step = np.isin(both, ends_a, assume_unique=True) + 2 * np.isin(both, ends_b, assume_unique=True)
        ends = np.cumsum([len(segments[k].encode()) for k in at])
        out = np.zeros((3, len(segments)), np.int64)
        for row, x in zip(out, (both, ends_a, ends_b), strict=True):
            row[at] = np.diff(np.r_[0, np.searchsorted(x, ends, "right")])
        return (*out, step, ids_a, ids_b)


def borders(bytes_a: list[bytes], bytes_b: list[bytes]) -> str:
    """The characters before which a text may be cut if no white space stands before them.

    Of ``CANDIDATES``, those that no entry of either vocabulary holds after anything but white space (half of a character
    is not white space). For those other than the space, no entry of the second may hold them after a space, so that the
    space which it adds stays alone. The pre-tokenizer of the first kind ends a word before any white space that
    follows other characters, and looks no further than to the next white space.
    """
    unsafe, white = set(), re.compile(f"[{WHITE}]")
    for tokens, spaced in ((bytes_a, False), (bytes_b, True)):
        for token in tokens:
            text = token.decode("utf-8", "surrogateescape")
            unsafe.update(c for before, c in zip(text, text[1:], strict=False) if not white.match(before) or spaced and before == " " != c)
    return "".join(c for c in CANDIDATES if c not in unsafe)


def cutter(breaks: str):
    """A function from a text to its segments."""
    if " " not in breaks:
        return lambda text: [" " + text]
    inside = "".join(map(re.escape, breaks))
    simple = re.compile(f"[{inside}]*[^{inside}]+|[{inside}]+").findall
    mixed = re.compile(f"(?![{inside}])[{WHITE}][{inside}]").search  # other white space before a border
    strict = re.compile(f"(?<=[^{WHITE}])(?=[{inside}])").split

    def cut(text: str) -> list[str]:
        text = " " + text
        return strict(text) if mixed(text) else simple(text)

    return cut


_loaded: dict[tuple[str, str], Pair] = {}


def load(first: str, second: str) -> Pair:
    """The tokenizers, once per Python worker. Names are resolved where the task runs."""
    if (first, second) not in _loaded:
        _loaded[first, second] = Pair(vocabulary_path(first), vocabulary_path(second))
    return _loaded[first, second]


def _frame(columns: dict, n: int, schema: str) -> pd.DataFrame:
    """``n`` rows of a schema; columns that are not given are null."""
    out = {}
    for name, kind in (c.split() for c in schema.split(", ")):
        dtype = {"int": "Int32", "long": "Int64"}.get(kind, object)
        out[name] = pd.Series(columns.get(name, [None] * n), index=range(n), dtype=dtype)
    return pd.DataFrame(out)


def _coded(block: int, ids: list, lists: list[np.ndarray], index: dict[str, int]) -> Iterator[pd.DataFrame]:
    flat, names = np.concatenate([*lists, np.zeros(0, np.int32)]), list(index)
    order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")  # frequent segments get short numbers
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names), dtype=np.int32)
    raw, ends = to_varint(rank[flat])
    upto = np.r_[0, np.cumsum(list(map(len, lists)))].astype(np.int64)
    cut = np.r_[0, ends][upto].tolist()
    rows = {"block": block, "row": np.arange(len(ids)), "doc_id": pd.array(ids, "Int64"), "size": np.diff(upto), "code": [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]}
    yield _frame(rows, len(ids), CODED)
    for k in range(0, len(names), 50_000):
        part = [names[i] for i in order[k : k + 50_000].tolist()]
        yield _frame({"block": block, "idx": np.arange(k, k + len(part)), "segment": part}, len(part), CODED)


def encode_blocks(first: str, second: str):
    """Documents to blocks: a row for each document, with the numbers of its segments, and one for each distinct segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, block = cutter(load(first, second).breaks), TaskContext.get().partitionId() << 32
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        ids, lists, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                segments = cut(text) if text else []
                lists.append(np.fromiter(map(index.__getitem__, segments), np.int32, len(segments)))
                chars += len(text or "")
                if chars >= BLOCK:
                    yield from _coded(block, ids, lists, index)
                    index.clear()
                    ids, lists, chars, block = [], [], 0, block + 1
        if ids:
            yield from _coded(block, ids, lists, index)

    return run


def _by_block(block: np.ndarray, lists) -> pd.DataFrame:
    """``PACKED``: rows in the order of their blocks; ``lists(i, j)`` gives what is packed of rows i to j."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[starts[1:], len(block)].tolist()
    return pd.DataFrame({"block": block[starts], "packed": [pack(*lists(i, j)) for i, j in zip(starts.tolist(), ends, strict=True)]})


def _aligned(held: list[tuple], blocks: list[np.ndarray], numbers: list[np.ndarray], which: list[np.ndarray]) -> pd.DataFrame:
    """Rows of segments by block, in the order of their numbers: steps from one number to the next, links, steps and ids."""
    block, idx, d = np.concatenate(blocks), np.concatenate(numbers), np.concatenate(which)
    order = np.lexsort((idx, block))
    block, idx, d = block[order], idx[order], d[order]
    sizes = [np.concatenate([x[k] for x in held]) for k in range(3)]
    ends = [np.r_[0, np.cumsum(n)] for n in sizes]
    values = [gather(e, np.concatenate([x[k + 3] for x in held]), d) for k, e in enumerate(ends)]
    upto = [np.r_[0, np.cumsum(n[d])] for n in sizes]
    return _by_block(block, lambda i, j: [np.diff(idx[i:j], prepend=0), sizes[0][d[i:j]], *(v[u[i] : u[j]] for v, u in zip(values, upto, strict=True))])


def align_segments(first: str, second: str):
    """Sorted rows (segment, block, idx) to packed alignments by block; a segment is tokenised once a batch of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, held, blocks, numbers, which, rows, many = load(first, second), [], [], [], [], 0, 0
        for batch in batches:
            segment = batch["segment"].to_numpy()
            if not len(segment):
                continue
            new = np.r_[True, segment[1:] != segment[:-1]]
            distinct = segment[new].tolist()
            for k in range(0, len(distinct), STEP):
                held.append(pair.align(distinct[k : k + STEP]))
            blocks.append(batch["block"].to_numpy())
            numbers.append(batch["idx"].to_numpy())
            which.append(np.cumsum(new) - 1 + many)
            rows, many = rows + len(segment), many + len(distinct)
            if rows >= HELD:
                yield _aligned(held, blocks, numbers, which)
                held, blocks, numbers, which, rows, many = [], [], [], [], 0, 0
        if rows:
            yield _aligned(held, blocks, numbers, which)

    return run


def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of the stretches that end at ``upto``, empty ones included."""
    return np.diff(np.r_[0, np.cumsum(values)][upto])


def _lists(sizes: list[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)].astype(np.int64)


@lru_cache(maxsize=2)
def _names(n: int) -> tuple[list[str], np.ndarray]:
    """Numbers below ``n`` with each of the marks that may follow, and their lengths."""
    names = [f"{i}{mark}" for i in range(n) for mark in ",|;"]
    return names, np.array(list(map(len, names)))


def _strings(step: np.ndarray, upto: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[str]:
    """The groups of each stretch of steps, each with the mark that ends it."""
    both, of = step == 3, lambda bit: np.flatnonzero(step & bit)
    group = np.cumsum(both) - both
    group_a, group_b = group[of(1)], group[of(2)]
    n = int(both.sum())
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    last = lambda g: np.r_[g[1:] != g[:-1], True][: len(g)]
    codes = np.empty(len(a) + len(b), np.int64)  # both sides of each group, one group after the other
    codes[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a * 3 + last(group_a)
    codes[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b * 3 + 2 * last(group_b)
    names, sizes = _names(int(max(a.max(initial=0), b.max(initial=0))) | 4095)  # few sizes of the table
    tokens = np.r_[0, np.cumsum((step & 1) + (step >> 1))][upto]  # of each stretch
    chars = np.r_[0, np.cumsum(sizes[codes])][tokens]
    out = []
    for k in range(0, len(upto) - 1, 100_000):
        m = min(k + 100_000, len(upto) - 1)
        text = "".join(map(names.__getitem__, codes[tokens[k] : tokens[m]].tolist()))
        cut = (chars[k : m + 1] - chars[k]).tolist()
        out += [text[i:j] for i, j in zip(cut, cut[1:], strict=False)]
    return out


def compose_block(digest: bool):
    """Documents of a block from the alignments of its segments, and how many of them hold each pair of ids linked."""

    def run(docs: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("row")
        upto = _lists(docs["size"].tolist())
        packed = [unpack(raw, 5) for raw in segments["packed"]]
        for one in packed:
            one[0] = np.cumsum(one[0])
        idx, links, step, a, b = joined(packed, 5)
        del packed
        n = len(idx)
        place = np.zeros(n, np.int64)
        place[idx] = np.arange(n)
        flat = place[from_varint(b"".join(docs["code"]))]  # occurrences, as rows of the alignments
        of = np.r_[0, np.cumsum(links)]  # links of each segment
        whole = (_sums((links == 0)[flat], upto) == 0) & (np.diff(upto) > 0)
        sums = [np.where(whole, _sums(_sums(x, of)[flat], upto), 0) for x in (step & 1, step >> 1, step == 3)]
        sums.append(np.where(whole, _sums(links[flat], upto), 0))
        strings, groups = _strings(step, of, a, b), []
        for ok, i, j in zip(whole.tolist(), upto.tolist(), upto[1:].tolist(), strict=False):
            text = "".join(map(strings.__getitem__, flat[i:j].tolist()))[:-1] if ok else ""
            groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and ok else text)
        del strings
        ends_a, ends_b = step & 1, step >> 1
        keys, pair = np.unique(a[np.cumsum(ends_a) - ends_a] << 32 | b[np.cumsum(ends_b) - ends_b], return_inverse=True)
        df, p, k = np.zeros(len(keys), np.int64), max(1, len(keys)), 0
        while k < len(docs):
            m = max(k + 1, int(np.searchsorted(upto, upto[k] + FLAT, "right")) - 1)
            owner = np.repeat(np.arange(m - k), np.diff(upto[k : m + 1]))
            on = whole[k:m][owner]
            doc, segment = np.divmod(np.unique(owner[on] * n + flat[upto[k] : upto[m]][on]), max(1, n))  # segments of each document
            both = np.unique(np.repeat(doc, links[segment]) * p + gather(of, pair, segment))  # pairs of each document
            df += np.bincount(both % p, minlength=p)[: len(keys)]
            k = m
        block = docs["block"].iloc[0]
        rows = {"block": block, "row": docs["row"].to_numpy(), "doc_id": docs["doc_id"].to_numpy(), "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups": groups}
        known = {"block": block, "packed": [pack(idx, links, pair)], "found": [pack(keys >> 32, keys & 0xFFFFFFFF, df)]}
        return pd.concat([_frame(rows, len(docs), COMPOSED), _frame(known, 1, COMPOSED)], ignore_index=True)

    return run


def found_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of ids of each block, numbered, with their documents there."""
    for batch in batches:
        for block, raw in zip(batch["block"], batch["found"], strict=True):
            a, b, df = unpack(raw, 3)
            on = np.flatnonzero(df)
            for k in range(0, len(on), 100_000):
                i = on[k : k + 100_000]
                yield pd.DataFrame({"block": block, "pair": i, "a": a[i], "b": b[i], "df": df[i]})


def pack_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of pairs, packed by block; the last bit says that the count is its first id's highest."""

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held).sort_values("block", kind="stable")
        pair, count = rows["pair"].to_numpy(), (2 * rows["count"] + rows["best"]).to_numpy()
        return _by_block(rows["block"].to_numpy(), lambda i, j: [pair[i:j], count[i:j]])

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD:
            yield packed(held)
            held = []
    if held and sum(map(len, held)):
        yield packed(held)


def count_block(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Sums of the corpus-wide counts over the links of each document."""
    own = docs["packed"].notna()
    idx, links, pair = unpack_all(docs.loc[own, "packed"].tolist(), 3)
    which, value = unpack_all(counts["packed"].tolist(), 2)
    known = np.zeros(int(pair.max(initial=0)) + 1, np.int64)  # pairs of texts without tokens stay 0
    known[which] = value
    of = np.r_[0, np.cumsum(links)]
    count, best = np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
    count[idx], best[idx] = _sums(known[pair] >> 1, of), _sums(known[pair] & 1, of)
    listed = docs["code"].notna()
    lists, docs = docs[listed].sort_values("row"), docs[~own & ~listed].sort_values("row")
    flat, upto = from_varint(b"".join(lists["code"])), _lists(lists["size"].tolist())
    whole = docs["n_links"].to_numpy() > 0
    docs = docs.assign(n_best=np.where(whole, _sums(best[flat], upto), 0), count_sum=np.where(whole, _sums(count[flat], upto), 0))
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    return docs[[c.split()[0] for c in COUNTED.split(", ")]]


def align_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND, digest: bool = False) -> DataFrame:
    """``COUNTED`` of every row of ``docs`` (doc_id, text); ``digest`` gives the SHA-256 of the groups in their place."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch() as keep:
        coded = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(encode_blocks(first, second), CODED), "coded", "zstd")
        segments = coded.filter(F.col("segment").isNotNull()).select("segment", "block", "idx")
        sorted_ = segments.repartition(tasks, "segment").sortWithinPartitions("segment")
        aligned = sorted_.mapInPandas(align_segments(first, second), PACKED)
        lists = coded.filter(F.col("row").isNotNull()).select("block", "row", "doc_id", "size", "code")
        composed = lists.groupBy("block").cogroup(aligned.groupBy("block")).applyInPandas(compose_block(digest), COMPOSED)
        keep(coded, composed := materialize(composed, "composed", "zstd"))
    found = composed.filter(F.col("found").isNotNull()).select("block", "found").mapInPandas(found_pairs, "block long, pair int, a int, b int, df long")
    counts = found.groupBy("a", "b").agg(F.sum("df").alias("count"))
    best = (F.col("count") == F.max("count").over(W.partitionBy("a"))).cast("long")  # at most one row an id of the second
    known = found.select("a", "b", "block", "pair").join(counts.withColumn("best", best), ["a", "b"]).select("block", "pair", "count", "best").mapInPandas(pack_counts, PACKED)
    rows = composed.drop("found").unionByName(lists.drop("doc_id"), allowMissingColumns=True)
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(count_block, COUNTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents aligned, their groups digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_documents(docs, digest=True).withColumnRenamed("groups", "groups_sha256")
