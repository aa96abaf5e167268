"""Packing documents into sequences of fixed size: dominance reduction, then best fit.

A document's token ids are followed by one separator; only documents longer than a sequence are cut. What remains is bin
packing, and it depends on the lengths only: the number of pieces of each length is a table of at most ``capacity``
rows. On that table the Martello-Toth reduction fixes sets that dominate every alternative (a piece nothing fits beside,
two pieces that fill a sequence exactly, a pair where no third piece fits and the partner is the largest that fits, or a
partner at least as large as any two that fit together), again and again until nothing more can be fixed; best fit by
falling length packs the remainder. Whole runs of equal sets are fixed in one step, so the work grows with the capacity
and not with the corpus.

Full pieces, nearly all of a corpus of long texts, are sequences as they stand. Spark numbers the other pieces of each
length, in hash buckets whose number grows with the pieces of that length, and looks each number up in the plan.

Edge cases: null and empty texts are one separator; a text of many sequences, however long, is cut into full pieces and a
rest; repeated rows are packed one by one and tied pieces (equal lengths) in the order of id, piece and checksum, rows
equal in all of these in any order; further columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import CACHE, LONG, pack_ids, vocabulary_path
from .common import materialize

CAPACITY = 2048
SEPARATOR = 0
NUMBERED = 1 << 16  # pieces of one length that are numbered together, about
LATIN = re.compile("[\x00-\xff]*")
STEP = 512
LOWER = np.array([32 if c == 10 else ord(chr(c).lower()) for c in range(256)], np.uint8)  # and line ends as spaces
LETTER = np.array([chr(c).isalpha() for c in range(256)])
CHUNK = 1 << 21  # characters that are encoded together, about


# --- the plan, on counts of lengths --------------------------------------------------------------------------------


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(sequences, {length: pieces in each}) fixed for good, and the counts that remain."""
    left = {n: c for n, c in counts.items() if c}
    sizes, fixed = sorted(left), []

    def fix(times: int, *lengths: int) -> None:
        content: dict[int, int] = {}
        for n in lengths:
            content[n] = content.get(n, 0) + 1
        fixed.append((times, content))
        for n, k in content.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                sizes.pop(bisect_left(sizes, n))

    def smallest(but: int, k: int) -> list[int]:
        """The k smallest pieces beside one of length ``but``."""
        out: list[int] = []
        for n in sizes:
            out += [n] * min(k - len(out), left[n] - (n == but))
            if len(out) == k:
                break
        return out

    def times(j: int, k: int) -> int:
        return left[j] // 2 if j == k else min(left[j], left[k])

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room, low = capacity - j, smallest(j, 3)
                if not low or low[0] > room:
                    fix(left[j], j)
                elif room in left and times(j, room):
                    fix(times(j, room), j, room)
                else:
                    at = bisect_left(sizes, room + 1) - 1
                    if sizes[at] == j and left[j] < 2:
                        at -= 1
                    k = sizes[at]
                    two_fit = len(low) > 1 and low[0] + low[1] <= room
                    three_fit = len(low) > 2 and sum(low) <= room
                    if two_fit and (three_fit or best_pair(sizes, left, j, room) > k):
                        break
                    fix(times(j, k), j, k)  # still true after each: pieces only go, and k stays the largest
                changed = True
    return fixed, left


def best_pair(sizes: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two pieces beside ``j`` that is within ``room``; 0 if no two fit."""
    best = 0
    there = lambda *lengths: all(left[n] >= lengths.count(n) for n in lengths)
    for a in sizes:
        at = bisect_left(sizes, room - a + 1) - 1
        while at >= 0 and sizes[at] >= a and not there(a, sizes[at], j):
            at -= 1
        if at >= 0 and sizes[at] >= a:
            best = max(best, a + sizes[at])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit by falling length; sequences of equal content are handled as one entry."""
    room: dict[int, list[list]] = {}  # free tokens: [[sequences, content], ...]
    free: list[int] = []

    def put(space: int, times: int, content: dict[int, int]) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append([times, content])

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(free, n)
            if at == len(free):
                space, times, content = capacity, todo, {}
            else:
                space = free[at]
                times, content = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(at)
            each = space // n
            full = min(times, todo // each)
            if full:
                put(space - each * n, full, content | {n: each})
                todo -= full * each
            rest = todo if times > full else 0  # fewer than ``each``: they go into one more sequence
            if rest:
                put(space - rest * n, 1, content | {n: rest})
                todo = 0
            if content and times - full - bool(rest):
                put(space, times - full - bool(rest), content)
    return [(times, content) for entries in room.values() for times, content in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces in each sequence, first sequence, first offset) and the number of sequences."""
    fixed, left = reduce_dominated(counts, capacity)
    rows, used, at = [], dict.fromkeys(counts, 0), 0
    for times, content in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for n in sorted(content, reverse=True):
            rows.append((n, used[n], content[n], at, offset))
            used[n] += times * content[n]
            offset += n * content[n]
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), at


def _spaced(texts: list[str]) -> str:
    """Texts of characters below U+0100 in lower case, NUL as a piece after each, full stops and commas apart from the letter
    before them where a space follows: each distinct word then occurs in one form."""
    codes = LOWER[np.frombuffer(" \0 ".join([*texts, ""]).encode("latin-1"), np.uint8)][:-1]
    if len(codes) < 3:
        return codes.tobytes().decode("latin-1")
    stop = (codes == 46) | (codes == 44)
    at = np.flatnonzero(stop[1:-1] & (codes[2:] == 32) & LETTER[codes[:-2]]) + 1
    return np.insert(codes, at, 32).tobytes().decode("latin-1")


# --- tokens --------------------------------------------------------------------------------------------------------


class Words:
    """Ids by the tokenizers library.

    No token of this vocabulary spans white space, and the last token of each of its words is marked. So what stands
    between spaces is encoded once if it occurs again, many in one call, and the ids are told apart by counting marks.
    That holds where all characters are below U+0100, which normalization leaves alone but for their case; others go to
    the library one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        last = {i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}
        self.last = np.isin(np.arange(self.tok.get_vocab_size(with_added_tokens=True)), list(last))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed value: the vocabulary's words
        self.known: dict[str, bytes] = {}

    def _count(self, piece: str) -> int:
        """Words of the pattern; letters alone, and letters before a full stop or comma, need no search."""
        if piece.isalpha():
            return 1
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return 2
        return len(self.split.findall(piece))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of what stands between two spaces."""
        plain, other = [], []
        for k, p in enumerate(pieces):
            (plain if (p.isascii() or LATIN.fullmatch(p)) and p.isprintable() and "<|" not in p else other).append(k)
        out = [b""] * len(pieces)
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            some = [pieces[i].lower() for i in part]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends, counts = 4 * np.flatnonzero(self.last[ids]) + 4, np.cumsum([0, *map(self._count, some)])
            if len(ends) != counts[-1]:
                other += part
                continue
            raw, at = ids.tobytes(), np.r_[0, ends][counts].tolist()
            for i, a, b in zip(part, at, at[1:], strict=False):
                out[i] = raw[a:b]
        for k, e in zip(other, self.tok.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = pack_ids(e.ids)
        return out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        if len(self.known) > CACHE:
            self.known = {}
        out = list(map(self.known.get, pieces))
        open_ = [i for i, ids in enumerate(out) if ids is None]
        new = [pieces[i] for i in open_]
        for i, p, ids in zip(open_, new, self._encode_pieces(new), strict=True):
            out[i] = ids
            if len(p) <= LONG:
                self.known[p] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts, as unsigned little-endian numbers of 32 bits."""
        ends, out = np.cumsum([len(t) for t in texts]), []
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
            out += self._encode_texts([texts[i] for i in part])
        return out

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        """Each distinct piece is looked up once; its ids are then copied, by array, to all its places."""
        is_plain = [(t.isascii() or bool(LATIN.fullmatch(t))) and "<|" not in t and "\0" not in t for t in texts]
        joined = _spaced([t for t, ok in zip(texts, is_plain, strict=True) if ok])
        others = [t.replace("\n", " ") for t, ok in zip(texts, is_plain, strict=True) if not ok]
        plain, other = (pc.split_pattern(pa.array(x, pa.large_string()), " ") for x in ([joined], others))
        pieces = pa.concat_arrays([plain.flatten(), other.flatten()]).dictionary_encode()
        words, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        packed = self._look_up(words)

        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(packed), "<u4")
        n = sizes[at]
        ends = np.r_[0, np.cumsum(n)]
        raw = ids[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], n)].tobytes()

        n_plain = len(plain.flatten())
        marks = np.flatnonzero(at[:n_plain] == words.index("\0")) if any(is_plain) else np.zeros(0, np.int64)
        offsets = n_plain + other.offsets.to_numpy()
        first, last = np.r_[0, marks + 1][: len(marks)], marks
        first, last = (4 * ends[np.r_[a, b].astype(np.int64)] for a, b in ((first, offsets[:-1]), (last, offsets[1:])))
        out = [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]  # plain texts, then the others
        order = np.argsort(np.r_[np.flatnonzero(is_plain), np.flatnonzero(~np.array(is_plain, bool))], kind="stable")
        return [out[k] for k in order]


_loaded: dict[str, Words] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(name: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = Words(vocabulary_path(name))
        words = _loaded[name]
        for batch in batches:
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            for k in range(0, batch.num_rows, STEP):
                rows = []
                for i, ids in enumerate(words.encode_batch([t or "" for t in texts[k : k + STEP].to_pylist()])):
                    ids += pack_ids([SEPARATOR])
                    n = len(ids) // 4
                    rows += [(k + i, p, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
                at, *cols = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                arrays = [ids_of.take(pa.array(at)), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PIECES.split(", ")])

    return cut


def cut_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(name, capacity), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read three times: pass a written table."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows, _ = plan({n: c for n, c in counts.items() if n < capacity}, capacity)
    keys = rows[:, 0] * (1 << 44) + rows[:, 1]

    # A full piece is a sequence of its own: it needs no place among the others of its length.
    full = F.col("length") == capacity
    alone = pieces.filter(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    parts = F.array([F.lit(1 + counts.get(n, 0) // NUMBERED) for n in range(1, capacity + 1)])
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts, F.col("length").cast("int")))
    bucketed = pieces.filter(~full).withColumn("bucket", bucket)
    sums = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each ``NUMBERED`` pieces of a length
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = bucketed.withColumn("nth", F.row_number().over(order) - 1).join(sums, ["length", "bucket"])

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * (1 << 44) + number.to_numpy(), side="right") - 1
        nth = number.to_numpy() - rows[at, 1]
        return pd.DataFrame({"sequence_id": rows[at, 3] + nth // rows[at, 2], "offset": rows[at, 4] + nth % rows[at, 2] * rows[at, 0]})

    placed = numbered.withColumn("at", place("length", F.col("before") + F.col("nth")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns[:5], "at.*").select(*columns).unionByName(alone.select(*columns))


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """All documents, cut and packed."""
    return pack(materialize(cut_documents(docs, name, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
