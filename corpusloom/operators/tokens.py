"""Tokenizers and the expressions around their ids."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids of the special tokens; ordinary ids are shifted past them.
SPECIAL = {
    "<|pad|>": 0, "<|bos|>": 1, "<|eos|>": 2, "<|sep|>": 3, "<|sys|>": 4, "<|/sys|>": 5, "<|usr|>": 6, "<|/usr|>": 7,
    "<|asst|>": 8, "<|/asst|>": 9, "<|tool|>": 10, "<|tool_resp|>": 11, "<|unk|>": 12,
}
PAD, BOS, EOS = 0, 1, 2
OFFSET = 13
PROFILE_SIZES = {"standard": 206_373}
OTHER_PROFILE_SIZE = 50_000
PIECE = 1 << 18  # ids of an Arrow array that Python makes, about


def vocabulary_size(profile: str = "standard") -> int:
    """Ordinary and special ids, rounded up to a multiple of 128."""
    return ceil((PROFILE_SIZES.get(profile, OTHER_PROFILE_SIZE) + OFFSET) / 128) * 128


class Tokenizer:
    """What packing needs: ids of a text, unshifted, and back. Subclasses are small and picklable."""

    name = "tokenizer"

    def ids(self, text: str) -> Sequence[int]:
        raise NotImplementedError

    def text(self, ids: Sequence[int]) -> str:
        raise NotImplementedError


class CodePoints(Tokenizer):
    """One id a code point."""

    name = "code_points"

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def text(self, ids: Sequence[int]) -> str:
        return np.asarray(ids, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


class Utf8Bytes(Tokenizer):
    """One id a byte."""

    name = "bytes"

    def ids(self, text: str) -> list[int]:
        return list(text.encode("utf-8", "surrogatepass"))

    def text(self, ids: Sequence[int]) -> str:
        return bytes(ids).decode("utf-8", "replace")


def encoded_pieces(batches: Iterator[pa.Array], tokenizer: Tokenizer) -> Iterator[pa.Array]:
    """Lists of shifted ids, about ``PIECE`` ids in an array."""
    for batch in batches:
        ends, ids = [0], bytearray()
        for k in range(len(batch)):
            t = batch[k].as_py()
            if t:
                ids += memoryview(np.asarray(tokenizer.ids(t)).astype("<i4") + np.int32(OFFSET)).cast("B")
            ends.append(len(ids) // 4)
            if ends[-1] >= PIECE or k == len(batch) - 1:
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                ends, ids = [0], bytearray()


def encode(text: Column, tokenizer: Tokenizer = CodePoints()) -> Column:
    """Shifted ids; null and empty texts have none.

    Runs over Arrow batches. Python holds one text as objects, and about ``PIECE`` ids, whatever the batch.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return encoded_pieces(batches, tokenizer)

    return run(text)


def decode(ids: Column, tokenizer: Tokenizer = CodePoints(), skip_special: bool = True) -> Column:
    """The text of ordinary ids. With ``skip_special`` off, special tokens are joined by spaces in front of it.

    Python holds one row as objects, and texts of about ``PIECE`` ids, whatever the batch.
    """
    names = {i: n for n, i in SPECIAL.items()}

    def one(row: np.ndarray) -> str:
        ordinary = row >= OFFSET
        plain = tokenizer.text((row[ordinary] - OFFSET).tolist())
        special = "" if skip_special else " ".join(names[i] for i in row[~ordinary].tolist())
        return special + plain if not special or not plain else f"{special} {plain}"

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held = [], 0
            for k in range(len(batch)):
                row = batch[k].values
                out.append(None if row is None else one(row.to_numpy(zero_copy_only=False)))
                held += 0 if row is None else len(row)
                if held >= PIECE or k == len(batch) - 1:
                    yield pa.array(out, pa.string())
                    out, held = [], 0

    return run(ids)


def shift(ids: Column) -> Column:
    return F.transform(ids, lambda i: i + OFFSET)


def unshift(ids: Column) -> Column:
    """Ordinary ids back to the tokenizer's; special ids become null."""
    return F.transform(ids, lambda i: F.when(i >= OFFSET, i - OFFSET))


def wrap(ids: Column, bos: bool = True, eos: bool = True, max_length: int | None = None) -> Column:
    """Ids between their markers; cut to ``max_length`` afterwards, so the end marker can go."""
    parts = [F.array(F.lit(BOS))] * bos + [ids] + [F.array(F.lit(EOS))] * eos
    out = F.concat(*parts) if len(parts) > 1 else ids
    return F.slice(out, 1, max_length) if max_length else out


def pad_to(ids: Column, length: Column | int, value: int = PAD) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), n - F.size(ids)).cast("int")))


def pad_batch(rows: DataFrame, batch: str, ids: str = "ids", multiple: int = 8) -> DataFrame:
    """``input_ids`` and ``attention_mask`` padded to the longest row of the batch, rounded up to ``multiple``."""
    longest = F.max(F.size(ids)).over(W.partitionBy(batch))
    target = (F.ceil(longest / multiple) * multiple).cast("int")
    padded = rows.withColumn("_n", target)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_n") - F.size(ids)))
    return padded.withColumn("input_ids", pad_to(F.col(ids), F.col("_n"))).withColumn("attention_mask", mask).drop("_n")


@dataclass(frozen=True)
class TokenizerConfig:
    """What is saved beside tokenized data; keys that are not known are ignored on loading."""

    tokenizer: str = "code_points"
    profile: str = "standard"
    max_length: int | None = None
    vocab_size: int = vocabulary_size()
    special_offset: int = OFFSET

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> TokenizerConfig:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})
