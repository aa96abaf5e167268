"""Language identification by naive Bayes over character trigrams.

A text is read in lower case, with digits and white space each as one character; its trigrams are hashed into ``BUCKETS``.
The model is a table of the logarithm of each bucket's share in each language, with ``SMOOTH`` added to every count: ``BUCKETS``
numbers a language, whatever the number of rows, which go to every task. A text gets the language under which its trigrams
are likeliest, each language being as likely beforehand, and the margin to the next one in nats a trigram.

Fitting reads every labelled row and knows every label. It counts by partition before anything is shuffled; a task holds the counts
of ``HELD`` labels and hands on what it has when it meets more.

Edge cases: texts that are null or shorter than three characters have no language and a null margin; rows without a label
or an id are not learned from; a label whose texts have no trigrams is known all the same; ties go to the first label; very long texts are counted whole, in pieces; a model without languages knows none; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
HELD = 64  # labels whose counts a task holds at once
SMOOTH = 0.5
PIECE = 1 << 20  # characters that are counted at once


@dataclass(frozen=True)
class Languages:
    """``logs`` has a row a language."""

    names: tuple[str, ...]
    logs: np.ndarray


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's trigrams, piece by piece."""
    for k in range(0, max(1, len(text) - 2), PIECE):
        c = np.frombuffer(text[k : k + PIECE + 2].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        c = np.where((c <= 32) | (c == 0xA0), 32, np.where((c >= 48) & (c <= 57), 48, c)).astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B1)) ^ (c[1:-1] * np.uint64(0x85EBCA77) << np.uint64(7)) ^ (c[2:] * np.uint64(0xC2B2AE3D) << np.uint64(13))
        yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64) % BUCKETS


def counted(text: str | None) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for b in buckets(text or ""):
        out += np.bincount(b, minlength=BUCKETS)
    return out


def label_counts(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(label, b, n) of batches of (label, text), a label's counts in one or more parts; its first bucket is always there."""
    tables: dict[str, np.ndarray] = {}

    def parts() -> Iterator[pa.RecordBatch]:
        for name, table in tables.items():
            b = np.union1d(np.flatnonzero(table), [0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(table[b])], ["label", "b", "n"])
        tables.clear()

    for batch in batches:
        for name, body in zip(*batch.columns, strict=True):  # a text at a time is held as Python's
            name = name.as_py()
            if name not in tables and len(tables) >= held:
                yield from parts()
            table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
            for found in buckets(body.as_py() or ""):
                np.add.at(table, found, 1)
    yield from parts()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Languages:
    """The model of all of ``docs`` (``key``, ``text``, ``label``)."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = rows.mapInArrow(label_counts, "label string, b int, n long").groupBy("label", "b").agg(F.sum("n").alias("n")).toArrow()  # bounded by the size of the model
    labels = counts["label"].combine_chunks().dictionary_encode()
    found = labels.dictionary.to_pylist()
    names = tuple(sorted(found))
    place = {n: i for i, n in enumerate(names)}
    table = np.full((len(names), BUCKETS), SMOOTH)
    if names:
        table[np.array([place[n] for n in found])[labels.indices.to_numpy()], counts["b"].to_numpy()] += counts["n"].to_numpy()
    return Languages(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def score(text: str | None, model: Languages) -> tuple[str | None, float | None]:
    """The likeliest language, and how much likelier a trigram is under it than under the next, in nats."""
    if text is None or len(text) < 3 or not model.names:
        return None, None
    n = counted(text)
    on = np.flatnonzero(n)
    logs = model.logs[:, on].astype(np.float64) @ n[on]
    best = int(np.argmax(logs))
    rest = np.delete(logs, best)
    return model.names[best], float((logs[best] - rest.max()) / n.sum()) if len(rest) else 0.0


def identified(batches: Iterator[pa.Array], model: Languages) -> Iterator[pa.Array]:
    for texts in batches:
        got = [score(t.as_py(), model) for t in texts]
        found = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64()))]
        yield pa.StructArray.from_arrays(found, ["language", "margin"])


def identify(text: Column, model: Languages) -> Column:
    """A struct of language and margin. Python holds one text of an Arrow batch at a time."""

    @F.arrow_udf("struct<language:string,margin:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return identified(batches, model)

    return run(text)
