"""Packing token streams into sequences of fixed length, and sharding them.

A stream buffer that emits whenever it is full is a prefix sum: a document that starts at token s of its stream covers
the sequences s div L to (s + n - 1) div L. Each document is cut at those borders and the cuts are put together by
sequence, so no stream passes through one task and nothing but a sequence's own tokens meets in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import key_digest
from ..functions.ordering import row_index, running_total
from ..functions.tables import written
from .tokens import PAD, wrap


def pack(
    docs: DataFrame,
    length: int,
    order: str = "doc_id",
    streams: tuple[str, ...] = (),
    bos: bool = True,
    eos: bool = True,
    keep_tail: bool = False,
    skip_empty: bool = False,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """(streams, seq_id, input_ids) from ``docs`` (streams, order, ids).

    ``streams`` have a buffer each, whose tail is dropped unless ``keep_tail`` pads it. ``skip_empty`` leaves out
    documents without tokens; otherwise they contribute their markers.
    """
    rows = docs.filter(F.size("ids") > 0) if skip_empty else docs
    rows = rows.select(*streams, order, *ties, wrap(F.col("ids"), bos, eos).alias("wrapped")).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "wrapped")  # tokens are made once, and rows are numbered
    # Lengths alone are put in order; tokens meet their place by the row's number.
    lengths = written(rows.select(*streams, order, *ties, "_row", F.size("wrapped").cast("long").alias("length")), "lengths")
    starts = running_total(lengths, F.col("length"), order, "start", streams, (*ties, "_row")).select("_row", "start")
    rows = rows.filter(F.size("wrapped") > 0).join(starts, "_row").drop("_row")
    n = F.size("wrapped")
    last = F.floor((F.col("start") + n - 1) / length)
    cut = rows.withColumn("seq_id", F.explode(F.sequence(F.floor(F.col("start") / length), last)))
    lo = F.greatest(F.col("seq_id") * length - F.col("start"), F.lit(0)).cast("int")
    hi = F.least((F.col("seq_id") + 1) * length - F.col("start"), n).cast("int")
    cut = cut.select(*streams, "seq_id", (F.col("start") + lo).alias("at"), F.slice("wrapped", lo + 1, hi - lo).alias("part"))
    whole = cut.groupBy(*streams, "seq_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    out = whole.select(*streams, "seq_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("input_ids"))
    if keep_tail:
        missing = (F.lit(length) - F.size("input_ids")).cast("int")
        return out.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD), missing)))
    return out.filter(F.size("input_ids") == length)


def pack_stats(docs: DataFrame, length: int, streams: tuple[str, ...] = (), bos: bool = True, eos: bool = True) -> DataFrame:
    """Sequences emitted, tokens consumed and what is left in the buffer, from lengths alone."""
    tokens = F.sum(F.size("ids") + int(bos) + int(eos)).cast("long")
    total = docs.groupBy(*streams).agg(F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens_consumed"))
    return total.withColumn("sequences", F.floor(F.col("tokens_consumed") / length)).withColumn("buffer_fill", F.col("tokens_consumed") % length)


def rechunk(rows: DataFrame, length: int, order: str, ids: str = "input_ids") -> DataFrame:
    """Rows of any width to rows of ``length``: tokens are taken as they stand, row by row, and a rest is dropped."""
    flat = rows.select(order, F.col(ids).alias("ids"))
    return pack(flat, length, order, bos=False, eos=False)


def number_sequences(packed: DataFrame, within: tuple[str, ...], unit: str, seq: str = "seq_id") -> DataFrame:
    """``seq`` numbered on from unit (file) to unit within each of ``within``: dense, units in the order of their names."""
    counts = packed.groupBy(*within, unit).agg(F.count(F.lit(1)).alias("_n"))  # one row a file
    before = F.sum("_n").over(W.partitionBy(*within).orderBy(unit).rowsBetween(W.unboundedPreceding, -1))
    first = counts.select(*within, unit, F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    return packed.join(first, [*within, unit]).withColumn(seq, F.col(seq) + F.col("_before")).drop("_before")


def shard(sequences: DataFrame, size: int, seq: str = "seq_id", first_shard: int = 0) -> DataFrame:
    """``shard_id`` and place of dense sequence numbers; the last shard may be smaller."""
    return sequences.withColumn("shard_id", F.floor(F.col(seq) / size) + first_shard).withColumn("row_in_shard", F.col(seq) % size)


def next_shard(manifest: DataFrame) -> int:
    """The number after the last shard of a manifest."""
    last = manifest.agg(F.max("shard_id")).first()[0]
    return 0 if last is None else last + 1


def split_units(docs: DataFrame, unit: str, fraction: float, seed: int = 42) -> DataFrame:
    """``docs`` with ``split``: units (files) are ordered by keyed hash and the first max(1, fraction) are validation.

    Only distinct units are ordered.
    """
    units = docs.select(unit).distinct().withColumn("_digest", key_digest(seed, F.col(unit)))
    count = units.agg(F.count(F.lit(1)).alias("c"), F.lit(1).alias("one"))
    wanted = max(1, int(count.first()["c"] * fraction))
    val = units.orderBy("_digest", unit).limit(wanted).select(unit, F.lit("val").alias("split"))
    return docs.join(val, unit, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def holdout(docs: DataFrame, key: str, share: float, seed: int = 7) -> Column:
    """Whether a row is held out, by keyed hash: the same share of every group, without any counting."""
    from ..functions.hashing import u01

    return u01(seed, F.col(key)) < share


def packing_metadata(
    sequences: DataFrame, length: int, shard_size: int, split: str = "split", input_dir: str = "", output_dir: str = "", tokenizer_profile: str = "standard", n_input_files: int = 0
) -> DataFrame:
    """One row: the settings, and sequences and tokens by split."""
    n = lambda s: F.sum(F.when(F.col(split) == s, 1).otherwise(0)).cast("long")
    sums = sequences.agg(F.coalesce(n("train"), F.lit(0)).cast("long").alias("train_sequences"), F.coalesce(n("val"), F.lit(0)).cast("long").alias("val_sequences"))
    return sums.select(
        F.lit(input_dir).alias("input_dir"), F.lit(output_dir).alias("output_dir"), F.lit(tokenizer_profile).alias("tokenizer_profile"), F.lit(n_input_files).cast("long").alias("n_input_files"),
        F.lit(length).cast("long").alias("seq_len"), F.lit(shard_size).cast("long").alias("shard_size"), "train_sequences", "val_sequences",
        (F.col("train_sequences") * length).alias("train_tokens"), (F.col("val_sequences") * length).alias("val_tokens"),
    )


def locate(sequences: DataFrame, wanted: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows of ``sequences`` by global index: ``wanted`` has ``idx``; an index beyond the end wraps around."""
    numbered = row_index(sequences, order[0], "_row", ties=order[1:])
    total = sequences.count()
    return wanted.withColumn("_row", F.col("idx") % F.lit(total)).join(numbered, "_row").drop("_row")
