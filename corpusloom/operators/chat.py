"""Conversations: templates, labels and packing for supervised fine-tuning."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import range_bucket
from ..functions.tables import written
from .tokens import BOS, PAD, SPECIAL, CodePoints, Tokenizer, encode

IGNORED = -100
#: Tags around each role; other roles count as the user's.
OPEN = {"system": "<|sys|>", "user": "<|usr|>", "assistant": "<|asst|>"}
CLOSE = {"system": "<|/sys|>", "user": "<|/usr|>", "assistant": "<|/asst|>"}


def _tag(role: Column, tags: dict[str, str]) -> Column:
    out = F
    for name, tag in tags.items():
        out = out.when(role == name, SPECIAL[tag])
    return out.otherwise(SPECIAL[tags["user"]])


def _cut(col: Column, max_length: int | None) -> Column:
    return F.slice(col, 1, max_length) if max_length else col


def encode_turns(turns: DataFrame, tokenizer: Tokenizer = CodePoints(), text: str = "text") -> DataFrame:
    """``turns`` with ``turn_ids`` (tags and content), ``n_content`` and ``is_answer``."""
    ids = turns.withColumn("_ids", encode(F.col(text), tokenizer))
    role = F.col("role")
    both = F.concat(F.array(_tag(role, OPEN)), F.col("_ids"), F.array(_tag(role, CLOSE)))
    return ids.withColumn("turn_ids", both).withColumn("n_content", F.size("_ids")).withColumn("is_answer", F.coalesce(role == "assistant", F.lit(False))).drop("_ids")


def conversations(turns: DataFrame, tokenizer: Tokenizer = CodePoints(), generation_prompt: bool = False, loss_on_prompt: bool = False, max_length: int | None = None) -> DataFrame:
    """(conv_id, input_ids, labels) from turns (conv_id, turn, role, text).

    Labels cover the content and the closing tag of the assistant's turns, or of all turns with ``loss_on_prompt``; the
    opening tag never counts. A conversation is one group: its turns meet in one row, as the template asks.
    """
    coded = encode_turns(turns, tokenizer)
    counts = F.col("is_answer") | F.lit(loss_on_prompt)
    rest = F.slice("turn_ids", 2, F.col("n_content") + 1)
    labels = F.when(counts, F.concat(F.array(F.lit(IGNORED)), rest)).otherwise(F.transform("turn_ids", lambda _: F.lit(IGNORED)))
    rows = coded.select("conv_id", F.struct("turn", F.col("turn_ids").alias("ids"), labels.alias("labels")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ids = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform("ts", lambda t: t["ids"])))
    lab = F.concat(F.array(F.lit(BOS if loss_on_prompt else IGNORED)), F.flatten(F.transform("ts", lambda t: t["labels"])))
    if generation_prompt:
        ids = F.concat(ids, F.array(F.lit(SPECIAL["<|asst|>"])))
        lab = F.concat(lab, F.array(F.lit(IGNORED)))
    return whole.select("conv_id", _cut(ids, max_length).alias("input_ids"), _cut(lab, max_length).alias("labels"))


def mask_to_labels(ids: Column, mask: Column) -> Column:
    """Ids where the mask is set, else the ignored value."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 0, F.lit(IGNORED)).otherwise(i))


def mask_coverage(rows: DataFrame, mask: str = "loss_mask") -> DataFrame:
    """Share of set positions over all rows."""
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return rows.agg((F.sum(ones) / F.sum(F.size(mask))).alias("coverage"))


def _next_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bin that starts at each row: where the next one starts, how many follow, and what the last one holds."""
    n, total = len(lengths), np.r_[0, np.cumsum(lengths)]
    following = np.maximum(np.arange(n) + 1, np.searchsorted(total, total[:-1] + capacity, side="right") - 1)
    bins, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if not lengths[i] and i + 1 < n:  # the bin is still empty
            following[i] = following[i + 1]
        k = following[i]
        bins[i], held[i] = (bins[k] + 1, held[k]) if k < n else (0, total[n] - total[i])
    return following, bins, held


def numbered(rows: DataFrame, order: str, *columns) -> DataFrame:
    """(``order``, ``columns``, _tie, _row), written: a number of each row, and a digest that orders rows of one ``order``."""
    out = rows.select(order, *columns)
    return written(out.withColumn("_tie", F.xxhash64(*out.columns)).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def bins_of_rows(rows: DataFrame, capacity: int, order: str) -> DataFrame:
    """(_row, bin, start) of a written table (``order``, length, _tie, _row): a bin closes when the next row would exceed it.

    Rows go by ``order``, null first, then by ``_tie`` and ``_row``; no two are the same row.

    Next fit is a fold, but what a range of rows does with it depends only on how full the bin is that it finds, and then
    on the row where that bin closes: a range gives one entry for each row that could be the one (no more than fit into a
    bin). The driver goes through these entries, one range after the other; then all ranges place their rows side by side.
    """
    kind = rows.schema[order].dataType
    place = [F.col(order).isNotNull().alias("named"), F.coalesce(order, F.lit(0).cast(kind)).alias("key")]
    rows = rows.select(*place, "_tie", "_row", "length", range_bucket(rows, order, ("_tie",)).cast("long").alias("range"))
    by = ["named", "key", "_tie", "_row"]

    def outcomes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        n, total = group["length"].to_numpy(), np.cumsum(group["length"].to_numpy())
        _, bins, held = _next_fit(n, capacity)
        closing = np.flatnonzero((n > 0) & (np.r_[0, total[:-1]] < capacity))  # rows that may not fit into a bin that is found
        return pd.DataFrame({
            "range": [group["range"].iloc[0]], "upto": [total[closing].tolist()], "bins": [bins[closing].tolist()], "held": [held[closing].tolist()],
            "all": [total[-1]], "fresh_bins": [bins[0]], "fresh_held": [held[0]],
        })

    schema = "range long, upto array<long>, bins array<long>, held array<long>, all long, fresh_bins long, fresh_held long"
    at, used, starts = 0, 0, []
    for r in rows.groupBy("range").applyInPandas(outcomes, schema).orderBy("range").collect():  # one row a range
        starts.append((r["range"], at, used))
        if not used:
            at, used = at + r["fresh_bins"], r["fresh_held"]
        elif (k := bisect_right(r["upto"], capacity - used)) < len(r["upto"]):
            at, used = at + 1 + r["bins"][k], r["held"][k]
        else:
            used += r["all"]

    def place_rows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        n, used = group["length"].to_numpy(), int(group["used"].iloc[0])
        total = np.r_[0, np.cumsum(n)]
        following, *_ = _next_fit(n, capacity)
        first = int(np.argmax(np.r_[total[1:] > capacity - used, True])) if used else 0
        bins, starts = np.zeros(len(n), np.int64), used + total[:-1]
        k, b = first, int(bool(used))
        while k < len(n):
            to = following[k]
            bins[k:to], starts[k:to] = b, total[k:to] - total[k]
            k, b = to, b + 1
        return pd.DataFrame({"_row": group["_row"], "bin": group["at"].iloc[0] + bins, "start": starts})

    known = rows.sparkSession.createDataFrame(starts, "range long, at long, used long")
    placed = rows.join(F.broadcast(known), "range")  # one row a range
    return placed.groupBy("range").applyInPandas(place_rows, "_row long, bin long, start long")


def next_fit_bins(lengths: DataFrame, capacity: int, order: str = "conv_id") -> DataFrame:
    """(order, bin, start) of each row of ``lengths`` (order, length)."""
    rows = numbered(lengths, order, F.col("length").cast("long").alias("length"))
    return rows.select(order, "_row").join(bins_of_rows(rows, capacity, order), "_row").drop("_row")


def pack_next_fit(rows: DataFrame, capacity: int, order: str = "conv_id", split_last: bool = True) -> DataFrame:
    """(seq_id, input_ids, labels), each ``capacity`` long.

    A conversation longer than a bin is cut there; the last bin is padded and, with ``split_last``, goes on over as many
    sequences as it needs. Rows without an id come first and rows that share one go by content; each is packed once. Rows
    without tokens give nothing; labels that are null count as ignored.
    """
    labels = F.coalesce("labels", F.transform("input_ids", lambda _: F.lit(IGNORED)))
    held = numbered(rows.filter(F.size("input_ids") > 0), order, "input_ids", labels.alias("labels"))
    lengths = written(held.select(order, "_tie", "_row", F.size("input_ids").cast("long").alias("length")), "lengths")
    bins = written(bins_of_rows(lengths, capacity, order), "bins")
    joined = held.join(bins, "_row").groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("start", "input_ids", "labels"))).alias("parts"))
    last = bins.agg(F.max("bin").alias("last"))
    flat = lambda name: F.flatten(F.transform("parts", lambda p: p[name]))
    whole = joined.select("bin", flat("input_ids").alias("ids"), flat("labels").alias("labels")).join(F.broadcast(last), F.lit(True))  # one row
    pieces = F.when((F.col("bin") == F.col("last")) & F.lit(split_last), F.ceil(F.size("ids") / capacity)).otherwise(F.lit(1))
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces.cast("int") - 1)))
    take = lambda name, pad: F.concat(
        F.slice(name, F.col("piece") * capacity + 1, F.lit(capacity)),
        F.array_repeat(F.lit(pad), F.greatest(F.lit(0), (F.col("piece") + 1) * capacity - F.size(name)).cast("int")),
    )
    return cut.select((F.col("bin") + F.col("piece")).alias("seq_id"), take("ids", PAD).alias("input_ids"), take("labels", IGNORED).alias("labels"))


def collate(rows: DataFrame, batch: str = "batch_id", max_length: int = 4096, pad: int = PAD, label_pad: int = IGNORED) -> DataFrame:
    """Rows cut to ``max_length`` and padded to the longest of their batch, with ``attention_mask``."""
    from pyspark.sql import Window as W

    cut = rows.withColumn("_i", F.slice("input_ids", 1, max_length)).withColumn("_l", F.slice("labels", 1, max_length))
    cut = cut.withColumn("_n", F.max(F.size("_i")).over(W.partitionBy(batch)))
    missing = (F.col("_n") - F.size("_i")).cast("int")
    return (
        cut.withColumn("input_ids", F.concat("_i", F.array_repeat(F.lit(pad), missing)))
        .withColumn("labels", F.concat("_l", F.array_repeat(F.lit(label_pad), missing)))
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("_i")), F.array_repeat(F.lit(0), missing)))
        .drop("_i", "_l", "_n")
    )


def stack(rows: DataFrame, batch: str = "batch_id", order: str = "pos_in_batch") -> DataFrame:
    """(batch, input_ids, labels): packed rows of one length as matrices, labels being the ids; a batch is small by its setting."""
    parts = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, "input_ids"))).alias("parts"))
    ids = F.transform("parts", lambda p: p["input_ids"])
    return parts.select(batch, ids.alias("input_ids"), ids.alias("labels"))


COLLATORS = {"pretrain": stack, "sft": collate}


def collator(mode: str):
    """The collating function of a mode; pretraining rows have equal lengths and are stacked."""
    from .preference import collate_pairs

    known = COLLATORS | {"dpo": collate_pairs}
    if mode not in known:
        raise ValueError(f"unknown mode {mode!r}; known are {', '.join(sorted(known))}")
    return known[mode]
