"""Adapters for token arrays in NumPy files, and Parquet as the engine's own form.

NumPy files are bytes to Spark: they are read as binary files by the executors and parsed in Arrow batches, a file a row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_token_arrays(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(file, row, ids): a two-dimensional array gives a document a row, a one-dimensional one gives one document."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue  # unreadable files are left out
                if a.ndim not in (1, 2) or not a.size:
                    continue
                rows = a.reshape(1, -1) if a.ndim == 1 else a
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024].astype(np.int32)
                    yield pd.DataFrame({"file": path_, "row": np.arange(k, k + len(part)), "ids": list(part)})

    return _files(spark, path, glob).mapInPandas(parse, "file string, row long, ids array<int>")


def read_packed(spark: SparkSession, path: str, length: int, split: str = "train") -> DataFrame:
    """(file, row, input_ids) of width ``length``: files of the split, or all if it has none.

    Rows of another width are cut anew within their file, and a rest is dropped.
    """
    own = _files(spark, path, f"{split}*.npy").select("path").limit(1).count()
    rows = read_token_arrays(spark, path, f"{split}*.npy" if own else "*.npy")
    fits = rows.filter(F.size("ids") == length).select("file", "row", F.col("ids").alias("input_ids"))
    from ..operators.packing import pack

    other = pack(rows.filter(F.size("ids") != length), length, "row", ("file",), bos=False, eos=False)
    return fits.unionByName(other.select("file", F.col("seq_id").alias("row"), "input_ids"))


def read_sft(spark: SparkSession, path: str, length: int, most: int | None = None, seed: int = 42) -> DataFrame:
    """(file, row, input_ids, loss_mask) of archives whose width is ``length``; a sample is drawn by keyed hash."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, mask = z["input_ids"], z["loss_mask"]
                if ids.ndim == 2 and ids.shape[1] == length:
                    yield pd.DataFrame({"file": path_, "row": np.arange(len(ids)), "input_ids": list(ids.astype(np.int32)), "loss_mask": list(mask.astype(np.int8))})

    rows = _files(spark, path, "*.npz").mapInPandas(parse, "file string, row long, input_ids array<int>, loss_mask array<tinyint>")
    if most is None:
        return rows
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "file", F.lit("|"), F.col("row").cast("string")))).limit(most)  # the sample is the feature


PAIR_ARRAYS = ("chosen_full_ids", "rejected_full_ids", "chosen_loss_mask", "rejected_loss_mask")


def read_preference_arrays(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, row, ids and masks of both sides) of preference archives, the first ``most`` by file and row.

    Archives that cannot be read or lack an array are left out; so are pickled arrays, because unpickling runs code.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        sides = {name: z[name] for name in PAIR_ARRAYS}
                except (ValueError, KeyError, OSError, zipfile.BadZipFile):
                    continue
                n = len(sides[PAIR_ARRAYS[0]])
                yield pd.DataFrame({"file": path_, "row": np.arange(n), **{k: list(v.astype(np.int32)) for k, v in sides.items()}})

    rows = _files(spark, path, "*.npz").mapInPandas(parse, "file string, row long, " + ", ".join(f"{n} array<int>" for n in PAIR_ARRAYS))
    return rows.orderBy("file", "row").limit(most) if most else rows  # a limit is the feature


def write_shards(sequences: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",)) -> None:
    """Packed sequences as Parquet; the committer makes each write whole or absent."""
    sequences.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def export_npy(sequences: DataFrame, path: str, split: str = "train") -> DataFrame:
    """(shard_id, file, rows): one array file a shard, written next to its name and then renamed.

    ``path`` must be a folder that all executors share. ``sequences`` has shard_id, row_in_shard and input_ids; a shard
    has a bounded number of rows.
    """

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import os

        rows = rows.sort_values("row_in_shard")
        shard = int(rows["shard_id"].iloc[0])
        name = f"{path}/{split}_shard_{shard:04d}.npy"
        os.makedirs(path, exist_ok=True)
        with open(f"{name}.writing", "wb") as f:
            np.save(f, np.stack(rows["input_ids"].to_list()).astype(np.uint32))
        os.replace(f"{name}.writing", name)
        return pd.DataFrame({"shard_id": [shard], "file": [name], "rows": [len(rows)]})

    return sequences.select("shard_id", "row_in_shard", "input_ids").groupBy("shard_id").applyInPandas(write, "shard_id long, file string, rows long")
