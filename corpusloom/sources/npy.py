"""Token arrays in NumPy files as a data source: slices of rows are partitions, and shards are written whole or not at all.

Reading takes headers first, on the driver and several at once, and then cuts each array into slices of ``slice_rows`` rows.
A slice is read alone, by a seek and in Arrow batches, so a shard of any size is many slices and never one row. Slices that
follow each other, of one file or of many small ones, make a partition of up to ``PARTITION_TOKENS`` tokens where there are
more than ``PARTITIONS``, so the number of tasks follows the tokens and not the files; a larger slice is a partition of its own.
Arrays of another width than ``width`` are left out before anything is read of them; filters on ``row`` and ``file`` leave out
slices (where the session pushes filters to Python sources). Compressed members of archives cannot be sought: these are one
partition, which streams.

Writing streams the rows of each shard to a file of its own beside the target. The driver moves all files to their names when
every task is done; when one fails for good it deletes them, so an aborted job leaves no file. A task that is run again
writes files of its own, and those of the lost attempt are deleted with the folder.

Paths are those of file systems that driver and executors both open (a shared folder or an object store that Arrow knows). For
paths that only Spark opens, ``arrays.read_token_arrays`` reads whole files.

Edge cases: a two-dimensional array gives a document a row; a one-dimensional one gives one document, or with ``length``
one for each so many tokens, the last one shorter; empty arrays give none; files that are no arrays, hold pickled objects or
lack an array are left out, because unpickling runs code; archives whose arrays differ in their number of rows too; arrays
in column order are read by column. A shard with a missing or repeated row, a null array or rows of several widths is an error
that aborts the job.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

SLICE_ROWS = 4096
PARTITION_TOKENS = 1 << 22  # tokens of a partition of small slices, about
PARTITIONS = 64  # slices that are no reason to put any side by side
HEADERS = 16  # files whose headers are read at once
BATCH_TOKENS = 1 << 20  # tokens of an Arrow batch, about


@dataclass
class Layout:
    """Where an array lies in a file; ``offset`` is None in a compressed member."""

    member: str
    offset: int | None
    dtype: np.dtype
    rows: int
    width: int
    by_column: bool
    last: int  # tokens of the last row


@dataclass
class Slice(InputPartition):
    file: str
    layouts: list[Layout]
    lo: int
    hi: int


@dataclass
class Slices(InputPartition):
    parts: list[Slice]


def together(slices: list[Slice]) -> list[Slices]:
    """``slices`` in their order, small ones side by side; ``PARTITIONS`` of them or fewer stay apart."""
    sizes = [(s.hi - s.lo) * sum(x.width for x in s.layouts) for s in slices]
    most, out, held = min(PARTITION_TOKENS, sum(sizes) // PARTITIONS), [], 0
    for s, n in zip(slices, sizes, strict=True):
        if len(slices) <= PARTITIONS or not out or held + n > most:
            out.append(Slices([]))
            held = 0
        out[-1].parts.append(s)
        held += n
    return out


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def _layout(f, member: str, offset: int | None, length: int | None) -> Layout | None:
    shape, by_column, dtype = _header(f)
    if dtype.hasobject or len(shape) not in (1, 2) or 0 in shape:
        return None
    if offset is not None:
        offset += f.tell()
    if len(shape) == 2:
        return Layout(member, offset, dtype, shape[0], shape[1], by_column, shape[1])
    width = min(length or shape[0], shape[0])
    rows = -(-shape[0] // width)
    return Layout(member, offset, dtype, rows, width, False, shape[0] - (rows - 1) * width)


def layouts(f, name: str, members: Sequence[str], length: int | None) -> list[Layout] | None:
    """The arrays of an open file, or None where they cannot be read."""
    try:
        if not name.endswith(".npz"):
            found = [_layout(f, "", 0, length)]
        else:
            found = []
            with zipfile.ZipFile(f) as z:
                for member in members:
                    info = z.getinfo(f"{member}.npy")
                    start = None
                    if info.compress_type == zipfile.ZIP_STORED:
                        f.seek(info.header_offset + 26)
                        start = info.header_offset + 30 + sum(np.frombuffer(f.read(4), "<u2").tolist())
                    with z.open(info) as inner:
                        found.append(_layout(io.BytesIO(inner.read(65_536)), member, start, length))
    except (ValueError, KeyError, OSError, zipfile.BadZipFile, EOFError):
        return None
    return None if None in found or len({x.rows for x in found}) != 1 else found


def _sought(f, at: Layout, lo: int, hi: int) -> np.ndarray:
    """Tokens of rows ``lo`` to ``hi``, one row after the other."""
    size = at.dtype.itemsize
    if at.by_column:
        out = np.empty((hi - lo, at.width), at.dtype)
        for c in range(at.width):
            f.seek(at.offset + (c * at.rows + lo) * size)
            out[:, c] = np.frombuffer(f.read((hi - lo) * size), at.dtype)
        return out.ravel()
    tokens = (hi - lo) * at.width - (at.width - at.last if hi == at.rows else 0)
    f.seek(at.offset + lo * at.width * size)
    return np.frombuffer(f.read(tokens * size), at.dtype)


def _column(at: Layout, lo: int, hi: int, flat: np.ndarray) -> pa.Array:
    ends = np.arange(hi - lo + 1, dtype=np.int32) * at.width
    if hi == at.rows:
        ends[-1] -= at.width - at.last
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


class TokenArrayReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.glob = options.get("glob", "*.np[yz]")
        self.slice_rows = int(options.get("slice_rows", SLICE_ROWS))
        self.width, self.length = (int(options[k]) if k in options else None for k in ("width", "length"))
        self.lo, self.hi, self.files = 0, None, None

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path)
        infos = [where.get_file_info(root)]
        if infos[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if infos[0].type == fs.FileType.Directory:
            infos = where.get_file_info(fs.FileSelector(root, recursive=True))
        infos = sorted(infos, key=lambda i: i.path)
        infos = [i for i in infos if i.type == fs.FileType.File and fnmatch(i.base_name, self.glob) and (self.files is None or i.path in self.files)]

        def found_in(info) -> list[Layout] | None:
            with where.open_input_file(info.path) as f:
                return layouts(f, info.path, self.columns, self.length)

        def slices() -> Iterator[Slice]:
            with ThreadPoolExecutor(HEADERS) as pool:
                for info, found in zip(infos, pool.map(found_in, infos), strict=True):
                    if found is None or self.width is not None and {x.width for x in found} != {self.width}:
                        continue
                    rows = found[0].rows
                    step = rows if any(x.offset is None for x in found) else self.slice_rows
                    first, stop = self.lo // step * step, rows if self.hi is None else min(rows, self.hi + 1)
                    yield from (Slice(info.path, found, lo, min(lo + step, rows)) for lo in range(first, stop, step))

        return together(list(slices())) or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._rows(part)

    def _rows(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        step = max(1, BATCH_TOKENS // max(x.width for x in partition.layouts))
        with where.open_input_file(partition.file) as f:
            streams = {}
            for at in partition.layouts:
                if at.offset is None:
                    streams[at.member] = zipfile.ZipFile(where.open_input_file(partition.file)).open(f"{at.member}.npy")
                    _header(streams[at.member])
            for lo in range(partition.lo, partition.hi, step):
                hi = min(lo + step, partition.hi)
                columns = []
                for at in partition.layouts:
                    if at.offset is not None:
                        flat = _sought(f, at, lo, hi)
                    elif at.by_column:  # neither sought nor in the order of rows: the whole member is held
                        flat = np.frombuffer(streams[at.member].read(), at.dtype).reshape(at.width, at.rows).T.ravel() if lo == 0 and hi == at.rows else None
                        if flat is None:
                            raise ValueError(f"{partition.file}: {at.member} is compressed in column order")
                    else:
                        tokens = (hi - lo) * at.width - (at.width - at.last if hi == at.rows else 0)
                        flat = np.frombuffer(streams[at.member].read(tokens * at.dtype.itemsize), at.dtype)
                    columns.append(_column(at, lo, hi, flat))
                file = pa.array([partition.file] * (hi - lo), pa.string())
                yield pa.RecordBatch.from_arrays([file, pa.array(np.arange(lo, hi)), *columns], names=["file", "row", *self.columns])


class PushedReader(TokenArrayReader):
    """The same where the session pushes filters; Spark refuses such a reader where it does not."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("row",) and not isinstance(f, In) and hasattr(f, "value"):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.lo = max(self.lo, f.value)
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.hi = f.value if self.hi is None else min(self.hi, f.value)
            elif name == ("file",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = named if self.files is None else self.files & named
            yield f  # slices hold other rows too


class TokenArrays(DataSource):
    """``spark.read.format("token_arrays")``; options path, arrays, glob, slice_rows, width, length, pushed."""

    @classmethod
    def name(cls) -> str:
        return "token_arrays"

    def _columns(self) -> list[str]:
        return self.options.get("arrays", "ids").split(",")

    def schema(self) -> str:
        return "file string, row long, " + ", ".join(f"{c} array<int>" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        kind = PushedReader if self.options.get("pushed") == "true" else TokenArrayReader
        return kind(dict(self.options), self._columns())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a shard lies and where it goes


class TokenShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.split, self.overwrite = options["path"], options.get("split", "train"), overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{root}/{self.job}")
        attempt, files, shard, out, at, rows, width = uuid.uuid4().hex, [], None, None, 0, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                if at != rows:
                    raise ValueError(f"shard {shard} has {at} of {rows} rows")

        for batch in iterator:
            shards, places, sizes = (batch.column(k).to_numpy() for k in range(3))
            lists = batch.column(3)
            if lists.null_count:
                raise ValueError("a row has no tokens")
            widths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            upto = np.r_[0, np.cumsum(widths)]
            starts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards)]
            for i, j in zip(starts, starts[1:], strict=False):
                if i == j:
                    continue
                if shards[i] != shard:
                    close()
                    shard, rows, at, width = int(shards[i]), int(sizes[i]), 0, int(widths[i])
                    name = f"{self.split}_shard_{shard:04d}.npy"
                    files.append((f"{root}/{self.job}/{attempt}-{name}", f"{root}/{name}"))
                    out = where.open_output_stream(files[-1][0])
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "<u4", "fortran_order": False, "shape": (rows, width)})
                    out.write(head.getvalue())
                if (widths[i:j] != width).any() or (places[i:j] != np.arange(at, at + j - i)).any():
                    raise ValueError(f"shard {shard}: rows must be dense and of one width")
                out.write(flat[upto[i] : upto[j]].tobytes())
                at += int(j - i)
        close()
        return Written(files)

    def _clean(self) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")

    def commit(self, messages) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        there = {i.path for i in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if fnmatch(i.base_name, f"{self.split}_shard_*.npy")}
        if len(set(names)) < len(names) or not self.overwrite and there & set(names):
            self._clean()
            raise ValueError("a shard is written twice")
        for tmp, name in files:
            where.move(tmp, name)  # over the file of that name
        if self.overwrite:
            for name in there - set(names):
                where.delete_file(name)
        self._clean()

    def abort(self, messages) -> None:
        self._clean()


class TokenShards(DataSource):
    """``df.write.format("token_shards")`` of (shard_id, row_in_shard, shard_rows, input_ids); options path, split."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "shard_id long, row_in_shard long, shard_rows long, input_ids array<int>"

    def writer(self, schema, overwrite: bool) -> TokenShardWriter:
        return TokenShardWriter(dict(self.options), overwrite)


def scan_token_arrays(spark: SparkSession, path: str, arrays: Sequence[str] = ("ids",), **options) -> DataFrame:
    """(file, row, ``arrays``) below ``path``; ``options`` are glob, slice_rows, width and length."""
    spark.dataSource.register(TokenArrays)
    reader = spark.read.format("token_arrays").option("path", path).option("arrays", ",".join(arrays))
    reader = reader.option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def write_token_shards(sequences: DataFrame, path: str, split: str = "train", overwrite: bool = True) -> None:
    """``sequences`` (shard_id, row_in_shard, input_ids), a written table, as one array file a shard."""
    sequences.sparkSession.dataSource.register(TokenShards)
    sizes = sequences.groupBy("shard_id").agg((F.max("row_in_shard") + 1).cast("long").alias("shard_rows"))  # a row a shard
    rows = sequences.join(sizes, "shard_id").select(F.col("shard_id").cast("long"), F.col("row_in_shard").cast("long"), "shard_rows", "input_ids")
    rows = rows.repartition("shard_id").sortWithinPartitions("shard_id", "row_in_shard")
    rows.write.format("token_shards").mode("overwrite" if overwrite else "append").option("split", split).option("path", path).save()
