"""Weight files as a Spark source and sink: the table of parameters as tensor containers.

A container is the public safetensors layout: eight bytes with the header's length, a JSON header that
gives each tensor's dtype, shape and place in the data, and the data, row after row.

Reading (``spark.read.format("gridloom_weights")``) plans by files' sizes alone. A partition is a range of
at most ``partition_bytes`` of a container; its task reads the header and then, by seeking, the rows that
begin in the range. So a large tensor is many partitions and many small ones are one, and the driver holds
nothing for each tensor. The path is one container, a folder written by this sink, a folder with a shard index
(``*.index.json`` with a ``weight_map``), or a folder of containers.

Writing goes by rows sorted by (param_id, row_idx). A task holds at most ``part_bytes`` of rows and writes
them as a container of its own, whose tensors are blocks of consecutive rows named ``param_id`` and, where a
block does not begin at row 0 or a tensor has several, ``@first row``, which the header's metadata tells apart.
The commit writes the index that names the containers of successful tasks, with their least and greatest
param_id; a folder without it is not read, so a failed job leaves nothing readable, and files of failed or
repeated attempts are in no index. An abort deletes what tasks wrote.

Defined results: F64, F32, F16 and BF16 are read as float, which holds the last three exactly; other types
are an error; a tensor of one dimension is one row, one of more has a row for each leading index; a tensor
of no dimension is a row of one value; tensors without values have no rows. Writing takes float and double rows
as F32; a null param_id, row_idx, vector or element is an error, as it has no place in a container; the
empty table is an empty folder with an index.
"""

from __future__ import annotations

import contextlib
import json
import math
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.schemas import PARAMETERS

NAME = "gridloom_weights"
#: Bytes of rows that a task reads, that it holds to write a container, and that an Arrow batch has.
PARTITION_BYTES, PART_BYTES, BATCH_BYTES = 64 << 20, 64 << 20, 4 << 20
#: Bytes that a row counts in a batch besides its values.
ROW_BYTES = 32
#: The index of a folder, and the name in a container's metadata for the blocks whose tensors are not named as their parameter.
INDEX, BLOCKS = "gridloom-index.json", "gridloom_blocks"
# Fixed values of the layout: the types that are read, and their bytes.
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2}
_ARROW = pa.schema([("param_id", pa.string()), ("row_idx", pa.int64()), ("values", pa.list_(pa.float32()))])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """The bytes of a container in which a task's rows begin, and its blocks (tensor, param_id, first row) if only those are read."""

    file: str
    start: int
    stop: int
    blocks: list[tuple[str, str, int]] | None = None


@dataclass
class Rows:
    """Consecutive rows of a tensor in a container: how many, their width and type, and where they begin."""

    param_id: str
    first: int
    rows: int
    width: int
    dtype: str
    offset: int

    @property
    def size(self) -> int:
        return self.width * WIDTHS[self.dtype]


def _begin(f: pa.NativeFile, file: str) -> int:
    """Where a container's data begins."""
    (length,) = struct.unpack("<Q", f.read(8))
    if length > f.size() - 8:
        raise ValueError(f"{file} is no tensor container")
    return 8 + length


def _head(f: pa.NativeFile, file: str) -> tuple[dict, dict, int]:
    """A container's tensors by name, its metadata, and where its data begins."""
    begin = _begin(f, file)
    tensors = json.loads(f.read(begin - 8))
    return tensors, tensors.pop("__metadata__", None) or {}, begin


def header(fs: pafs.FileSystem, file: str) -> tuple[dict, int]:
    """A container's tensors by name, and where its data begins."""
    with fs.open_input_file(file) as f:
        tensors, _, begin = _head(f, file)
    return tensors, begin


def _rows(f: pa.NativeFile, part: Range, only: set[str] | None) -> list[Rows]:
    """The rows that begin in a partition's range, in the file's order."""
    tensors, metadata, begin = _head(f, part.file)
    named = json.loads(metadata.get(BLOCKS, "{}"))
    found = []
    for name, param_id, first in part.blocks if part.blocks is not None else [(n, *named.get(n, (n, 0))) for n in tensors]:
        if only is not None and param_id not in only:
            continue
        about = tensors[name]
        shape, dtype, (start, stop) = about["shape"], about["dtype"], about["data_offsets"]
        width = shape[-1] if shape else 1
        rows = math.prod(shape[:-1])
        if dtype not in WIDTHS:
            raise ValueError(f"tensor {name} of {part.file} has type {dtype}; read are {', '.join(WIDTHS)}")
        size = width * WIDTHS[dtype]
        if stop - start != rows * size:
            raise ValueError(f"tensor {name} of {part.file} has {stop - start} bytes, its shape has {rows * size}")
        if not rows * width:
            continue
        at = begin + start
        a, b = (min(rows, max(0, -((at - x) // size))) for x in (part.start, part.stop))  # the first row that begins at x or later
        if a < b:
            found.append(Rows(param_id, first + a, b - a, width, dtype, at + a * size))
    return sorted(found, key=lambda x: x.offset)


def _runs(found: list[Rows]) -> Iterator[list[Rows]]:
    """Rows in runs of neighbours in the file, each of at most BATCH_BYTES unless a row is larger; rows count some bytes besides their values."""
    run: list[Rows] = []
    held = 0
    for x in found:
        step = max(1, BATCH_BYTES // (x.size + ROW_BYTES))
        for k in range(0, x.rows, step):
            piece = Rows(x.param_id, x.first + k, min(step, x.rows - k), x.width, x.dtype, x.offset + k * x.size)
            more = piece.rows * (piece.size + ROW_BYTES)
            if run and (held + more > BATCH_BYTES or run[-1].offset + run[-1].rows * run[-1].size != piece.offset):
                yield run
                run, held = [], 0
            run.append(piece)
            held += more
    if run:
        yield run


class WeightReader(DataSourceReader):
    def __init__(self, path: str, most: int, only: set[str] | None):
        self.path, self.most, self.only = path, most, only

    def partitions(self) -> list[Range]:
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            files = [Range(path, -1, -1)]
        else:
            files = self._of_folder(fs, path.rstrip("/"))
        out = []
        for x in files:
            start, stop = x.start, x.stop
            if start < 0:
                with fs.open_input_file(x.file) as f:
                    start, stop = _begin(f, x.file), f.size()
            # One at least, whose task looks at the header.
            out.extend(Range(x.file, k, min(stop, k + self.most) if k + self.most < stop else max(stop, k + 1), x.blocks) for k in range(start, max(stop, start + 1), self.most))
        return out

    def _of_folder(self, fs: pafs.FileSystem, path: str) -> list[Range]:
        """The containers of a folder, from where to where their data goes if that is known."""
        listed = fs.get_file_info(pafs.FileSelector(path))
        names = sorted(f.base_name for f in listed)
        if INDEX in names:
            with fs.open_input_file(f"{path}/{INDEX}") as f:
                blocks = json.loads(f.read())["blocks"]
            if any("tensor" in b for b in blocks):  # an index of before, with a row for each tensor
                return self._of_blocks((f"{path}/{b['file']}", (b["tensor"], b["param_id"], b["first"])) for b in blocks)
            wanted = (b for b in blocks if self.only is None or any(b["least"] <= p <= b["greatest"] for p in self.only))
            return [Range(f"{path}/{b['file']}", b["begin"], b["end"]) for b in wanted]
        if maps := [n for n in names if n.endswith(".index.json")]:
            known = []
            for n in maps:
                with fs.open_input_file(f"{path}/{n}") as f:
                    known.extend((f"{path}/{file}", (tensor, tensor, 0)) for tensor, file in json.loads(f.read())["weight_map"].items())
            return self._of_blocks(known)
        if any(n.startswith("part-") for n in names):
            raise ValueError(f"{path} has parts and no index: its job did not end well")
        return [Range(f"{path}/{n}", -1, -1) for n in names if n.endswith(".safetensors")]

    def _of_blocks(self, known: Iterable[tuple[str, tuple[str, str, int]]]) -> list[Range]:
        files: dict[str, list] = {}
        for file, block in known:
            if self.only is None or block[1] in self.only:
                files.setdefault(file, []).append(block)
        return [Range(file, -1, -1, blocks) for file, blocks in files.items()]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without rows has one empty partition
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as f:
            for run in _runs(_rows(f, partition, self.only)):
                size = sum(x.rows * x.size for x in run)
                f.seek(run[0].offset)
                data = f.read(size)
                if len(data) < size:
                    raise ValueError(f"{partition.file} ends within tensor {run[-1].param_id}")
                at = [x.offset - run[0].offset for x in run] + [size]
                values = np.concatenate([_floats(data[a:b], x.dtype) for x, a, b in zip(run, at, at[1:])])
                rows = [x.rows for x in run]
                offsets = np.concatenate([[0], np.cumsum(np.repeat([x.width for x in run], rows))]).astype(np.int32)
                params = pa.array([x.param_id for x in run], pa.string()).take(pa.array(np.repeat(np.arange(len(run)), rows)))
                ids = pa.array(np.concatenate([np.arange(x.first, x.first + x.rows, dtype=np.int64) for x in run]))
                yield pa.RecordBatch.from_arrays([params, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=_ARROW)


def _floats(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":  # the upper half of a float
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(data, {"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype]).astype(np.float32)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WeightWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        out, held, size = Written([]), [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                out.files.append(_container(fs, f"{path}/part-{uuid.uuid4().hex}.safetensors", held))
            held, size = [], 0

        for batch in batches:
            for param_id, first, matrix in _blocks(batch):
                step = max(1, self.most // max(1, matrix.shape[1] * 4))
                for k in range(0, len(matrix), step):
                    part = matrix[k : k + step]
                    if size and size + part.nbytes > self.most:
                        flush()
                    last = held[-1] if held else None
                    if last and last[0] == param_id and last[1] + sum(map(len, last[2])) == first + k and last[2][0].shape[1] == part.shape[1]:
                        last[2].append(part)
                    else:
                        held.append((param_id, first + k, [part]))
                    size += part.nbytes
        flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        blocks = sorted((b for m in messages if m for b in m.files), key=lambda b: (b["least"], b["greatest"], b["file"]))
        with fs.open_output_stream(f"{path}/{INDEX}") as f:
            f.write(json.dumps({"blocks": blocks}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        for m in messages:
            for b in m.files if m else ():
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(f"{path}/{b['file']}")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """(param_id, first row, rows) of the stretches of consecutive rows of one width."""
    if not batch.num_rows:
        return
    ids, rows, values = (batch.column(c) for c in ("param_id", "row_idx", "values"))
    if ids.null_count or rows.null_count or values.null_count or values.flatten().null_count:
        raise ValueError("a weight file holds no null ids, rows or values")
    rows, widths = rows.to_numpy(), values.value_lengths().to_numpy()
    flat = values.flatten().to_numpy().astype("<f4")
    goes_on = np.zeros(len(rows), bool)
    goes_on[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False) & (np.diff(rows) == 1) & (np.diff(widths) == 0)
    begins = np.flatnonzero(~goes_on)
    ends = np.concatenate([[0], np.cumsum(widths)])
    for a, b in zip(begins, np.append(begins[1:], len(rows))):
        yield ids[int(a)].as_py(), int(rows[a]), flat[ends[a] : ends[b]].reshape(b - a, -1)


def _container(fs: pafs.FileSystem, file: str, held: list[tuple[str, int, list[np.ndarray]]]) -> dict:
    """Write blocks as one container; what the index tells of it."""
    tensors, named, at = {}, {}, 0
    for param_id, first, parts in held:
        name = param_id if not first and param_id not in tensors else f"{param_id}@{first}"
        if name in tensors:
            raise ValueError(f"row {first} of {param_id} comes twice")
        rows, width = sum(map(len, parts)), parts[0].shape[1]
        tensors[name] = {"dtype": "F32", "shape": [rows, width], "data_offsets": [at, at + 4 * rows * width]}
        if name != param_id:
            named[name] = [param_id, first]
        at += 4 * rows * width
    head = json.dumps({"__metadata__": {BLOCKS: json.dumps(named)}} | tensors).encode()
    head += b" " * (-len(head) % 8)
    with fs.open_output_stream(file) as f:
        f.write(struct.pack("<Q", len(head)) + head)
        for _, _, parts in held:
            for part in parts:
                f.write(np.ascontiguousarray(part).tobytes())
    ids = [param_id for param_id, _, _ in held]
    return {"file": file.rpartition("/")[2], "begin": 8 + len(head), "end": 8 + len(head) + at, "least": min(ids), "greatest": max(ids)}


class WeightSource(DataSource):
    """The format ``gridloom_weights``; options path, partition_bytes and only (a JSON list of param_ids; reading) and part_bytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return PARAMETERS

    def reader(self, schema) -> WeightReader:
        only = self.options.get("only")
        return WeightReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)), None if only is None else set(json.loads(only)))

    def writer(self, schema, overwrite: bool) -> WeightWriter:
        return WeightWriter(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read_weights(spark: SparkSession, path: str, only: Sequence[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(param_id, row_idx, values) of the containers at path; of the parameters in ``only`` alone, whose bytes are then all that is read."""
    spark.dataSource.register(WeightSource)
    reader = spark.read.format(NAME).option("partition_bytes", str(partition_bytes))
    return (reader if only is None else reader.option("only", json.dumps(list(only)))).load(path)


def write_weights(parameters: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """(param_id, row_idx, values) as containers in a new folder; rows are dealt out by range of (param_id, row_idx), so a large tensor is many parts."""
    spark = parameters.sparkSession
    fs, place = _open(path)
    if fs.get_file_info(place).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    spark.dataSource.register(WeightSource)
    rows = parameters.selectExpr("param_id", "cast(row_idx as long) as row_idx", "cast(values as array<float>) as values")
    dealt = rows.repartitionByRange("param_id", "row_idx").sortWithinPartitions("param_id", "row_idx")
    dealt.write.format(NAME).option("part_bytes", str(part_bytes)).mode("append").save(path)
