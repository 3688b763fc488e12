"""Saved NumPy arrays as tables: a data source that reads .npy and .npz files by ranges of rows, and writes them in parts.

`spark.read.format("npy").load(path)` gives (row, values) of a matrix, or of a vector as rows of one value. With
the option `member`, one array of an .npz file is read; with `sparse`, the .npz file holds a matrix in compressed
rows (data, indices, indptr, shape) and gives (row, col, value). A task seeks to its rows and reads no
others; only members that are compressed in the archive have to be unpacked from their beginning.

Writing (row, values) makes a folder of .npy parts, one or more for each task, with the rows' numbers beside them, and a manifest
that lists the parts of the tasks that ended well. It is written when all have; without it the folder isn't an array, and
what a failed write has left is taken away. Such a folder is read like a file. Paths are those of a folder
that the driver and all executors see.
"""

from __future__ import annotations

import ast
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that a task reads, about, and rows in a part that is written.
RANGE = 16 << 20
PART_ROWS = 50_000


@dataclass
class Stored:
    """Where an array lies: the file, a member of an archive or None, the place of its first byte, type and shape."""

    path: str
    member: str | None
    offset: int
    dtype: str
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _header(stream: BinaryIO) -> tuple[str, tuple[int, ...], int]:
    """(type, shape, length of the header) of the npy format."""
    start = stream.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an npy array")
    size = 2 if start[6] == 1 else 4
    length = int.from_bytes(stream.read(size), "little")
    told = ast.literal_eval(stream.read(length).decode("latin-1" if start[6] < 3 else "utf-8").strip())
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("an array in columns can't be read by rows")
    if np.dtype(told["descr"]).hasobject:
        raise ValueError("an array of objects isn't read")
    return told["descr"], tuple(told["shape"]), 8 + size + length


def locate(path: str, member: str | None = None) -> Stored:
    if member is None:
        with open(path, "rb") as f:
            dtype, shape, offset = _header(f)
        return Stored(path, None, offset, dtype, shape)
    name = member if member.endswith(".npy") else f"{member}.npy"
    with zipfile.ZipFile(path) as archive, archive.open(name) as f:
        dtype, shape, offset = _header(f)
        info = archive.getinfo(name)
    if info.compress_type != zipfile.ZIP_STORED:
        return Stored(path, name, offset, dtype, shape)
    with open(path, "rb") as f:  # a stored member lies in the archive as it is
        f.seek(info.header_offset + 26)
        names, extra = struct.unpack("<HH", f.read(4))
    return Stored(path, None, info.header_offset + 30 + names + extra + offset, dtype, shape)


def rows_of(stored: Stored, start: int, end: int) -> np.ndarray:
    """Rows start to end of the array."""
    at, size = stored.offset + start * stored.row_bytes, (end - start) * stored.row_bytes
    if stored.member is None:
        with open(stored.path, "rb") as f:
            f.seek(at)
            raw = f.read(size)
    else:
        with zipfile.ZipFile(stored.path) as archive, archive.open(stored.member) as f:
            f.seek(at)
            raw = f.read(size)
    if len(raw) != size:
        raise ValueError(f"{stored.path} ends before row {end}")
    return np.frombuffer(raw, stored.dtype).reshape(end - start, *stored.shape[1:])


@dataclass
class Rows(InputPartition):
    """Rows start to end of an array; `numbers` holds their numbers where they aren't start, start + 1, ..."""

    stored: Stored
    start: int
    end: int
    numbers: Stored | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, member: str | None, sparse: bool, size: int):
        self.path, self.member, self.sparse, self.size = path, member, sparse, size

    def _ranges(self, stored: Stored, numbers: Stored | None = None) -> list[Rows]:
        step = max(1, self.size // max(1, stored.row_bytes))
        return [Rows(stored, s, min(s + step, stored.shape[0]), numbers) for s in range(0, stored.shape[0], step)]

    def partitions(self) -> list[Rows]:
        if Path(self.path).is_dir():
            parts = json.loads((Path(self.path) / "manifest.json").read_text())["parts"]
            found = [r for p in parts for r in self._ranges(locate(f"{self.path}/{p}.npy"), locate(f"{self.path}/{p}.rows.npy"))]
        elif self.sparse:
            ends = locate(self.path, "indptr")
            found = self._ranges(Stored(ends.path, ends.member, ends.offset, ends.dtype, (ends.shape[0] - 1,)))
        else:
            found = self._ranges(locate(self.path, self.member))
        return found or [Rows(Stored(self.path, None, 0, "<f8", (0,)), 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        start, end = partition.start, partition.end
        if start == end:
            return
        if self.sparse:
            ends = rows_of(locate(self.path, "indptr"), start, end + 1).astype(np.int64)
            columns, values = locate(self.path, "indices"), locate(self.path, "data")
            for s in range(int(ends[0]), int(ends[-1]), 1 << 20):
                e = min(s + (1 << 20), int(ends[-1]))
                rows = start + np.searchsorted(ends, np.arange(s, e), side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows_of(columns, s, e).astype(np.int64)), pa.array(rows_of(values, s, e).astype(np.float64))], names=["row", "col", "value"])
            return
        step = max(1, (4 << 20) // max(1, partition.stored.row_bytes))
        for s in range(start, end, step):
            e = min(s + step, end)
            x = rows_of(partition.stored, s, e).reshape(e - s, -1).astype(np.float64)
            numbers = np.arange(s, e) if partition.numbers is None else rows_of(partition.numbers, s, e)
            offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])) if x.size else np.zeros(e - s + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["row", "values"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = Path(path), overwrite
        if (self.path / "manifest.json").exists() and not overwrite:
            raise ValueError(f"{path} is there already")

    def write(self, iterator) -> Written:
        self.path.mkdir(parents=True, exist_ok=True)
        parts, rows, values = [], [], []

        def put() -> None:
            name = f"part-{uuid.uuid4().hex}"
            np.save(self.path / f"{name}.rows.npy", np.array(rows, dtype=np.int64))
            np.save(self.path / f"{name}.npy", np.array(values, dtype=np.float64))
            parts.append(name)
            rows.clear()
            values.clear()

        for row in iterator:
            if values and len(row["values"]) != len(values[0]):
                raise ValueError("the rows of a matrix have one length")
            rows.append(row["row"])
            values.append(row["values"])
            if len(rows) == PART_ROWS:
                put()
        if rows:
            put()
        return Written(parts)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            for end in (".npy", ".rows.npy"):
                (self.path / f"{name}{end}").unlink(missing_ok=True)

    def commit(self, messages: list[Written | None]) -> None:
        manifest = self.path / "manifest.json"
        old = json.loads(manifest.read_text())["parts"] if manifest.exists() else []
        self.path.mkdir(parents=True, exist_ok=True)
        fresh = manifest.with_suffix(".new")
        fresh.write_text(json.dumps({"parts": sorted(p for m in messages if m for p in m.parts)}))
        fresh.replace(manifest)
        self._drop(old)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop([p for m in messages if m for p in m.parts])


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _sparse(self) -> bool:
        return self.options.get("sparse", "false").lower() == "true"

    def schema(self) -> str:
        return "row bigint, col bigint, value double" if self._sparse() else "row bigint, values array<double>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("member"), self._sparse(), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
