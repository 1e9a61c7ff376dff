"""A data source for volume files whose partitions are byte ranges.

A task reads a file's header and the bytes of the slices that start in its range, so a file larger
than a task's share is split, the depth of a volume costs its header alone, and one chunk costs its own
bytes. Filters on volume_id prune files before any is opened; filters on slice_index and chunk_index
prune slices before they are read; without `pixels` in the schema no voxel is read. Compressed files
cannot be entered in the middle: they are one range each, decompressed up to the last wanted slice.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import operator
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..contracts import CHUNK_DEPTH, DataError
from .volumes import nifti_header

SLICES = "volume_id string, slice_index bigint, chunk_index bigint, height int, width int, pixels array<float>, bytes_read bigint"
HEADERS = "volume_id string, depth bigint, height int, width int, n_chunks bigint, dtype string, bytes_read bigint"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of a partition, of the slices of one Arrow batch, and what opening a file counts for.
RANGE_BYTES, BATCH_BYTES, OPEN_BYTES = 64 << 20, 4 << 20, 4 << 20
NIFTI_HEADER = 352
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, some: x in some}


class Counted:
    """A file opened for reading that counts what it fetches."""

    def __init__(self, path: str) -> None:
        store, own = fs.FileSystem.from_uri(path)
        self.file, self.fetched, self.at = store.open_input_file(own), 0, 0

    def fetch(self, offset: int, size: int) -> bytes:
        data = self.file.read_at(size, offset)
        self.fetched += len(data)
        return data

    def read(self, size: int = -1) -> bytes:
        """For the decompressor, which reads on from where it is."""
        data = self.fetch(self.at, size if size >= 0 else self.file.size() - self.at)
        self.at += len(data)
        return data

    def close(self) -> None:
        self.file.close()


class Inflated:
    """A compressed file; bytes come in ascending order."""

    def __init__(self, raw: Counted) -> None:
        self.stream, self.at, self.head = gzip.GzipFile(fileobj=raw, mode="rb"), 0, b""

    def fetch(self, offset: int, size: int) -> bytes:
        if offset == 0 and not self.at:
            self.head, self.at = self.stream.read(size), size
            return self.head
        kept = self.head[offset : offset + size]
        while self.at < offset:
            self.at += len(self.stream.read(min(offset - self.at, BATCH_BYTES))) or (offset - self.at)
        data = kept + self.stream.read(size - len(kept))
        self.at = max(self.at, offset + len(data))
        return data


@dataclass
class Layout:
    """Where the slices of a volume lie in its file."""

    depth: int
    height: int
    width: int
    kind: np.dtype
    offset: int
    columns_first: bool = False  # a slice is stored column by column
    apart: bool = False  # the voxels of a slice do not lie together
    slope: float = 1.0
    intercept: float = 0.0

    @property
    def slice_bytes(self) -> int:
        return self.height * self.width * self.kind.itemsize

    def decode(self, data: bytes, count: int) -> np.ndarray:
        """(count, height * width) float32."""
        values = np.frombuffer(data, self.kind)
        if values.size != count * self.height * self.width:
            raise DataError(f"a volume file ends early: {values.size} voxels where {count * self.height * self.width} are due")
        if self.apart:
            values = values.reshape((self.depth, self.height, self.width), order="F")
        elif self.columns_first:
            values = values.reshape((count, self.width, self.height)).transpose(0, 2, 1)
        values = values.reshape(count, -1).astype(np.float32)
        if self.slope not in (0.0, 1.0) or self.intercept and self.slope:
            values = values * np.float32(self.slope) + np.float32(self.intercept)
        return values


def npy_layout(source: Counted) -> Layout:
    head = source.fetch(0, 128)
    if head[:6] != b"\x93NUMPY":
        raise DataError("not an array file")
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little") + (12 if wide else 10)
    if size > len(head):
        head += source.fetch(len(head), size - len(head))
    stream = io.BytesIO(head)
    version = np.lib.format.read_magic(stream)
    shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    while len(shape) > 3 and shape[0] == 1:
        shape = shape[1:]
    if len(shape) != 3 or kind.hasobject:
        raise DataError(f"a volume has three axes of numbers, not {shape} of {kind}")
    return Layout(*shape, kind, size, apart=by_columns)


def nifti_layout(source: Counted | Inflated) -> Layout:
    shape, kind, offset, slope, intercept = nifti_header(source.fetch(0, NIFTI_HEADER))
    while len(shape) > 3 and shape[-1] == 1:
        shape = shape[:-1]
    if len(shape) != 3:
        raise DataError(f"a volume has three axes, not {shape}")
    height, width, depth = shape
    return Layout(depth, height, width, kind, offset, columns_first=True, slope=slope, intercept=intercept)


def opened(path: str) -> tuple[Counted, Counted | Inflated, Layout]:
    raw = Counted(path)
    if path.endswith(".npy"):
        return raw, raw, npy_layout(raw)
    source = Inflated(raw) if path.endswith(".gz") else raw
    return raw, source, nifti_layout(source)


def volume_name(path: str) -> str:
    return re.sub(r"\.(npy|nii\.gz|nii)$", "", path.rsplit("/", 1)[-1])


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) of each file, or part of one, that a task reads."""

    parts: list[tuple[str, int, int]]


class VolumeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.root, self.glob = options["path"], options.get("glob", "*.npy")
        self.range_bytes, self.chunk_depth = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("chunkDepth", CHUNK_DEPTH))
        self.names = schema.names
        self.wanted: list[tuple[str, type[Filter], object]] = []

    def files(self) -> list[tuple[str, int]]:
        """Matching files by path; names that a filter on volume_id excludes are left out unopened."""
        store, top = fs.FileSystem.from_uri(self.root)
        prefix = self.root[: len(self.root) - len(top)] if self.root.endswith(top) else ""
        try:
            found = store.get_file_info(fs.FileSelector(top, recursive=True))
        except FileNotFoundError as error:
            raise DataError(f"no folder of volumes at {self.root}") from error
        return sorted((prefix + x.path, x.size) for x in found if x.is_file and fnmatch.fnmatch(x.base_name, self.glob) and self.keeps("volume_id", volume_name(x.path)))

    def keeps(self, column: str, value: object) -> bool:
        for name, kind, bound in self.wanted:
            if name == column and not (value.startswith(bound) if kind is StringStartsWith else COMPARE[kind](value, bound)):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        out, held, size = [], [], 0
        for path, length in self.files():
            step = length if path.endswith(".gz") or self.whole_files() else self.range_bytes
            for start in range(0, max(length, 1), max(step, 1)):
                share = min(step, length - start) if self.reads_voxels() else 0
                if held and size + share > self.range_bytes:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, start, min(start + step, length)))
                size += share + OPEN_BYTES
        return [*out, Ranges(held)] if held else out

    def whole_files(self) -> bool:
        return False

    def reads_voxels(self) -> bool:
        return "pixels" in self.names

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.parts if partition else ():
            raw, source, layout = opened(path)
            try:
                yield from self.rows(path, raw, source, layout, start, end)
            finally:
                raw.close()

    def rows(self, path: str, raw: Counted, source: Counted | Inflated, layout: Layout, start: int, end: int) -> Iterator[pa.RecordBatch]:
        if isinstance(source, Inflated):
            mine = range(layout.depth)
        elif layout.apart:
            mine = range(layout.depth) if start == 0 else range(0)
        else:
            first, after = (min(max(0, -(-(at - layout.offset) // layout.slice_bytes)), layout.depth) for at in (start, end))
            mine = range(first, after)
        wanted = [z for z in mine if self.keeps("slice_index", z) and self.keeps("chunk_index", z // self.chunk_depth)]
        told, whole = 0, None
        for group in stretches(wanted, max(1, BATCH_BYTES // max(1, layout.slice_bytes))):
            pixels = None
            if self.reads_voxels():
                if layout.apart:
                    if whole is None:
                        whole = layout.decode(source.fetch(layout.offset, layout.depth * layout.slice_bytes), layout.depth)
                    pixels = whole[group.start : group.stop]
                else:
                    pixels = layout.decode(source.fetch(layout.offset + group.start * layout.slice_bytes, len(group) * layout.slice_bytes), len(group))
            n, told_now = len(group), raw.fetched
            columns = {
                "volume_id": lambda: pa.array([volume_name(path)] * n),
                "slice_index": lambda: pa.array(group, pa.int64()),
                "chunk_index": lambda: pa.array([z // self.chunk_depth for z in group], pa.int64()),
                "height": lambda: pa.array([layout.height] * n, pa.int32()),
                "width": lambda: pa.array([layout.width] * n, pa.int32()),
                "pixels": lambda: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (layout.height * layout.width)), pa.array(pixels.ravel())),
                "bytes_read": lambda: pa.array([told_now - told] + [0] * (n - 1), pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], self.names)
            told = told_now


class HeaderReader(VolumeReader):
    """A row per volume, from its header."""

    def whole_files(self) -> bool:
        return True

    def rows(self, path: str, raw: Counted, source: Counted | Inflated, layout: Layout, start: int, end: int) -> Iterator[pa.RecordBatch]:
        row = {"volume_id": volume_name(path), "depth": layout.depth, "height": layout.height, "width": layout.width, "n_chunks": -(-layout.depth // self.chunk_depth), "dtype": str(layout.kind), "bytes_read": raw.fetched}
        kinds = {str: pa.string(), int: pa.int64()} | dict.fromkeys(("height", "width"), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c) or kinds[type(row[c])]) for c in self.names], self.names)


class _Pushing:
    """Takes filters on names and places; for sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            numbers = column in ("slice_index", "chunk_index") and type(f) in COMPARE
            if numbers or column == "volume_id" and type(f) in (EqualTo, In, StringStartsWith):
                self.wanted.append((column, type(f), set(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


class PushingVolumeReader(_Pushing, VolumeReader):
    pass


class PushingHeaderReader(_Pushing, HeaderReader):
    pass


class VolumeSlices(DataSource):
    """Slice rows. Options: path, glob, rangeBytes, chunkDepth. A narrower schema reads less."""

    own_schema, own_reader = SLICES, VolumeReader

    @classmethod
    def name(cls) -> str:
        return "volume_slices"

    def schema(self) -> str:
        return self.own_schema

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self.own_reader(self.options, schema)


class PushingVolumeSlices(VolumeSlices):
    own_reader = PushingVolumeReader


class VolumeHeaders(VolumeSlices):
    """A row per volume: its name and shape."""

    own_schema, own_reader = HEADERS, HeaderReader

    @classmethod
    def name(cls) -> str:
        return "volume_headers"


class PushingVolumeHeaders(VolumeHeaders):
    own_reader = PushingHeaderReader


def stretches(places: Sequence[int], most: int) -> Iterator[range]:
    """Consecutive places as ranges of at most so many."""
    at = 0
    while at < len(places):
        end = at + 1
        while end < len(places) and end - at < most and places[end] == places[end - 1] + 1:
            end += 1
        yield range(places[at], places[end - 1] + 1)
        at = end


def register(spark: SparkSession) -> None:
    """Make `volume_slices` and `volume_headers` known; filters are pushed where the session allows it."""
    pushes = spark.conf.get(PUSHDOWN, "false") == "true"
    for source in (PushingVolumeSlices, PushingVolumeHeaders) if pushes else (VolumeSlices, VolumeHeaders):
        spark.dataSource.register(source)


def _load(spark: SparkSession, name: str, schema: str, root: str, columns: Sequence[str] | None, options: dict[str, object]) -> DataFrame:
    register(spark)
    wanted = T.StructType([f for f in spark.createDataFrame([], schema).schema if columns is None or f.name in columns])
    if columns is not None and len(wanted) != len(set(columns)):
        raise DataError(f"no such columns: {sorted(set(columns) - set(wanted.names))}")
    return spark.read.format(name).schema(wanted).options(**options).load(root)


def scan_slices(spark: SparkSession, root: str, glob: str = "*.npy", columns: Sequence[str] | None = None, range_bytes: int = RANGE_BYTES, chunk_depth: int = CHUNK_DEPTH) -> DataFrame:
    """Slice rows of matching files below root, which any task may open; only `columns`, if given, are made.

    Files of voxels in column order are read whole by one task. Empty folders give no rows; broken and
    shortened files raise.
    """
    return _load(spark, "volume_slices", SLICES, root, columns, {"glob": glob, "rangeBytes": range_bytes, "chunkDepth": chunk_depth})


def scan_headers(spark: SparkSession, root: str, glob: str = "*.npy", columns: Sequence[str] | None = None, chunk_depth: int = CHUNK_DEPTH) -> DataFrame:
    """A row per volume with its depth and number of chunks, from headers alone."""
    return _load(spark, "volume_headers", HEADERS, root, columns, {"glob": glob, "chunkDepth": chunk_depth})


def read_chunk(spark: SparkSession, root: str, volume_id: str, chunk: int, glob: str = "*.npy", chunk_depth: int = CHUNK_DEPTH) -> DataFrame:
    """The slices of one chunk of one volume; where filters are pushed, only its file is opened and only its bytes are read."""
    return scan_slices(spark, root, glob, chunk_depth=chunk_depth).filter((F.col("volume_id") == volume_id) & (F.col("chunk_index") == chunk))
