"""Zarr version 2 arrays: one file for each chunk, uncompressed or zlib or gzip.

A data source of Spark reads and writes them. Which chunks a query needs follows
from the array's metadata and from the ranges or pushed filters on its axes,
before any chunk is opened; each of them is a partition of the scan, whose task opens
that file only. Writing makes a fresh copy beside the old array, one file for each chunk,
in tasks, and the driver's commit puts it in place with its metadata.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from voxtable.model import VolumeFrame
from voxtable.sources.files import FreshCopy, Written, file_store, narrowed, read_whole, register, small_file

VOXELS = "c int, z int, y int, x int, value double"
AXES = ("c", "z", "y", "x")
KEYS = tuple("k" + n for n in AXES)
#: Chunk edges when none are given.
AUTO = (1, 64, 256, 256)
#: Partitions of a scan at most; beyond them consecutive chunks share one.
PARTITIONS = 100_000


@dataclass(frozen=True)
class Layout:
    """What the metadata of an array says, checked."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    order: str
    fill: float
    codec: str | None
    separator: str

    @classmethod
    def of(cls, meta: dict) -> Layout:
        if len(meta["shape"]) != 4:
            raise ValueError(f"a 4D array is needed, not one of {len(meta['shape'])} axes")
        if meta.get("filters"):
            raise ValueError("filters are not read")
        codec = (meta.get("compressor") or {}).get("id")
        if codec not in (None, "zlib", "gzip"):
            raise ValueError(f"compressor {codec!r} is not available here; zlib, gzip and none are")
        return cls(tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"]), meta.get("order", "C"), float(meta.get("fill_value") or 0), codec, meta.get("dimension_separator", "."))

    def block(self, content: bytes) -> np.ndarray:
        raw = zlib.decompress(content) if self.codec == "zlib" else gzip.decompress(content) if self.codec == "gzip" else content
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)

    def content(self, block: np.ndarray) -> bytes:
        raw = block.tobytes(self.order)
        return zlib.compress(raw, 1) if self.codec == "zlib" else gzip.compress(raw, 1, mtime=0) if self.codec == "gzip" else raw

    def metadata(self) -> str:
        return json.dumps({"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": self.dtype.str, "order": self.order, "fill_value": self.fill if self.dtype.kind == "f" else int(self.fill),
                           "filters": None, "compressor": {"id": self.codec, "level": 1} if self.codec else None})


@dataclass
class Chunks(InputPartition):
    """Consecutive chunks of those that a scan needs, by their numbers among them."""

    first: int
    end: int


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, ranges: dict[str, tuple[int, int]]):
        self.path, self.layout = path, layout
        self.ranges = {n: (max(0, ranges.get(n, (0, s))[0]), min(s, ranges.get(n, (0, s))[1])) for n, s in zip(AXES, layout.shape)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.ranges = narrowed(self.ranges, filters)
        yield from filters  # Spark tests them once more, at little cost

    def grid(self) -> tuple[list[int], list[int]]:
        """First chunk and number of chunks along each axis."""
        first = [a // c for (a, _), c in zip(self.ranges.values(), self.layout.chunks)]
        count = [max(0, -(-b // c) - f) if b > a else 0 for (a, b), c, f in zip(self.ranges.values(), self.layout.chunks, first)]
        return first, count

    def partitions(self) -> list[Chunks]:
        n = int(np.prod(self.grid()[1]))
        step = max(1, -(-n // PARTITIONS))
        return [Chunks(k, min(k + step, n)) for k in range(0, n, step)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store, base = file_store(self.path)
        first, count = self.grid()
        for number in range(partition.first, partition.end):
            keys = [int(f + k) for f, k in zip(first, np.unravel_index(number, count))]
            content = read_whole(store, f"{base}/{self.layout.separator.join(map(str, keys))}")
            if content is not None:  # else all of it is the fill value
                yield from self.rows(keys, self.layout.block(content))

    def rows(self, keys: list[int], block: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = [k * c for k, c in zip(keys, self.layout.chunks)]
        low = [max(a, s) for (a, _), s in zip(self.ranges.values(), starts)]
        block = block[tuple(slice(a - s, min(b, s + c) - s) for a, (_, b), s, c in zip(low, self.ranges.values(), starts, self.layout.chunks))]
        for c, z in np.ndindex(block.shape[:2]):  # a plane at a time bounds the rows of a batch
            plane = block[c, z]
            y, x = np.nonzero(plane != self.layout.fill)
            if len(y):
                at = [np.full(len(y), low[0] + c, np.int32), np.full(len(y), low[1] + z, np.int32), (y + low[2]).astype(np.int32), (x + low[3]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(plane[y, x].astype(float))], [*AXES, "value"])


class ChunkWriter(FreshCopy):
    """Rows (KEYS, AXES, value) sorted by chunk; a task holds one chunk at a time."""

    def __init__(self, path: str, layout: Layout):
        super().__init__(path)
        self.layout = layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = file_store(self.fresh)
        lay, block, own, done = self.layout, None, None, 0

        def close() -> None:
            self.put(store, base, lay.separator.join(map(str, own)), lay.content(block))

        for b in iterator:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            if not b.num_rows:
                continue
            keys = np.stack(cols[:4])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                if own != (here := tuple(keys[:, s].tolist())):
                    if own is not None:
                        close()
                        done += 1
                    own, block = here, np.full(lay.chunks, lay.fill, lay.dtype)
                block[tuple(a[s:e] - k * c for a, k, c in zip(cols[4:8], own, lay.chunks))] = cols[8][s:e].astype(lay.dtype)
        if own is not None:
            close()
            done += 1
        return Written(done)

    def finish(self, store, base: str) -> None:
        super().finish(store, base)
        self.put(store, base, ".zarray", self.layout.metadata().encode())


class ChunkSource(DataSource):
    """``spark.read.format("voxtable_chunks").load(path)``; the option ``ranges`` is JSON of {axis: [first, end]}."""

    @classmethod
    def name(cls) -> str:
        return "voxtable_chunks"

    def schema(self) -> str:
        return VOXELS

    def _layout(self) -> Layout:
        text = self.options.get("metadata")
        if text is None:
            store, base = file_store(self.options["path"])
            content = read_whole(store, f"{base}/.zarray")
            if content is None:
                raise ValueError(f"no array in {self.options['path']}")
            text = content.decode()
        return Layout.of(json.loads(text))

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], self._layout(), json.loads(self.options.get("ranges", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], self._layout())


def read_zarr(spark: SparkSession, path: str, ranges: dict[str, tuple[int, int]] | None = None) -> VolumeFrame:
    """A chunked 4D array as voxels, lazily; ``ranges`` ({axis: (first, end)}) limits it to the chunks that overlap.

    Chunks without a file, and voxels that equal the array's fill value in them,
    are absent rows; the frame's ``fill`` is that value. Filters on the frame's
    axes choose the chunks as ranges do.
    """
    path = path.rstrip("/")
    meta = small_file(spark, f"{path}/.zarray")
    if meta is None:
        raise ValueError(f"no array in {path}")
    layout = Layout.of(json.loads(meta))
    whole = {n: (0, s) for n, s in zip(AXES, layout.shape)} | (ranges or {})
    name = register(spark, ChunkSource)

    def read(more: dict[str, tuple[int, int]]) -> DataFrame:
        inside = {n: [max(a, more.get(n, (a, b))[0]), min(b, more.get(n, (a, b))[1])] for n, (a, b) in whole.items()}
        return spark.read.format(name).option("metadata", meta).option("ranges", json.dumps(inside)).load(path)

    kind = str(layout.dtype) if str(layout.dtype) in ("uint8", "uint16", "int16", "int32", "float32", "float64") else "float64"
    return VolumeFrame(read({}), layout.shape, kind, layout.fill, chunked=True, read=read)


def write_zarr(volume: VolumeFrame, path: str, chunks: tuple[int, int, int, int] | None = None, compressor: str | None = "zlib") -> None:
    """Writes a version 2 array, in place of what was there once all chunks are written."""
    if compressor not in (None, "zlib", "gzip"):
        raise ValueError(f"compressor {compressor!r} is not available")
    sizes = tuple(min(c, s) for c, s in zip(chunks or AUTO, volume.shape))
    layout = Layout(tuple(volume.shape), sizes, np.dtype(volume.dtype), "C", volume.fill, compressor, ".")
    at = [F.floor(F.col(n) / c).cast("int").alias(k) for n, k, c in zip(AXES, KEYS, sizes)]
    rows = volume.df.select(*at, *[F.col(n).cast("int").alias(n) for n in AXES], F.col("value").cast("double").alias("value"))
    name = register(volume.df.sparkSession, ChunkSource)
    rows.repartition(*KEYS).sortWithinPartitions(*KEYS).write.format(name).option("metadata", layout.metadata()).mode("overwrite").save(path.rstrip("/"))
