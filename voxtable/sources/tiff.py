"""TIFF volumes, classic and big.

A volume is one multi-page file or a folder of plane files in the order of
their names. A data source of Spark reads and writes them: each page of a single
file, and each file of a folder, is a partition of the scan, whose task reads the
page's directory and then the bytes of the strips or tiles that it needs. Ranges and
pushed filters on channels and planes choose pages, those on rows and columns strips
and tiles, before their bytes are read. Strips and tiles, both byte orders, 8- to 64-bit integers
and floats, uncompressed, Deflate and PackBits are read.

Writing makes a folder of one file for each plane, or one file: as its pages have
one size, their places are known beforehand and tasks write them side by side. Either
is a fresh copy until the driver's commit puts it in place.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from voxtable.model import VolumeFrame
from voxtable.sources.files import FreshCopy, Written, file_store, local_path, narrowed, register

VOXELS = "c int, z int, y int, x int, value double"
AXES = ("c", "z", "y", "x")
#: Pages of a single file that share a partition, so that a scan has no more partitions than this.
PARTITIONS = 100_000
#: Bytes from which a single file is written as a big one, with 64-bit places.
BIG = 1 << 32

#: Sizes of TIFF field types by their number.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def to_czyx(axes: str, sizes: list[int]) -> list[tuple[str, int | None]]:
    """Where each of C, Z, Y, X stands in ``axes`` (None: it is missing and has size 1).

    Time is dropped if it has one point; samples and other axes are refused.
    """
    axes = axes.upper()
    if "T" in axes and sizes[axes.index("T")] != 1:
        raise NotImplementedError("time series are not volumes")
    if "S" in axes:
        raise NotImplementedError("samples (colour pixels) are not channels")
    if "Y" not in axes or "X" not in axes:
        raise ValueError(f"axes {axes} have no plane")
    if odd := set(axes) - set("TCZYX"):
        raise ValueError(f"unknown axes {''.join(sorted(odd))}")
    return [(a, axes.index(a) if a in axes else None) for a in "CZYX"]


@dataclass
class Form:
    """A file open for reads of byte ranges, with its byte order and the width of its places."""

    at: Callable[[int, int], bytes]
    order: str
    big: bool
    first: int

    @classmethod
    def of(cls, at: Callable[[int, int], bytes]) -> Form:
        head = at(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else None
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        return cls(at, order, version == 43, struct.unpack_from(order + ("Q" if version == 43 else "I"), head, 8 if version == 43 else 4)[0])


def _entries(f: Form, at: int, values: bool = True) -> tuple[dict[int, tuple], int]:
    """Tags of the directory at ``at``, without those outside it unless ``values``, and the place of the next one."""
    head, entry, place = (8, 20, "Q") if f.big else (2, 12, "I")
    (n,) = struct.unpack(f.order + ("Q" if f.big else "H"), f.at(at, head))
    width = struct.calcsize(f.order + place)
    data = f.at(at + head, entry * n + width)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f.order + "HH" + place, data, entry * k)
        if kind not in SIZES:
            continue
        raw = data[entry * k + 4 + width : entry * (k + 1)]
        if SIZES[kind] * count > width:
            if not values:
                continue
            raw = f.at(struct.unpack(f.order + place, raw)[0], SIZES[kind] * count)
        if kind == 2:
            tags[tag] = (raw[:count].rstrip(b"\0").decode("utf-8", "replace"),)
        elif kind in CODES:
            tags[tag] = struct.unpack_from(f"{f.order}{count}{CODES[kind]}", raw, 0)
    return tags, struct.unpack_from(f.order + place, data, entry * n)[0]


def directories(f: Form) -> Iterator[int]:
    """The places of all page directories, found by their links."""
    at, seen = f.first, set()
    while at and at not in seen:
        yield at
        seen.add(at)
        at = _entries(f, at, values=False)[1]


def _unpack_bits(raw: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def page(f: Form, at: int, ys: tuple[int, int] | None = None, xs: tuple[int, int] | None = None) -> tuple[np.ndarray, int, int]:
    """The samples of one page in the given rows and columns, and the page's height and width; other strips and tiles are not read."""
    tags, _ = _entries(f, at)
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (1,))[0]
    if tags.get(277, (1,))[0] != 1:
        raise NotImplementedError("samples (colour pixels) are not channels")
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits}-bit samples are not read")
    packing = tags.get(259, (1,))[0]
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(packing)
    if unpack is None:
        raise ValueError(f"TIFF compression {packing} is not read")
    dtype = np.dtype(f"{f.order}{KINDS[tags.get(339, (1,))[0]]}{bits // 8}")
    tiled = 324 in tags
    places, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    (y0, y1), (x0, x1) = ((max(0, a), min(b, n)) for (a, b), n in zip((ys or (0, height), xs or (0, width)), (height, width)))
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
    across = -(-width // tw)
    out = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), dtype)
    for k, (p, n) in enumerate(zip(places, counts)):
        y, x = k // across * th, k % across * tw
        low, left, high, right = max(y, y0), max(x, x0), min(y + th, y1), min(x + tw, x1)
        if low < high and left < right:
            block = np.frombuffer(unpack(f.at(p, n)), dtype)
            block = block[: len(block) // tw * tw].reshape(-1, tw)
            if tags.get(317, (1,))[0] == 2:
                block = np.cumsum(block, axis=1, dtype=dtype)
            out[low - y0 : high - y0, left - x0 : right - x0] = block[low - y : high - y, left - x : right - x]
    return out, height, width


def page_axes(text: str, pages: int) -> tuple[str, list[int]]:
    """The axes that a file's pages run through, slowest first, and their sizes, from its description.

    An OME description names its own order (fastest first); a stack's description
    by channels, slices and frames has channels fastest, then planes. Without
    either, pages are planes. Sizes that do not fit the pages are refused, but for
    planes that are not stated: they take what is left.
    """
    if "<OME" in text or "DimensionOrder" in text:
        if text.count("<Image ") + text.count("<Image>") > 1:
            raise NotImplementedError("a file of several series is not one volume")
        sizes = {k: int(v) for k, v in re.findall(r'Size([CZT])="(\d+)"', text)}
        order = (re.search(r'DimensionOrder="XY([CZT]{3})"', text) or ["", "CZT"])[1][::-1]
        sizes = [sizes.get(a, 1) for a in order]
    else:
        stated = {k: int(v) for k, v in re.findall(r"(?m)^(channels|slices|frames)=(\d+)", text)}
        order, channels, frames = "TZC", stated.get("channels", 1), stated.get("frames", 1)
        rest = channels * frames
        sizes = [frames, stated.get("slices", max(1, pages // rest)), channels]
    if int(np.prod(sizes)) != pages:
        raise ValueError(f"{pages} pages are not the {'x'.join(map(str, sizes))} of the axes {order}")
    return order, sizes


def page_place(order: str, sizes: list[int]) -> tuple[list[tuple[str, int | None]], int, int]:
    """Where C and Z stand in the pages' axes, checked by :func:`to_czyx`, and the channels and planes of a file."""
    places = to_czyx(order + "YX", [*sizes, 1, 1])
    by = dict(zip(order, sizes))
    return places, by.get("C", 1), by.get("Z", 1)


def _open(store, path: str) -> Form:
    handle = store.open_input_file(path)
    return Form.of(lambda at, n: handle.read_at(n, at))


def _files(path: str) -> list[str]:
    """The TIFF file at ``path``, or those of the folder by their names."""
    from pyarrow.fs import FileSelector, FileType

    store, base = file_store(path)
    kind = store.get_file_info(base).type
    found = [base] if kind == FileType.File else [i.path for i in store.get_file_info(FileSelector(base)) if re.search(r"\.tiff?$", i.path, re.IGNORECASE)] if kind == FileType.Directory else []
    if not found:
        raise ValueError(f"no TIFF file in {path}")
    return sorted(found)


@dataclass(frozen=True)
class Stack:
    """How the files of a volume make it up: ``pages`` pages each, through the axes ``order`` of ``sizes``."""

    files: int
    pages: int
    order: str
    sizes: tuple[int, ...]
    height: int
    width: int
    dtype: str

    @classmethod
    def of(cls, path: str) -> Stack:
        files = _files(path)
        f = _open(file_store(path)[0], files[0])
        pages = sum(1 for _ in directories(f))
        tags, _ = _entries(f, f.first)
        kind = {"u1": "uint8", "u2": "uint16", "i2": "int16", "i4": "int32", "f4": "float32", "f8": "float64"}.get(f"{KINDS[tags.get(339, (1,))[0]]}{tags.get(258, (1,))[0] // 8}", "float64")
        order, sizes = page_axes(tags.get(270, ("",))[0], pages)
        return cls(len(files), pages, order, tuple(sizes), tags[257][0], tags[256][0], kind)

    @property
    def shape(self) -> tuple[int, int, int, int]:
        _, channels, planes = page_place(self.order, list(self.sizes))
        return channels, planes * self.files, self.height, self.width

    def place(self, file: int, k: int) -> tuple[int, int]:
        """Channel and plane of a file's page."""
        at = dict(zip(self.order, np.unravel_index(k, self.sizes)))
        planes = self.shape[1] // self.files
        return int(at.get("C", 0)), file * planes + int(at.get("Z", 0))


@dataclass
class Pages(InputPartition):
    """Pages of one file: (number, place of the directory or 0 where the task follows the links)."""

    path: str
    file: int
    pages: list[tuple[int, int]]


class PageReader(DataSourceReader):
    def __init__(self, path: str, stack: Stack, ranges: dict[str, tuple[int, int]]):
        self.path, self.stack = path, stack
        self.ranges = {n: tuple(ranges.get(n, (0, s))) for n, s in zip(AXES, stack.shape)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.ranges = narrowed(self.ranges, filters)
        yield from filters  # Spark tests them once more, at little cost

    def wanted(self, file: int, k: int) -> bool:
        c, z = self.stack.place(file, k)
        return self.ranges["c"][0] <= c < self.ranges["c"][1] and self.ranges["z"][0] <= z < self.ranges["z"][1]

    def partitions(self) -> list[Pages]:
        files = _files(self.path)
        if len(files) == 1:
            found = [(k, at) for k, at in enumerate(directories(_open(file_store(self.path)[0], files[0]))) if self.wanted(0, k)]
            step = max(1, -(-len(found) // PARTITIONS))
            out = [Pages(files[0], 0, found[a : a + step]) for a in range(0, len(found), step)]
        else:
            out = [Pages(p, n, some) for n, p in enumerate(files) if (some := [(k, 0) for k in range(self.stack.pages) if self.wanted(n, k)])]
        return out or [Pages("", 0, [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.pages:
            return
        f, places = _open(file_store(self.path)[0], partition.path), []
        if not partition.pages[0][1]:
            places = list(directories(f))
            if len(places) != self.stack.pages:
                raise ValueError(f"a file of {len(places)} pages among files of {self.stack.pages}")
        y0, x0 = max(0, self.ranges["y"][0]), max(0, self.ranges["x"][0])
        for k, at in partition.pages:
            p, height, width = page(f, at or places[k], self.ranges["y"], self.ranges["x"])
            if (height, width) != (self.stack.height, self.stack.width):
                raise ValueError(f"a page of {(height, width)} among pages of {(self.stack.height, self.stack.width)}")
            c, z = self.stack.place(partition.file, k)
            for a in range(0, len(p), step := max(1, 262_144 // max(1, p.shape[1]))):
                y, x = np.nonzero(p[a : a + step])
                if len(y):
                    at_ = [np.full(len(y), c, np.int32), np.full(len(y), z, np.int32), (y + a + y0).astype(np.int32), (x + x0).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, at_), pa.array(p[a : a + step][y, x].astype(float))], [*AXES, "value"])


class PlaneWriter(FreshCopy):
    """Rows (z, c, y, x, value) sorted by plane, with a row of a null channel in a plane without voxels: a file for each plane."""

    def __init__(self, path: str, shape: tuple[int, ...], dtype: str, fill: float):
        super().__init__(path)
        self.shape, self.dtype, self.fill = shape, np.dtype(dtype), fill

    def runs(self, iterator: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """(first ``keys`` columns, the other coordinates, values) of each run of rows that agree in them."""
        for b in iterator:
            if b.num_rows:
                cols = [b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(5)]
                head = np.stack(cols[:keys])
                edges = [0, *(np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
                for s, e in zip(edges[:-1], edges[1:]):
                    some = ~np.isnan(cols[keys][s:e])
                    yield tuple(head[:, s].astype(int).tolist()), np.stack([a[s:e][some].astype(int) for a in cols[keys:4]]), cols[4][s:e][some].astype(self.dtype)

    def dense(self, iterator: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each run's rows as an array with the fill value elsewhere, one at a time."""
        edges = (self.shape[0], *self.shape[2:])[keys - 1 :]
        own, out = None, None
        for key, at, values in self.runs(iterator, keys):
            if key != own:
                if own is not None:
                    yield own, out
                own, out = key, np.full(edges, self.fill, self.dtype)
            out[tuple(at)] = values
        if own is not None:
            yield own, out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = file_store(self.fresh)
        text, n = f"ImageJ=1.11a\nimages={self.shape[0]}\nchannels={self.shape[0]}\n", 0
        for (z,), planes in self.dense(iterator, 1):
            self.put(store, base, f"z{z:06d}.tif", _plane_file(list(planes), text))
            n += 1
        return Written(n)


class StackWriter(PlaneWriter):
    """Rows (z, c, y, x, value) sorted by plane and channel: one file, whose pages the tasks write at their places.

    Directories follow the pages and are written by the commit. A page without
    rows stays a hole of the file, which reads as zeros.
    """

    def __init__(self, path: str, shape: tuple[int, ...], dtype: str, fill: float):
        super().__init__(path, shape, dtype, fill)
        self.size = self.shape[2] * self.shape[3] * self.dtype.itemsize
        self.step = self.size + self.size % 2
        self.big = 16 + self.step * self.shape[0] * self.shape[1] + 300 * self.shape[0] * self.shape[1] >= BIG

    def at(self, z: int, c: int) -> int:
        return 16 + self.step * (z * self.shape[0] + c)

    def file(self) -> int:
        path = local_path(self.fresh)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return os.open(path, os.O_RDWR | os.O_CREAT, 0o644)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        handle, n = self.file(), 0
        try:
            for (z, c), plane in self.dense(iterator, 2):
                raw, at = memoryview(plane.astype(plane.dtype.newbyteorder("<")).tobytes()), self.at(z, c)
                while raw:  # a large write may be cut short
                    wrote = os.pwrite(handle, raw, at)
                    raw, at = raw[wrote:], at + wrote
                n += 1
        finally:
            os.close(handle)
        return Written(n)

    def finish(self, store, base: str) -> None:
        channels, depth, height, width = self.shape
        text = f"ImageJ=1.11a\nimages={channels * depth}\nchannels={channels}\nslices={depth}\nhyperstack=true\nmode=grayscale\n".encode() + b"\0"
        text += bytes(len(text) % 2)
        entry, place, count = ("<HHQQ", "<Q", "<Q") if self.big else ("<HHII", "<I", "<H")
        start = self.at(depth, 0)
        first = start + len(text)
        length = struct.calcsize(count) + 11 * struct.calcsize(entry) + struct.calcsize(place)
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        handle = self.file()
        try:
            os.pwrite(handle, struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if self.big else struct.pack("<2sHI", b"II", 42, first), 0)
            os.pwrite(handle, text, start)
            for k in range(channels * depth):
                tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, self.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(text) if k == 0 else 1, start if k == 0 else 0),
                        (273, 16 if self.big else 4, 1, self.at(0, k)), (277, 3, 1, 1), (278, 4, 1, height), (279, 16 if self.big else 4, 1, self.size), (339, 3, 1, kind)]
                after = 0 if k == channels * depth - 1 else first + length * (k + 1)
                os.pwrite(handle, struct.pack(count, len(tags)) + b"".join(struct.pack(entry, *t) for t in tags) + struct.pack(place, after), first + length * k)
        finally:
            os.close(handle)


class PageSource(DataSource):
    """``spark.read.format("voxtable_pages").load(path)``; the option ``ranges`` is JSON of {axis: [first, end]}."""

    @classmethod
    def name(cls) -> str:
        return "voxtable_pages"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema: StructType) -> PageReader:
        stack = self.options.get("stack")
        return PageReader(self.options["path"], Stack(**json.loads(stack)) if stack else Stack.of(self.options["path"]), json.loads(self.options.get("ranges", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> PlaneWriter:
        kind = StackWriter if self.options.get("layout") == "stack" else PlaneWriter
        return kind(self.options["path"], tuple(json.loads(self.options["shape"])), self.options["dtype"], float(self.options["fill"]))


def read_tiff(spark: SparkSession, path: str) -> VolumeFrame:
    """A TIFF file, or a folder of plane files in the order of their names, as voxels, lazily.

    The first file's description says how pages run through channels and planes;
    the others are held to its size. Voxels of value 0 are absent rows.
    """
    stack = Stack.of(path)
    name = register(spark, PageSource)

    def read(ranges: dict[str, tuple[int, int]]) -> DataFrame:
        return spark.read.format(name).option("stack", json.dumps(vars(stack))).option("ranges", json.dumps(ranges)).load(path)

    return VolumeFrame(read({}), stack.shape, stack.dtype, chunked=True, read=read)


def _plane_file(planes: list[np.ndarray], text: str) -> bytes:
    """A little-endian file with a page for each channel."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for k, p in enumerate(planes):
        raw, at = p.astype(p.dtype.newbyteorder("<")).tobytes(), len(out)
        out += raw + bytes(-len(raw) % 2)
        note = text.encode() + b"\0" if k == 0 else b"\0"
        if len(note) % 2:
            note += b"\0"
        note_at = len(out)
        out += note
        kind = {"u": 1, "i": 2, "f": 3}[p.dtype.kind]
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, p.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (270, 2, note_at), (273, 4, at), (277, 3, 1), (278, 4, p.shape[0]), (279, 4, len(raw)), (339, 3, kind)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, form, value in tags:
            count = len(note) if tag == 270 else 1
            if tag == 270 and count <= 4:
                value = int.from_bytes(note, "little")
            out += struct.pack("<HHII", tag, form, count, value)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def write_tiff(volume: VolumeFrame, path: str, stack: bool = False) -> None:
    """A folder of one file for each plane, with channels as pages; with ``stack`` one file with all planes' channels as pages.

    One file needs a folder that all executors share as a file system; other stores
    have no writes at a place. What was at ``path`` stays until all is written.
    """
    if stack and local_path(path) is None:
        raise ValueError(f"a single file is written to shared folders, not to {path}")
    keys = ["z", "c"] if stack else ["z"]
    spark, shape = volume.df.sparkSession, volume.shape
    rows = volume.df.select(*[F.col(n).cast("int").alias(n) for n in ("z", "c", "y", "x")], F.col("value").cast("double").alias("value"))
    if not stack:
        rows = spark.range(shape[1]).select(F.col("id").cast("int").alias("z")).join(rows, "z", "left")
    elif volume.fill:
        pages = spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[0]).cast("int").alias("z"), F.pmod("id", F.lit(shape[0])).cast("int").alias("c"))
        rows = pages.join(rows, keys, "left").select("z", "c", "y", "x", "value")
    out = rows.repartition(*keys).sortWithinPartitions(*keys).write.format(register(spark, PageSource))
    for option, value in (("shape", json.dumps(list(shape))), ("dtype", volume.dtype), ("fill", volume.fill), ("layout", "stack" if stack else "planes")):
        out = out.option(option, value)
    out.mode("overwrite").save(path.rstrip("/"))
