"""Volumes as DataFrames: voxel rows with the metadata that rows cannot carry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a voxel, and the range that contrast is stretched to, by sample type.
ITEMSIZE = {"uint8": 1, "uint16": 2, "int16": 2, "int32": 4, "float32": 4, "float64": 8}
COORDS = ("z", "y", "x")
DEFAULT_MAX_BYTES = 4 << 30


@dataclass(frozen=True)
class VolumeFrame:
    """Voxels (c, z, y, x, value) of a volume of ``shape`` (C, Z, Y, X).

    Absent voxels have the value ``fill``, so sparse volumes stay sparse.
    ``dtype`` is the sample type of the source, which Spark's types cannot tell
    (it has no unsigned ones); ``chunked`` tells whether it is read lazily from
    chunk files, and ``read`` then gives the voxels of ranges ({axis: (first, end)})
    from the chunks that hold them, without loading the others.
    """

    df: DataFrame
    shape: tuple[int, int, int, int]
    dtype: str = "float64"
    fill: float = 0.0
    chunked: bool = False
    read: Callable[[dict[str, tuple[int, int]]], DataFrame] | None = None

    def __post_init__(self):
        if len(self.shape) != 4:
            raise ValueError(f"a volume is 4D (C, Z, Y, X), not of shape {self.shape}")
        if self.dtype not in ITEMSIZE:
            raise ValueError(f"unknown sample type {self.dtype}")

    n_channels = property(lambda self: self.shape[0])
    depth = property(lambda self: self.shape[1])
    height = property(lambda self: self.shape[2])
    width = property(lambda self: self.shape[3])
    is_chunked = property(lambda self: self.chunked)

    @property
    def nbytes(self) -> int:
        return reduce(lambda a, b: a * b, self.shape) * ITEMSIZE[self.dtype]

    def fits_in_memory(self, max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
        """By metadata alone: never runs a job."""
        return self.nbytes <= max_bytes

    def within(self, ranges: dict[str, tuple[int, int]]) -> DataFrame:
        """(c, z, y, x, value) inside half-open ranges; a filter that reaches the scan, or the choice of chunks."""
        if self.read is not None:
            return self.read(ranges)
        return reduce(lambda d, r: d.where((F.col(r[0]) >= r[1][0]) & (F.col(r[0]) < r[1][1])), ranges.items(), self.df)

    def channel(self, index: int) -> DataFrame:
        """(z, y, x, value) of one channel."""
        c = self._index(index, 0)
        return self.within({"c": (c, c + 1)}).select(*COORDS, "value")

    def to_numpy(self, *, max_bytes: int = DEFAULT_MAX_BYTES) -> np.ndarray:
        """The dense array (C, Z, Y, X) on the driver; raises MemoryError, before any job, if it is larger than ``max_bytes``."""
        if not self.fits_in_memory(max_bytes):
            raise MemoryError(f"a volume of {self.nbytes} bytes is over the budget of {max_bytes}")
        out = np.full(self.shape, self.fill, self.dtype)
        got = self.df.select("c", *COORDS, F.col("value").cast("double").alias("value")).toArrow()  # bounded by the budget
        out[tuple(got.column(k).to_numpy() for k in range(4))] = got.column(4).to_numpy()
        return out

    def _index(self, i: int, axis: int) -> int:
        n = self.shape[axis]
        if not -n <= i < n:
            raise IndexError(f"index {i} is out of range for an axis of {n}")
        return i % n

    def voxel(self, c: int, z: int, y: int, x: int) -> float:
        """One voxel's value; negative indexes count from the end."""
        at = [self._index(i, k) for k, i in enumerate((c, z, y, x))]
        row = self.within({n: (v, v + 1) for n, v in zip(("c", *COORDS), at)}).select("value").first()
        return self.fill if row is None else float(row[0])

    def subvolume(self, c: int, z0: int, y0: int, x0: int, depth: int, height: int, width: int) -> DataFrame:
        """(z, y, x, value) of a box, counted from its corner; the box is clipped at the volume's edges."""
        k = self._index(c, 0)
        out = self.within({"c": (k, k + 1)} | {name: (first, first + n) for name, first, n in zip(COORDS, (z0, y0, x0), (depth, height, width))})
        return out.select(*[(F.col(n) - F.lit(first)).cast("int").alias(n) for n, first in zip(COORDS, (z0, y0, x0))], "value")

    def with_values(self, df: DataFrame, dtype: str | None = None) -> VolumeFrame:
        return replace(self, df=df, dtype=dtype or self.dtype, read=None)


def check_shapes(a: tuple, b: tuple) -> None:
    if tuple(a) != tuple(b):
        raise ValueError(f"shape mismatch: {tuple(a)} and {tuple(b)}")


def from_table(df: DataFrame, z: Column, y: Column, x: Column, value: Column, shape: tuple[int, int, int, int], c: Column | None = None) -> VolumeFrame:
    """A volume from any table: rows that fall on one voxel are added up."""
    keys = [(F.lit(0) if c is None else c).cast("int").alias("c"), *[k.cast("int").alias(n) for k, n in zip((z, y, x), COORDS)]]
    return VolumeFrame(df.groupBy(*keys).agg(F.sum(value).cast("double").alias("value")), shape)
