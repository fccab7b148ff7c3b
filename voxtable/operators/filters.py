"""Image filters over voxel rows (z, y, x, value) of one channel.

Filters work on the given rows; absent voxels have the value ``fill``. Weighted
sums scatter each voxel to its neighbours and add up, which Spark aggregates in
part before the shuffle. Rank and ball filters work on cubes with a border of
their reach: a voxel is sent to the few cubes that need it, and a task holds one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.model import COORDS

BLOCK = 32
#: The same of a Gaussian, whose kernel holds one cube at a time.
GAUSS_BLOCK = 64
#: Sample types and the range that contrast is stretched to.
RANGES = {"uint8": (0.0, 255.0), "uint16": (0.0, 65535.0), "int16": (-32768.0, 32767.0), "int32": (-2147483648.0, 2147483647.0)}


def _per_axis(v) -> tuple:
    return tuple(v) if isinstance(v, (tuple, list)) else (v, v, v)


def reflect(i: Column, n: int) -> Column:
    """An index beyond the edges as its half-sample mirror image (d c b a | a b c d | d c b a)."""
    p = F.pmod(i, F.lit(2 * n))
    return F.when(p < n, p).otherwise(2 * n - 1 - p)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights at offsets -r..r, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(volume: DataFrame, shape: tuple[int, int, int], sigma, integers: bool = False, fill: float = 0.0, block: int = GAUSS_BLOCK) -> DataFrame:
    """Separable Gaussian with mirrored edges; an axis of sigma 0 or one voxel is skipped.

    One shuffle: a task holds a cube with its border and blurs it an axis at a
    time. The cube's edge grows with the reach, so that a voxel is sent to few
    cubes. Voxels that no row reaches are ``fill`` and are left out. With
    ``integers`` results are truncated, as integer samples are.
    """
    weights = [[1.0] if s == 0 or n == 1 else gaussian_weights(float(s)) for n, s in zip(shape, _per_axis(sigma))]
    reach = tuple(len(w) // 2 for w in weights)

    def kernel(dense: np.ndarray) -> np.ndarray:
        for axis, w in enumerate(weights):
            n = dense.shape[axis] - len(w) + 1
            dense = sum(x * dense[tuple(slice(k, k + n) if a == axis else slice(None) for a in range(3))] for k, x in enumerate(w))
        return np.trunc(dense) if integers else dense

    return on_blocks(volume, shape, reach, kernel, fill=fill, outside=None, block=max(block, 2 * max(reach)), sparse=True)


def _images(c: str, n: int, r: int, mirror: bool) -> Column:
    """Positions from -r to n + r - 1 at which a voxel stands, with its mirror images."""
    at = [F.col(c)]
    if mirror and r:
        at = [F.col(c) + 2 * n * m for m in range(-(r // n) - 1, r // n + 2)] + [-1 - F.col(c) + 2 * n * m for m in range(-(r // n) - 1, r // n + 2)]
    return F.filter(F.array(*at), lambda p: (p >= -r) & (p < n + r))


def on_blocks(volume: DataFrame, shape: tuple[int, int, int], reach: tuple[int, int, int], kernel: Callable[[np.ndarray], np.ndarray], *, fill: float, outside: float | None, block: int = BLOCK, sparse: bool = False) -> DataFrame:
    """(z, y, x, value) of ``kernel`` over cubes with a border of ``reach`` voxels.

    ``kernel`` gets a dense cube with its border and returns the cube. Beyond the
    volume's edges stand mirror images, or ``outside`` if given. A row is
    sent to the cubes whose border holds it. With ``sparse`` voxels that equal
    ``fill`` are left out.
    """
    rows = volume.select(*COORDS, F.col("value").cast("double").alias("value"))
    for c, n, r in zip(COORDS, shape, reach):
        # All positions first, then all cubes of each: mirror images need borders too.
        rows = rows.withColumn(c, F.explode(_images(c, int(n), r, outside is None)))
    for c, n, r in zip(COORDS, shape, reach):
        last = (int(n) - 1) // block
        first_cube = F.greatest(F.lit(0), F.floor((F.col(c) - r) / block)).cast("int")
        last_cube = F.least(F.lit(last), F.floor((F.col(c) + r) / block)).cast("int")
        rows = rows.withColumn("b" + c, F.explode(F.sequence(first_cube, last_cube)))
    sizes, reaches = tuple(map(int, shape)), tuple(map(int, reach))

    def cube(pdf: pd.DataFrame) -> pd.DataFrame:
        origin = [int(pdf["b" + c].iloc[0]) * block for c in COORDS]
        inner = [min(block, n - o) for n, o in zip(sizes, origin)]
        dense = np.full([i + 2 * r for i, r in zip(inner, reaches)], fill)
        if outside is not None:
            for k, (o, i, n, r) in enumerate(zip(origin, inner, sizes, reaches)):
                at = np.arange(o - r, o + i + r)
                index = [slice(None)] * 3
                index[k] = (at < 0) | (at >= n)
                dense[tuple(index)] = outside
        dense[tuple(pdf[c].to_numpy() - o + r for c, o, r in zip(COORDS, origin, reaches))] = pdf["value"].to_numpy()
        out = kernel(dense)
        z, y, x = np.nonzero(out != fill) if sparse else (i.ravel() for i in np.indices(out.shape))
        return pd.DataFrame({"z": z + origin[0], "y": y + origin[1], "x": x + origin[2], "value": out[out != fill] if sparse else out.ravel()})

    return rows.groupBy(*["b" + c for c in COORDS]).applyInPandas(cube, "z int, y int, x int, value double")


def median_filter(volume: DataFrame, shape: tuple[int, int, int], radius, fill: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Median over boxes of int(2r + 1) voxels an axis, edges mirrored; the upper one of an even count.

    Cubes without any row are ``fill`` throughout and are left out.
    """
    sizes = [1 if n == 1 else int(2 * r + 1) for n, r in zip(shape, _per_axis(radius))]
    before = [s // 2 for s in sizes]

    def kernel(dense: np.ndarray) -> np.ndarray:
        trim = tuple(slice(0, n - (b - (s - 1 - b))) for n, s, b in zip(dense.shape, sizes, before))
        view = np.lib.stride_tricks.sliding_window_view(dense[trim], sizes)
        out = np.empty(view.shape[:3])
        for k in range(len(view)):  # a plane at a time
            flat = view[k].reshape(*view.shape[1:3], -1)
            out[k] = np.partition(flat, flat.shape[-1] // 2, axis=-1)[..., flat.shape[-1] // 2]
        return out

    return on_blocks(volume, shape, tuple(before), kernel, fill=fill, outside=None, block=block)


def subtract_background(volume: DataFrame, shape: tuple[int, int, int], *, radius: float = 50, fill: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Rolling ball: max(0, v - background), where the ball of ``radius`` touches the volume from below.

    The background is min over offsets o of v(p + o) + r - sqrt(r^2 - |o|^2);
    what lies outside the volume is not touched. The offsets are taken as rows along
    x: those of one |(z, y)| and x share a height, so planes that mirror each other
    are joined by their minimum first. The cube's edge is the radius at least (but
    64 at most), so that a voxel is sent to few cubes.
    """
    r = int(radius)
    reach = tuple(0 if n == 1 else min(r, int(n)) for n in shape)
    def kernel(dense: np.ndarray) -> np.ndarray:
        inner = [n - 2 * r for n, r in zip(dense.shape, reach)]
        low = np.full(inner, np.inf)

        def mirrored(a: np.ndarray, axis: int, k: int) -> np.ndarray:
            """Minimum of what stands k before and k behind, trimmed to the inner part of the axis."""
            n, e = inner[axis], reach[axis]
            cut = lambda s: a[tuple(slice(s, s + n) if d == axis else slice(None) for d in range(3))]
            return cut(e) if not k else np.minimum(cut(e - k), cut(e + k))

        for z in range(reach[0] + 1):
            planes = mirrored(dense, 0, z)
            for y in range(reach[1] + 1):
                left = radius * radius - z * z - y * y
                if left < 0:
                    break
                rows = mirrored(planes, 1, y)
                for x in range(min(reach[2], math.isqrt(int(left))) + 1):
                    np.minimum(low, mirrored(rows, 2, x) + (radius - math.sqrt(left - x * x)), out=low)
        own = dense[tuple(slice(r, r + n) for r, n in zip(reach, inner))]
        return np.maximum(own - low, 0.0)

    return on_blocks(volume, shape, reach, kernel, fill=fill, outside=math.inf, block=max(block, min(64, r)))


def enhance_contrast(volume: DataFrame, shape: tuple[int, int, int] | None = None, *, method: str = "normalize", dtype: str = "float64", clip: float = 0.01, bins: int = 256, tiles: int = 8) -> DataFrame:
    """``normalize`` stretches the values to the sample type's range; ``equalize`` equalises histograms of tiles.

    Floats stretch to 0..1, or to -1..1 with negative values; a constant volume
    is clipped to the range.
    """
    if method == "normalize":
        ends = volume.agg(F.min("value").cast("double").alias("__lo"), F.max("value").cast("double").alias("__hi"))
        low, high = RANGES.get(dtype, (None, 1.0))
        lo = F.lit(low) if low is not None else F.when(F.col("__lo") < 0, -1.0).otherwise(0.0)
        if dtype in ("int16", "int32"):
            lo = F.when(F.col("__lo") < 0, low).otherwise(0.0)
        stretched = F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (F.lit(high) - lo) + lo
        clipped = F.greatest(lo, F.least(F.lit(high), F.col("value").cast("double")))
        rest = [c for c in volume.columns if c != "value"]
        return volume.crossJoin(F.broadcast(ends)).select(*rest, F.when(F.col("__hi") > F.col("__lo"), stretched).otherwise(clipped).alias("value"))
    if method == "equalize":
        if shape is None:
            raise ValueError("equalize needs the volume's shape")
        return _clahe(volume, shape, clip, bins, tiles)
    raise ValueError(f"unknown contrast method {method!r}")


def _clahe(volume: DataFrame, shape: tuple[int, int, int], clip: float, bins: int, tiles: int) -> DataFrame:
    """Contrast-limited adaptive equalisation (Zuiderveld 1994): tile histograms, clipped, and blended linearly.

    Histograms are grouped counts; a tile's curve has ``bins`` levels, so the
    curves are tiles ** 3 * bins numbers at most, 1 MB by default, whatever the volume. Each
    task holds them and looks up a voxel's levels where it is read; voxels are not shuffled.
    """
    sides = [max(1, math.ceil(n / tiles)) for n in shape]
    counts = [math.ceil(n / s) for n, s in zip(shape, sides)]
    ends = volume.agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    rows = volume.crossJoin(F.broadcast(ends)).select(*COORDS, F.least(F.lit(bins - 1), F.floor(scaled * bins)).cast("int").alias("bin"))
    tile = [F.floor(F.col(c) / s).cast("int").alias("t" + c) for c, s in zip(COORDS, sides)]
    keys = ["t" + c for c in COORDS]
    hist = rows.groupBy(*tile, "bin").agg(F.count("*").alias("n"))
    total = hist.groupBy(*keys).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    limit = F.greatest(F.lit(1.0), F.ceil(F.lit(clip) * F.col("all")).cast("double"))
    # Every bin of every tile: counts above the limit are spread over all bins.
    full = total.select(*keys, "all", "h", limit.alias("limit"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("n", F.coalesce(F.try_element_at("h", F.col("bin")), F.lit(0)).cast("double"))
    from pyspark.sql.window import Window

    over = full.withColumn("spare", F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0.0))).over(Window.partitionBy(*keys)))
    curve = over.select(*keys, "bin", (F.sum(F.least("n", "limit") + F.col("spare") / bins).over(Window.partitionBy(*keys).orderBy("bin")) / F.col("all")).alias("level"))
    # tiles ** 3 * bins levels at most; a tile without voxels has none.
    levels = np.zeros((*counts, bins))
    got = curve.toArrow()
    levels[tuple(got.column(k).to_numpy() for k in range(4))] = got.column(4).to_numpy()

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for k, (s, n) in enumerate(zip(sides, counts)):
                # The two tiles whose centres enclose the voxel, and the share of each.
                at = (b.column(k).to_numpy() + 0.5) / s - 0.5
                low = np.floor(at).astype(int)
                near.append(((np.maximum(low, 0), 1 - (at - low)), (np.minimum(low + 1, n - 1), at - low)))
            bin_ = b.column(3).to_numpy()
            value = sum(wz * wy * wx * levels[tz, ty, tx, bin_] for (tz, wz), (ty, wy), (tx, wx) in itertools.product(*near))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(value)], [*COORDS, "value"])

    return rows.select(*[F.col(c).cast("int").alias(c) for c in COORDS], "bin").mapInArrow(blend, "z int, y int, x int, value double")
