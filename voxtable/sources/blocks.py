"""Volumes as Parquet tables of blocks: a row for each block, a folder for each channel, rows sorted by block.

A block's samples are one binary value in C order. Range reads filter the blocks'
coordinates, on which the channel prunes folders and the row groups' statistics
prune the rest, before any sample is read; only then are blocks cut to the range and
turned into voxels. Blocks in which all voxels are the fill value have no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.model import VolumeFrame
from voxtable.sources.files import file_store, small_file

AXES = ("c", "z", "y", "x")
KEYS = ("c", "bz", "by", "bx")
VOXELS = "c int, z int, y int, x int, value double"
NOTE = "_volume.json"
#: Edges (z, y, x) of a block when none are given, and bytes of a row group: the unit that a read can leave out.
EDGES, GROUP = (32, 64, 64), 4 << 20


def _filled(edges: tuple[int, int, int], dtype: np.dtype, fill: float):
    """Rows (KEYS, z, y, x, value) sorted by block become blocks, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([int(k)], pa.int32()) for k in own), pa.array([block.tobytes()], pa.binary())], [*KEYS, "samples"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            keys = np.stack(cols[:4])
            ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(ends[:-1], ends[1:]):
                if own != (here := tuple(keys[:, s].tolist())):
                    if own is not None:
                        yield row()
                    own, block = here, np.full(edges, fill, dtype)
                block[tuple(a[s:e] - k * n for a, k, n in zip(cols[4:7], own[1:], edges))] = cols[7][s:e].astype(dtype)
        if own is not None:
            yield row()

    return run


def write_blocks(volume: VolumeFrame, path: str, edges: tuple[int, int, int] = EDGES) -> None:
    """Writes a volume as blocks, in place of what was there; a task holds one block at a time."""
    edges = tuple(min(int(e), max(1, n)) for e, n in zip(edges, volume.shape[1:]))
    at = [F.floor(F.col(n) / e).cast("int").alias("b" + n) for n, e in zip(AXES[1:], edges)]
    rows = volume.df.select(F.col("c").cast("int").alias("c"), *at, *[F.col(n).cast("int").alias(n) for n in AXES[1:]], F.col("value").cast("double").alias("value"))
    dealt = rows.where(F.col("value") != F.lit(volume.fill)).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    blocks = dealt.mapInArrow(_filled(edges, np.dtype(volume.dtype), volume.fill), "c int, bz int, by int, bx int, samples binary")
    blocks.write.mode("overwrite").option("parquet.block.size", GROUP).partitionBy("c").parquet(path)
    store, base = file_store(path)
    with store.open_output_stream(f"{base}/{NOTE}") as out:  # Spark's readers skip names that begin so
        out.write(json.dumps({"shape": list(volume.shape), "edges": list(edges), "dtype": volume.dtype, "fill": volume.fill}).encode())


def read_blocks(spark: SparkSession, path: str) -> VolumeFrame:
    """A volume of :func:`write_blocks`, lazily; ``within`` and what builds on it read the blocks that overlap."""
    path = path.rstrip("/")
    text = small_file(spark, f"{path}/{NOTE}")
    if text is None:
        raise ValueError(f"no blocks in {path}")
    note = json.loads(text)
    shape, edges, dtype, fill = tuple(note["shape"]), note["edges"], np.dtype(note["dtype"]), float(note["fill"])
    table = spark.read.schema("bz int, by int, bx int, samples binary, c int").parquet(path)

    def read(ranges: dict[str, tuple[int, int]]) -> DataFrame:
        span = {n: (max(0, ranges.get(n, (0, s))[0]), min(s, ranges.get(n, (0, s))[1])) for n, s in zip(AXES, shape)}
        blocks = table.where((F.col("c") >= span["c"][0]) & (F.col("c") < span["c"][1]))
        for n, e in zip(AXES[1:], edges):
            blocks = blocks.where((F.col("b" + n) >= span[n][0] // e) & (F.col("b" + n) <= (span[n][1] - 1) // e))

        def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    c, *at = (b.column(i)[k].as_py() for i in range(4))
                    block = np.frombuffer(b.column(4)[k].as_buffer(), dtype).reshape(edges)
                    starts = [i * e for i, e in zip(at, edges)]
                    low = [max(span[n][0], s) for n, s in zip(AXES[1:], starts)]
                    block = block[tuple(slice(a - s, min(span[n][1], s + e) - s) for n, a, s, e in zip(AXES[1:], low, starts, edges))]
                    z, y, x = np.nonzero(block != fill)
                    found = [np.full(len(z), c, np.int32), *((i + a).astype(np.int32) for i, a in zip((z, y, x), low))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(block[z, y, x].astype(float))], [*AXES, "value"])

        return blocks.select(*KEYS, "samples").mapInArrow(voxels, VOXELS)

    return VolumeFrame(read({}), shape, note["dtype"], fill, chunked=True, read=read)
