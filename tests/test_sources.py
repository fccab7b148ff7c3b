"""Volumes as data sources: what a scan opens, and what a failed write leaves."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from voxtable.model import VolumeFrame
from voxtable.sources import open_volume, read_zarr, write_blocks, write_tiff, write_zarr
from voxtable.sources.files import narrowed
from voxtable.sources.tiff import Form, PageReader, Stack, StackWriter, _plane_file, directories, page
from voxtable.sources.zarr import ChunkReader, Layout

VOXELS = "c int, z int, y int, x int, value double"


def volume(spark, a, dtype="int32", fill=0.0):
    rows = [(*map(int, p), float(a[tuple(p)])) for p in np.argwhere(a != fill)]
    return VolumeFrame(spark.createDataFrame(rows, VOXELS).repartition(3), a.shape, dtype, fill)


ARRAY = np.arange(1, 1 + 2 * 4 * 6 * 6).reshape(2, 4, 6, 6)


def test_a_range_opens_its_chunks_only(spark, tmp_path):
    """The other chunks cannot be opened at all: folders stand in their places."""
    write_zarr(volume(spark, ARRAY), f"{tmp_path}/v.zarr", (1, 2, 3, 3))
    for f in (tmp_path / "v.zarr").iterdir():
        if f.name[0].isdigit() and f.name != "1.1.0.1":
            f.unlink()
            f.mkdir()
    v = open_volume(spark, f"{tmp_path}/v.zarr")
    box = v.subvolume(1, 2, 0, 3, 2, 3, 3)
    assert sorted(tuple(r) for r in box.collect()) == sorted((z, y, x, float(ARRAY[1, 2 + z, y, 3 + x])) for z in range(2) for y in range(3) for x in range(3))
    assert v.voxel(1, 3, 2, 5) == ARRAY[1, 3, 2, 5]
    pushed = v.df.where("c = 1 AND z > 1 AND y <= 2 AND x BETWEEN 3 AND 9")
    assert pushed.rdd.getNumPartitions() == 1 and pushed.agg(F.sum("value")).first()[0] == ARRAY[1, 2:, :3, 3:].sum()
    assert v.df.where("c = 1 AND z IN (2, 3) AND y < 3 AND x = 4").count() == 2 * 3
    with pytest.raises(Exception):  # noqa: B017
        v.channel(0).collect()


def test_a_chunk_is_a_partition(spark, tmp_path):
    write_zarr(volume(spark, ARRAY), f"{tmp_path}/v.zarr", (1, 2, 3, 3), "gzip")
    v = open_volume(spark, f"{tmp_path}/v.zarr")
    assert v.df.rdd.getNumPartitions() == 2 * 2 * 2 * 2 and (v.to_numpy() == ARRAY).all()
    assert v.df.where("z > 9").count() == 0 and spark.read.format("voxtable_chunks").load(f"{tmp_path}/v.zarr").count() == ARRAY.size
    part = read_zarr(spark, f"{tmp_path}/v.zarr", {"y": (2, 5), "c": (1, 2)})
    assert part.df.agg(F.sum("value")).first()[0] == ARRAY[1:, :, 2:5].sum()
    assert part.within({"y": (0, 3)}).agg(F.sum("value")).first()[0] == ARRAY[1:, :, 2:3].sum()


def test_absent_chunks_are_fill(spark, tmp_path):
    a = np.full((1, 2, 5, 5), 7)
    a[0, 1, 4, 4] = 3
    write_zarr(volume(spark, a, fill=7.0), f"{tmp_path}/v.zarr", (1, 1, 2, 2), None)
    assert [f.name for f in (tmp_path / "v.zarr").iterdir() if f.name[0].isdigit()] == ["0.1.2.2"]
    v = open_volume(spark, f"{tmp_path}/v.zarr")
    assert v.fill == 7 and v.df.count() == 1 and (v.to_numpy() == a).all()
    write_zarr(VolumeFrame(spark.createDataFrame([], VOXELS), (1, 1, 1, 1)), f"{tmp_path}/none.zarr")
    assert open_volume(spark, f"{tmp_path}/none.zarr").df.count() == 0


def test_filters_narrow_ranges():
    whole = {"c": (0, 3), "z": (0, 10)}
    assert narrowed(whole, [EqualTo(("z",), 4), IsNotNull(("z",))]) == {"c": (0, 3), "z": (4, 5)}
    assert narrowed(whole, [GreaterThan(("z",), 2), LessThanOrEqual(("z",), 5), In(("c",), (1, None))]) == {"c": (1, 2), "z": (3, 6)}
    assert narrowed(whole, [GreaterThanOrEqual(("z",), 8), LessThan(("z",), 3)])["z"] == (8, 8)
    assert narrowed(whole, [EqualTo(("value",), 1.0), EqualTo(("z", "a"), 1)]) == whole


def test_partitions_are_bounded(monkeypatch):
    from voxtable.sources import zarr

    monkeypatch.setattr(zarr, "PARTITIONS", 5)
    reader = ChunkReader("x", Layout.of({"shape": [1, 4, 8, 8], "chunks": [1, 1, 4, 4], "dtype": "<u2"}), {})
    parts = reader.partitions()
    assert len(parts) <= 5 and [p.first for p in parts[1:]] == [p.end for p in parts[:-1]] and parts[-1].end == 16


@pytest.mark.parametrize("kind", ["zarr", "planes", "stack"])
def test_a_failed_write_leaves_the_old_volume(spark, tmp_path, kind):
    write = {"zarr": lambda v, p: write_zarr(v, p, (1, 1, 3, 3)), "planes": write_tiff, "stack": lambda v, p: write_tiff(v, p, stack=True)}[kind]
    path = f"{tmp_path}/v.{'zarr' if kind == 'zarr' else 'tif'}"
    old = volume(spark, ARRAY)
    write(old, path)
    broken = VolumeFrame(old.df.withColumn("value", F.when((F.col("z") == 3) & (F.col("y") == 5), F.raise_error(F.lit("no value")).cast("double")).otherwise(F.col("value") * 2)), ARRAY.shape, "int32")
    with pytest.raises(Exception, match="no value"):
        write(broken, path)
    assert (open_volume(spark, path).to_numpy() == ARRAY).all()
    assert [f.name for f in tmp_path.iterdir()] == [path.rsplit("/", 1)[1]]
    write(volume(spark, ARRAY * 2), path)
    assert (open_volume(spark, path).to_numpy() == ARRAY * 2).all() and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("dtype,fill", [("uint8", 0), ("uint16", 9), ("float32", 0.5), ("float64", 0)])
def test_one_file_of_all_pages(spark, tmp_path, dtype, fill):
    a = np.random.default_rng(1).integers(0, 200, (2, 3, 5, 7)).astype(dtype)
    a[1, 2] = fill
    write_tiff(volume(spark, a, dtype, fill), f"{tmp_path}/v.tif", stack=True)
    v = open_volume(spark, f"{tmp_path}/v.tif")
    assert v.shape == a.shape and v.dtype == dtype and (v.to_numpy() == a).all() and v.chunked
    assert v.df.rdd.getNumPartitions() == 6  # a page is a partition
    assert v.df.where("c = 1 AND z = 0").rdd.getNumPartitions() == 1 and v.voxel(1, 0, 4, 6) == a[1, 0, 4, 6]


def test_pages_of_a_folder(spark, tmp_path):
    write_tiff(volume(spark, ARRAY), f"{tmp_path}/v.tif")
    (tmp_path / "v.tif" / "z000002.tif").write_bytes(b"not an image")
    v = open_volume(spark, f"{tmp_path}/v.tif")
    assert v.shape == ARRAY.shape
    assert v.subvolume(1, 3, 1, 2, 1, 4, 3).agg(F.sum("value")).first()[0] == ARRAY[1, 3, 1:5, 2:5].sum()  # the bad file is not opened
    with pytest.raises(Exception, match="not a TIFF file"):
        v.df.count()


class Watched:
    """Bytes that remember which ranges were read."""

    def __init__(self, data):
        self.data, self.read = data, []

    def at(self, place, n):
        self.read.append((place, n))
        return self.data[place : place + n]


@pytest.mark.parametrize("big", [False, True])
def test_strips_outside_a_range_are_not_read(tmp_path, big):
    w = StackWriter(f"{tmp_path}/w.tif", (1, 2, 40, 30), "uint16", 0.0)
    w.big = big
    a = np.random.default_rng(2).integers(1, 900, (2, 40, 30))
    rows = [(z, 0, y, x, float(a[z, y, x])) for z in range(2) for y in range(40) for x in range(30)]
    done = w.write(iter([pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows])], ["z", "c", "y", "x", "value"])]))
    w.commit([done])
    assert done.files == 2
    data = Watched((tmp_path / "w.tif").read_bytes())
    f = Form.of(data.at)
    assert f.big == big
    places = list(directories(f))
    data.read.clear()
    p, height, width = page(f, places[1])
    assert (height, width) == (40, 30) and (p == a[1]).all() and sum(n for _, n in data.read) < 2 * 40 * 30 + 500
    stack = Stack.of(f"{tmp_path}/w.tif")
    assert stack.shape == (1, 2, 40, 30) and len(PageReader(f"{tmp_path}/w.tif", stack, {"z": (1, 2)}).partitions()) == 1


def test_strips_of_rows():
    """A page of eight strips: a range of rows reads the strips that hold it."""
    import struct

    a = np.arange(16 * 4, dtype=np.uint8).reshape(16, 4)
    strips = [a[k : k + 2].tobytes() for k in range(0, 16, 2)]
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    base = 8 + 2 + 12 * 7 + 4 + 64
    tags = [(256, 4, 1, 4), (257, 4, 1, 16), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 8, 8 + 2 + 12 * 7 + 4), (278, 4, 1, 2), (279, 4, 8, 8 + 2 + 12 * 7 + 4 + 32)]
    out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    out += struct.pack("<8I", *[base + 8 * k for k in range(8)]) + struct.pack("<8I", *[8] * 8) + b"".join(strips)
    data = Watched(bytes(out))
    f = Form.of(data.at)
    data.read.clear()
    p, *_ = page(f, f.first, (5, 9), (1, 3))
    assert (p == a[5:9, 1:3]).all() and [at for at, _ in data.read if at >= base] == [base + 8 * k for k in (2, 3, 4)]


def test_many_files_are_held_to_the_first(spark, tmp_path):
    for k, shape in enumerate([(4, 5), (4, 5), (4, 6)]):
        (tmp_path / f"p{k}.tif").write_bytes(_plane_file([np.ones(shape, np.uint8)], ""))
    (tmp_path / "v.tif").mkdir()
    for k in range(3):
        (tmp_path / f"p{k}.tif").rename(tmp_path / "v.tif" / f"p{k}.tif")
    with pytest.raises(Exception, match="among pages of"):
        open_volume(spark, f"{tmp_path}/v.tif").df.count()
    assert json.loads(json.dumps(vars(Stack.of(f"{tmp_path}/v.tif"))))["files"] == 3


@pytest.mark.parametrize("dtype,fill,edges", [("uint16", 0, (2, 3, 4)), ("float32", 1.5, (3, 2, 5)), ("uint8", 0, (64, 64, 64))])
def test_blocks_round_trip(spark, tmp_path, dtype, fill, edges):
    a = np.random.default_rng(3).integers(0, 99, (2, 5, 7, 9)).astype(dtype)
    a[1, :3] = fill
    write_blocks(volume(spark, a, dtype, fill), f"{tmp_path}/v", edges)
    write_blocks(volume(spark, a, dtype, fill), f"{tmp_path}/v", edges)
    v = open_volume(spark, f"{tmp_path}/v")
    assert v.shape == a.shape and v.dtype == dtype and v.fill == fill and (v.to_numpy() == a).all()
    box = v.subvolume(1, 2, 1, 3, 3, 4, 99)
    assert {tuple(r) for r in box.collect()} == {(z, y, x, float(a[1, 2 + z, 1 + y, 3 + x])) for z in range(3) for y in range(4) for x in range(6) if a[1, 2 + z, 1 + y, 3 + x] != fill}
    assert v.voxel(-1, -1, -1, -1) == a[-1, -1, -1, -1] and v.subvolume(0, 9, 0, 0, 1, 1, 1).count() == 0


def test_other_blocks_are_left_out_by_statistics(spark, tmp_path):
    """Samples of other blocks are never decoded: their bytes are too short to be one; and the scan's filters are pushed."""
    write_blocks(volume(spark, ARRAY), f"{tmp_path}/v", (2, 3, 3))
    raw = spark.read.parquet(f"{tmp_path}/v")
    broken = raw.withColumn("samples", F.when((F.col("c") == 1) & (F.col("bz") == 1) & (F.col("by") == 0) & (F.col("bx") == 1), F.col("samples")).otherwise(F.lit(b"no")))
    note = (tmp_path / "v" / "_volume.json").read_bytes()
    broken.write.partitionBy("c").parquet(f"{tmp_path}/w")
    (tmp_path / "w" / "_volume.json").write_bytes(note)
    v = open_volume(spark, f"{tmp_path}/w")
    box = v.subvolume(1, 2, 0, 3, 2, 3, 3)
    assert box.agg(F.sum("value")).first()[0] == ARRAY[1, 2:, :3, 3:].sum()
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(c" in plan and "GreaterThanOrEqual(bz,1)" in plan
    with pytest.raises(Exception):  # noqa: B017
        v.df.count()
    with pytest.raises(ValueError):
        open_volume(spark, f"{tmp_path}")
