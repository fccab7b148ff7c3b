"""Readers and writers of volumes; :func:`open_volume` picks one by the path."""

from __future__ import annotations

from pyspark.sql import SparkSession

from voxtable.model import VolumeFrame
from voxtable.sources.blocks import NOTE, read_blocks, write_blocks
from voxtable.sources.files import small_file
from voxtable.sources.tiff import read_tiff, write_tiff
from voxtable.sources.zarr import read_zarr, write_zarr

__all__ = ["open_volume", "read_blocks", "read_tiff", "read_zarr", "write_blocks", "write_tiff", "write_zarr"]

#: Files that mark a folder as a chunk store.
MARKERS = (".zarray", ".zgroup", "zarr.json")


def open_volume(spark: SparkSession, path: str) -> VolumeFrame:
    """A volume by its path: .tif or .tiff (a file or a folder of planes), .zarr, or a folder with the marker of a chunk or block store."""
    name = path.rstrip("/").lower()
    if name.endswith((".tif", ".tiff")):
        return read_tiff(spark, path)
    if name.endswith(".zarr") or any(small_file(spark, f"{path.rstrip('/')}/{m}") is not None for m in MARKERS):
        return read_zarr(spark, path)
    if small_file(spark, f"{path.rstrip('/')}/{NOTE}") is not None:
        return read_blocks(spark, path)
    raise ValueError(f"no reader knows a volume of this name: {path}")
