"""Measurements of objects whose voxels arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_measurements(voxels: DataFrame) -> DataFrame:
    """object_id, count, mean, min, max, sum and stddev of a stream (object_id, value) so far.

    For the ``complete`` or ``update`` output mode; the state is a row for each object.
    """
    value = F.col("value").cast("double")
    return voxels.groupBy("object_id").agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.stddev_pop(value).alias("stddev"))


def windowed_measurements(voxels: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """The same for each window of ``time``; rows that come more than ``late`` after the newest are dropped, so the state is bounded."""
    value = F.col("value").cast("double")
    rows = voxels.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "object_id")
    return rows.agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), "object_id", "count", "mean", "max")
