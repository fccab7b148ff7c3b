"""Per-object measurements of labelled volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.model import COORDS, check_shapes
from voxtable.scratch import cut


def object_ids(labels: DataFrame) -> DataFrame:
    """The nonzero labels, in order."""
    return labels.where("label <> 0").select("label").distinct().orderBy("label")


def dense_background(labels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(z, y, x) of the voxels that no sparse label row covers."""
    spark = labels.sparkSession
    n = shape[0] * shape[1] * shape[2]
    grid = spark.range(n).select((F.col("id") / (shape[1] * shape[2])).cast("int").alias("z"), ((F.col("id") / shape[2]).cast("long") % shape[1]).cast("int").alias("y"), (F.col("id") % shape[2]).cast("int").alias("x"))
    return grid.join(labels.where("label <> 0").select(*COORDS), list(COORDS), "left_anti")


def object_pixel_indices(labels: DataFrame, object_id: int, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """(z, y, x) of an object in raster order; id 0 is the background, which needs the shape."""
    if object_id == 0:
        if shape is None:
            raise ValueError("the background needs the volume's shape")
        return dense_background(labels, shape).orderBy(*COORDS)
    return labels.where(F.col("label") == object_id).select(*COORDS).orderBy(*COORDS)


def object_intensity_values(labels: DataFrame, intensity: DataFrame, object_id: int, label_shape: tuple | None = None, intensity_shape: tuple | None = None) -> DataFrame:
    """(z, y, x, value) of an object's voxels in raster order."""
    if label_shape is not None and intensity_shape is not None:
        check_shapes(label_shape, intensity_shape)
    own = labels.where(F.col("label") == object_id).select(*COORDS)
    return own.join(intensity.select(*COORDS, "value"), list(COORDS)).orderBy(*COORDS)


#: Column order of the table.
STATISTICS = ("count", "mean", "min", "max", "sum", "stddev", "threshold_mean")


def extract_measurements(labels: DataFrame, intensity: DataFrame, label_shape: tuple | None = None, intensity_shape: tuple | None = None, extra: dict[str, Column] | None = None, fill: float = 0.0) -> DataFrame:
    """One row for each object: object_id and STATISTICS, then the aggregates of ``extra``.

    Labelled voxels without an intensity row have the value ``fill``. One join on
    the coordinates, written once and read twice, and one more shuffle by object:
    the extremes that the threshold mean needs are aggregated in part before it and
    joined back, so a huge object is never gathered in one task.
    """
    if label_shape is not None and intensity_shape is not None:
        check_shapes(label_shape, intensity_shape)
    voxels = labels.where("label <> 0").select(*COORDS, F.col("label").alias("object_id")).join(intensity.select(*COORDS, F.col("value").cast("double").alias("value")), list(COORDS), "left")
    values = voxels.select("object_id", F.coalesce("value", F.lit(float(fill))).alias("value"), *(COORDS if extra else ()))
    return measure(cut(values, "values"), extra)


def measure(values: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """The measurement table of rows (object_id, value)."""
    ends = values.groupBy("object_id").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    joined = values.join(ends, "object_id")
    top = F.col("value") >= F.col("__hi") - (F.col("__hi") - F.col("__lo")) / 4
    aggs = [F.count("*").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"),
            F.stddev_pop("value").alias("stddev"), F.avg(F.when(top, F.col("value"))).alias("threshold_mean")]
    return joined.groupBy("object_id").agg(*aggs, *[c.alias(n) for n, c in (extra or {}).items()])


def threshold_mean(values: DataFrame, key: str | None = None) -> DataFrame:
    """Mean of the values within the top quarter of the range, for each ``key`` or of all rows; NaN without rows."""
    keys = [key] if key else []
    ends = values.groupBy(*keys).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    joined = values.join(ends, key) if key else values.crossJoin(F.broadcast(ends))
    top = F.col("value") >= F.col("__hi") - (F.col("__hi") - F.col("__lo")) / 4
    return joined.groupBy(*keys).agg(F.coalesce(F.avg(F.when(top, F.col("value"))), F.lit(float("nan"))).alias("threshold_mean"))


def rank_objects(table: DataFrame, by: str, within: str, top: int) -> DataFrame:
    """The ``top`` objects of each group by a measurement, ties by id."""
    w = Window.partitionBy(within).orderBy(F.desc(by), "object_id")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
