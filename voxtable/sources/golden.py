"""Expected results kept as files: tables with a header, and label masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.sources.files import exists, small_file
from voxtable.sources.tiff import read_tiff

# The tables' columns and file names.
TABLES = {
    "measurements": ("{dataset}_measurements.csv", "object_id long, count long, mean double, sum double, stddev double, min double, max double"),
    "clustering_input": ("synthetic_clustering_input.csv", "point_id long, x double, y double"),
    "kmeans_k3": ("synthetic_clustering_kmeans_k3.csv", "point_id long, cluster int"),
    "pca": ("synthetic_clustering_pca.csv", "point_id long, pc1 double, pc2 double"),
}
MASK, METADATA = "{dataset}_segmentation_singlethreshold.tif", "{dataset}_metadata.txt"


def golden_table(spark: SparkSession, folder: str, name: str, dataset: str = "") -> DataFrame:
    """One of TABLES with its own types; the file's columns may come in any order. Raises FileNotFoundError without the file."""
    file, schema = TABLES[name]
    path = f"{folder.rstrip('/')}/{file.format(dataset=dataset)}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no expected results in {path}")
    columns = [c.strip().strip('"') for c in spark.read.text(path).first()[0].split(",")]
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    typed = spark.createDataFrame([], schema).schema
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in typed])


def golden_mask(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """(z, y, x, label) of a label mask."""
    path = f"{folder.rstrip('/')}/{MASK.format(dataset=dataset)}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no expected results in {path}")
    return read_tiff(spark, path).channel(0).select("z", "y", "x", F.col("value").cast("int").alias("label"))


def golden_metadata(spark: SparkSession, folder: str, dataset: str) -> dict[str, str]:
    """The lines of a dataset's notes as name and value."""
    path = f"{folder.rstrip('/')}/{METADATA.format(dataset=dataset)}"
    text = small_file(spark, path)
    if text is None:
        raise FileNotFoundError(f"no expected results in {path}")
    pairs = (line.replace("=", ":", 1).split(":", 1) for line in text.splitlines() if ":" in line or "=" in line)
    return {k.strip(): v.strip() for k, v in pairs}
