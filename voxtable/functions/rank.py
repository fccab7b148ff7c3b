"""Consecutive numbers and running sums in the order of a key, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.scratch import cut


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of the distinct values of ``key``, numbered from 1 in their order.

    Values are dealt out by range; each range is numbered on its own and starts
    where the ranges before it end. Only the ranges' counts come to the driver.
    """
    ranged = cut(df.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("__part")), "ranges")
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return ranged.join(F.broadcast(offsets), "__part").select(key, (F.col("__start") + own).cast("int").alias(name))


def running_sums(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """``df`` with up_COLUMN, the sum of the column up to the row's key, and the columns' sums over all rows; keys are distinct.

    Ranges of the key are summed on their own and start where those before them
    end, as in :func:`dense_index`.
    """
    ranged = cut(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = sorted(ranged.groupBy("__part").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns]).collect(), key=lambda r: r["__part"])
    starts, total = [], [0.0] * len(columns)
    for r in parts:
        starts.append((r["__part"], *total))
        total = [t + r[c] for t, c in zip(total, columns)]
    offsets = df.sparkSession.createDataFrame(starts, ", ".join(["__part int", *[f"`__b_{c}` double" for c in columns]]))  # one row for each partition
    own = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__part").select(*df.columns, *[(F.col(f"__b_{c}") + F.sum(F.col(c).cast("double")).over(own)).alias(f"up_{c}") for c in columns])
    return out, dict(zip(columns, total))
