"""Comparisons of segmentations, feature tables and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.model import COORDS


def segmentation_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``iou``: foreground intersection over union of two sparse label frames; 1 if both are empty."""
    fg = lambda d, name: d.where("label <> 0").select(*COORDS, F.lit(1).alias(name))
    both = fg(a, "a").join(fg(b, "b"), list(COORDS), "full")
    return both.agg(F.coalesce(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count("*")), F.lit(1.0)).alias("iou"))


def feature_table_diff(actual: DataFrame, expected: DataFrame, *, key: str, rtol: float = 1e-3, atol: float = 1e-6) -> DataFrame:
    """(column, status, max_abs, max_rel, n_failing) of numeric columns of ``expected`` that differ; empty if all agree.

    Values agree if |a - e| <= atol + rtol * |e|, or if both are NaN or null.
    Raises ValueError if the keys of the two tables differ.
    """
    marked = actual.select(key, F.lit(1).alias("a")).join(expected.select(key, F.lit(1).alias("e")), key, "full")
    odd = marked.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra")).first()
    if odd["missing"] or odd["extra"]:
        raise ValueError(f"the keys differ: {odd['missing']} missing, {odd['extra']} extra")
    numeric = [f.name for f in expected.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != key]
    there = [c for c in numeric if c in actual.columns]
    rows = expected.select(key, *[F.col(c).cast("double").alias("e_" + c) for c in there]).join(actual.select(key, *[F.col(c).cast("double").alias("a_" + c) for c in there]), key)
    empty = "column string, status string, max_abs double, max_rel double, n_failing long"
    lost = actual.sparkSession.createDataFrame([(c, "missing_in_actual", None, None, None) for c in numeric if c not in there], empty)
    if not there:
        return lost
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("a_" + c).alias("a"), F.col("e_" + c).alias("e")) for c in there])).alias("t")).select("t.*")
    off = F.abs(F.col("a") - F.col("e"))
    same = F.col("a").eqNullSafe(F.col("e")) | F.coalesce(~F.isnan(off) & (off <= atol + rtol * F.abs("e")), F.lit(False))
    diffs = cells.groupBy("column").agg(F.max(off).alias("max_abs"), F.max(off / F.greatest(F.abs("e"), F.lit(atol))).alias("max_rel"), F.count_if(~same).alias("n_failing")).where("n_failing > 0")
    return lost.unionByName(diffs.select("column", F.lit("out_of_tolerance").alias("status"), "max_abs", "max_rel", "n_failing"))


def cluster_assignment_ari(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``: adjusted Rand index of two labels of the same rows (Hubert and Arabie 1985); 1 where it is undefined."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("ra"), F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rb"))
    inner = cells.agg(F.sum(two(F.col("n"))).alias("index"))
    one = inner.crossJoin(rows).crossJoin(cols)  # three tables of one row
    expected = F.try_divide(F.col("ra") * F.col("rb"), two(F.col("n")))
    return one.select(F.coalesce(F.try_divide(F.col("index") - expected, (F.col("ra") + F.col("rb")) / 2 - expected), F.lit(1.0)).alias("ari"))
