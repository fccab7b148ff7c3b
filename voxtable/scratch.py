"""Lineage cuts: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode without it, a temporary one.

    On a cluster without the setting this raises, since a machine-local folder
    would not be seen by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _local["dir"]


def cut(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    The result has no lineage behind the files, so a lost executor costs no
    recomputation, and its size is known to the planner, which broadcasts it
    in a join only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    ``codec`` is the files' compression, the session's own if it is not given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxtable/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote and that no result reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if "/voxtable/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
