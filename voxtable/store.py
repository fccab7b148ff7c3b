"""Named measurement tables and SQL over them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from voxtable.functions.tables import register

_READS = re.compile(r"\s*(?:--[^\n]*\n|\s)*\(*\s*(?:select|with|values|from|table|describe|explain|show)\b", re.IGNORECASE)


class MeasurementStore:
    """Tables by name in a session of their own, with the table functions of :mod:`voxtable.functions.tables`; queries return lazy DataFrames.

    Statements that would write to the warehouse are refused: registered tables
    live as long as the store. A closed store raises on every use.
    """

    def __init__(self, spark: SparkSession):
        self._spark: SparkSession | None = spark.newSession()
        register(self._spark)
        self._shared: list[str] = []

    def _session(self) -> SparkSession:
        if self._spark is None:
            raise RuntimeError("the store is closed")
        return self._spark

    def register(self, name: str, frame: DataFrame) -> None:
        """Makes ``frame`` known as ``name``, in place of an earlier table."""
        session = self._session()
        shared = f"voxtable_{uuid.uuid4().hex}"  # sessions see each other's global views
        frame.createGlobalTempView(shared)
        self._shared.append(shared)
        session.table(f"global_temp.{shared}").createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        if not _READS.match(sql):
            raise ValueError("only queries are run here; register tables with register()")
        return self._session().sql(sql)

    def close(self) -> None:
        if self._spark is not None:
            for name in self._shared:
                self._spark.catalog.dropGlobalTempView(name)
            self._spark = None

    def __enter__(self) -> MeasurementStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
