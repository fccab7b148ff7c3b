"""Table functions for SQL; :class:`~voxtable.store.MeasurementStore` knows them by their names."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="z int, y int, x int")
class Ball:
    """ball(z, y, x, radius, depth, height, width): the voxels of the volume within ``radius`` of a place; none for nulls."""

    def eval(self, z: float, y: float, x: float, radius: float, depth: int, height: int, width: int) -> Iterator[tuple[int, int, int]]:
        if None in (z, y, x, radius):
            return
        z, y, x, radius = map(float, (z, y, x, radius))
        reach = [range(max(0, math.ceil(c - radius)), min(n - 1, math.floor(c + radius)) + 1) for c, n in ((z, depth), (y, height), (x, width))]
        for k in reach[0]:
            for j in reach[1]:
                rest = radius * radius - (k - z) ** 2 - (j - y) ** 2
                for i in reach[2]:
                    if (i - x) ** 2 <= rest:
                        yield k, j, i


TABLE_FUNCTIONS = {"ball": Ball}


def register(spark: SparkSession) -> None:
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
