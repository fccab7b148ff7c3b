"""Gates: boolean columns over two measurements; combine them with &, | and ~."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rectangle_gate(x: Column, y: Column, *, x_min: float, x_max: float, y_min: float, y_max: float) -> Column:
    """Inside the rectangle or on its sides; the comparisons reach a Parquet scan."""
    return x.between(x_min, x_max) & y.between(y_min, y_max)


def polygon_gate(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Inside the polygon of (x, y) vertices, closed by itself, by the even-odd rule.

    An edge counts where it crosses the row's height, its lower end included and
    its upper end not, to the right of the row. The bounding box goes first, so
    that a scan can skip what lies outside.
    """
    if len(vertices) < 3:
        return F.lit(False)
    xs, ys = [float(v[0]) for v in vertices], [float(v[1]) for v in vertices]
    edges = zip(zip(xs, ys), zip(xs[1:] + xs[:1], ys[1:] + ys[:1]))
    crossings = [((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < F.lit((xj - xi) / (yj - yi)) * (y - F.lit(yi)) + F.lit(xi)) for (xi, yi), (xj, yj) in edges if yi != yj]
    if not crossings:
        return F.lit(False)
    odd = reduce(lambda a, b: a != b, crossings)
    return rectangle_gate(x, y, x_min=min(xs), x_max=max(xs), y_min=min(ys), y_max=max(ys)) & odd
