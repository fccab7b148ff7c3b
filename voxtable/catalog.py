"""Named queries over the driver's tables, with the SQL each must equal.

Volumes come from ``lineitem``: z is the line number, y and x are remainders of
the supplier's and the part's key, and a voxel's value is the sum of quantities.
The wide volume (1,024 by 1,024) is sparse, the small one (128 by 128) dense.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.model import COORDS, VolumeFrame, from_table
from voxtable.operators import classify, cluster, filters, flood, gates, joins, measure, neighbours, reduce, segment, tsne as tsne_, validate
from voxtable.scratch import cut, shared_dir
from voxtable.sources import open_volume, write_blocks, write_tiff, write_zarr
from voxtable.store import MeasurementStore
from voxtable.workflow import Pipeline, Step

WIDE, SMALL, DEPTH = 1024, 128, 7
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str, side: int = WIDE, channels: bool = False) -> VolumeFrame:
    c = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) if channels else None
    return from_table(table(spark, sf_dir, "lineitem"), F.col("l_linenumber") - 1, F.col("l_suppkey") % side, F.col("l_partkey") % side, F.col("l_quantity"), (3 if channels else 1, DEPTH, side, side), c)


def voxels(spark: SparkSession, sf_dir: str, side: int = WIDE) -> DataFrame:
    return volume(spark, sf_dir, side).df.select(*COORDS, "value")


def grid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by squares of 64 voxels where the value is at least 25."""
    v = voxels(spark, sf_dir).where("value >= 25")
    return v.select(*COORDS, (1 + F.floor(F.col("y") / 64) * 16 + F.floor(F.col("x") / 64)).cast("int").alias("label"))


def _vol(side: int) -> str:
    return f"vol AS (SELECT (l_linenumber - 1)::INT AS z, (l_suppkey % {side})::INT AS y, (l_partkey % {side})::INT AS x, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3)"


VOL, VOL_SMALL = "WITH RECURSIVE " + _vol(WIDE), "WITH RECURSIVE " + _vol(SMALL)
LAB = "lab AS (SELECT z, y, x, (1 + (y // 64) * 16 + x // 64)::INT AS label FROM vol WHERE value >= 25)"
CHANNELS = f"WITH vol AS (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS c, (l_linenumber - 1)::INT AS z, (l_suppkey % {WIDE})::INT AS y, (l_partkey % {WIDE})::INT AS x, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3, 4)"
SHAPE, SHAPE_SMALL = (DEPTH, WIDE, WIDE), (DEPTH, SMALL, SMALL)


# Selection and range access

@query(f"{CHANNELS} SELECT z, y, x, value FROM vol WHERE c = 2")
def channel_slice(spark, sf_dir):
    return volume(spark, sf_dir, channels=True).channel(-1)


@query(f"{CHANNELS} SELECT z - 1 AS z, y - 10 AS y, x - 20 AS x, value FROM vol WHERE c = 1 AND z >= 1 AND z < 4 AND y >= 10 AND y < 90 AND x >= 20 AND x < 2020")
def subvolume(spark, sf_dir):
    return volume(spark, sf_dir, channels=True).subvolume(1, 1, 10, 20, 3, 80, 2000)


@query(f"{VOL}, {LAB} SELECT DISTINCT label FROM lab")
def object_ids(spark, sf_dir):
    return measure.object_ids(grid_labels(spark, sf_dir))


@query(f"{VOL}, {LAB} SELECT z, y, x FROM lab WHERE label = 5")
def object_pixel_indices(spark, sf_dir):
    return measure.object_pixel_indices(grid_labels(spark, sf_dir), 5)


@query(f"{VOL_SMALL} SELECT g.z::INT AS z, h.y::INT AS y, i.x::INT AS x FROM range({DEPTH}) g(z), range({SMALL}) h(y), range({SMALL}) i(x) WHERE NOT EXISTS (SELECT 1 FROM vol WHERE vol.z = g.z AND vol.y = h.y AND vol.x = i.x AND value >= 25)")
def background_pixel_indices(spark, sf_dir):
    labels = voxels(spark, sf_dir, SMALL).where("value >= 25").select(*COORDS, F.lit(1).alias("label"))
    return measure.object_pixel_indices(labels, 0, SHAPE_SMALL)


@query(f"{VOL}, {LAB} SELECT z, y, x, value FROM lab JOIN vol USING (z, y, x) WHERE label = 6")
def object_intensity_values(spark, sf_dir):
    return measure.object_intensity_values(grid_labels(spark, sf_dir), voxels(spark, sf_dir), 6, SHAPE, SHAPE)


# Thresholds and gates

@query(f"{VOL} SELECT z, y, x, value >= 30 AS mask FROM vol")
def threshold_fixed(spark, sf_dir):
    return segment.threshold_mask(voxels(spark, sf_dir), value=30)


@query(f"{VOL} SELECT z, y, x, value >= (SELECT quantile_cont(value, 0.9) FROM vol) AS mask FROM vol")
def threshold_percentile(spark, sf_dir):
    return segment.threshold_mask(voxels(spark, sf_dir), method="percentile", percentile=90)


@query(f"""{VOL}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM vol),
h AS (SELECT least(255, floor((value - lo) / (hi - lo) * 256)) AS bin, count(*)::DOUBLE AS n FROM vol, e GROUP BY 1),
k AS (SELECT lo + (bin + 0.5) * ((hi - lo) / 256) AS ctr, n FROM h, e),
w AS (SELECT ctr, sum(n) OVER (ORDER BY ctr) AS w1, sum(n * ctr) OVER (ORDER BY ctr) AS s1, sum(n) OVER () AS wt, sum(n * ctr) OVER () AS st FROM k),
t AS (SELECT ctr FROM w WHERE wt > w1 ORDER BY w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) ** 2 DESC, ctr LIMIT 1)
SELECT z, y, x, value >= (SELECT ctr FROM t) AS mask FROM vol""")
def threshold_otsu(spark, sf_dir):
    return segment.threshold_mask(voxels(spark, sf_dir), method="otsu")


POLYGON = [(2.0, 950.0), (30.0, 1000.0), (48.0, 1700.0), (20.0, 1300.0), (10.0, 1900.0)]


def _crossing(x: str, y: str) -> str:
    pairs = zip(POLYGON, POLYGON[1:] + POLYGON[:1])
    return " + ".join(f"(CASE WHEN ({yi} > {y}) <> ({yj} > {y}) AND {x} < {(xj - xi) / (yj - yi)!r}::DOUBLE * ({y} - {yi}) + {xi} THEN 1 ELSE 0 END)" for (xi, yi), (xj, yj) in pairs if yi != yj)


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1500")
def rectangle_gate(spark, sf_dir):
    return table(spark, sf_dir, "part").where(gates.rectangle_gate(F.col("p_size"), F.col("p_retailprice"), x_min=10, x_max=20, y_min=950, y_max=1500)).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE ({_crossing('p_size', 'p_retailprice')}) % 2 = 1")
def polygon_gate(spark, sf_dir):
    return table(spark, sf_dir, "part").where(gates.polygon_gate(F.col("p_size"), F.col("p_retailprice"), POLYGON)).select("p_partkey")


@query(f"SELECT p_partkey, (({_crossing('p_size', 'p_retailprice')}) % 2 = 1 AND NOT (p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1500)) OR p_size BETWEEN 1 AND 2 AS gated FROM part")
def gate_algebra(spark, sf_dir):
    x, y = F.col("p_size"), F.col("p_retailprice")
    inside, box = gates.polygon_gate(x, y, POLYGON), gates.rectangle_gate(x, y, x_min=10, x_max=20, y_min=950, y_max=1500)
    return table(spark, sf_dir, "part").select("p_partkey", ((inside & ~box) | gates.rectangle_gate(x, y, x_min=1, x_max=2, y_min=0, y_max=1e9)).alias("gated"))


# Segmentation

def _components(connectivity: int, side: int = WIDE) -> str:
    steps = [f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= connectivity]
    return f"""WITH RECURSIVE {_vol(side)}, fg AS MATERIALIZED (SELECT z, y, x, (z * {side} + y) * {side} + x AS id, value FROM vol WHERE value >= 10),
o(dz, dy, dx) AS (VALUES {', '.join(steps)}),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM fg a, o JOIN fg b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
reach AS (SELECT id AS src, id AS dst FROM fg UNION SELECT reach.src, e.b FROM reach JOIN e ON reach.dst = e.a),
root AS (SELECT src, min(dst) AS r FROM reach GROUP BY 1),
comp AS (SELECT fg.z, fg.y, fg.x, fg.value, dense_rank() OVER (ORDER BY r)::INT AS label FROM fg JOIN root ON fg.id = root.src)"""


def _bright(spark, sf_dir) -> DataFrame:
    return segment.threshold_mask(voxels(spark, sf_dir), value=10)


@query(_components(1) + " SELECT z, y, x, label FROM comp")
def label_components_face(spark, sf_dir):
    return segment.label_components(_bright(spark, sf_dir), SHAPE)


@query(_components(3) + " SELECT z, y, x, label FROM comp")
def label_components_full(spark, sf_dir):
    return segment.label_components(_bright(spark, sf_dir), SHAPE, connectivity=3)


@query(f"{VOL}, {LAB}, s AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), k AS (SELECT label, dense_rank() OVER (ORDER BY label)::INT AS new FROM s WHERE n BETWEEN 300 AND 1500) SELECT z, y, x, new AS label FROM lab JOIN k USING (label)")
def filter_by_size(spark, sf_dir):
    return segment.filter_by_size(grid_labels(spark, sf_dir), min_size=300, max_size=1500)


POINT_LABELS = f"""WITH p AS (SELECT s_suppkey AS id, (s_nationkey % 7)::DOUBLE AS z, (s_suppkey * 37 % 1024)::DOUBLE AS y, (s_suppkey * 101 % 1024) + 0.5 AS x FROM supplier),
g AS (SELECT id, floor(p.z)::INT + a.d AS z, floor(p.y)::INT + b.d AS y, floor(p.x)::INT + c.d AS x, p.z AS pz, p.y AS py, p.x AS px FROM p, range(-3, 5) a(d), range(-3, 5) b(d), range(-3, 5) c(d))
SELECT z::INT AS z, y::INT AS y, x::INT AS x, max(id)::INT AS label FROM g WHERE z BETWEEN 0 AND 6 AND y BETWEEN 0 AND 1023 AND x BETWEEN 0 AND 1023 AND (z - pz) ** 2 + (y - py) ** 2 + (x - px) ** 2 <= 6.25 GROUP BY 1, 2, 3"""


@query(POINT_LABELS)
def labels_from_points(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_nationkey") % 7).alias("z"), (F.col("s_suppkey") * 37 % 1024).alias("y"), (F.col("s_suppkey") * 101 % 1024 + 0.5).alias("x"))
    return segment.labels_from_points(points, SHAPE, radius=2.5)


@query(POINT_LABELS)
def labels_by_table_function(spark, sf_dir):
    """The same labels from SQL: each point with the voxels of its ball, of which the largest id wins."""
    with_points = MeasurementStore(spark)
    with_points.register("points", table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS point_id", "s_nationkey % 7 AS z", "s_suppkey * 37 % 1024 AS y", "s_suppkey * 101 % 1024 + 0.5D AS x"))
    return with_points.query(f"SELECT b.z, b.y, b.x, CAST(max(point_id) AS INT) AS label FROM points p, LATERAL ball(p.z, p.y, p.x, 2.5D, {', '.join(map(str, SHAPE))}) b GROUP BY b.z, b.y, b.x")


@query()
def watershed_split(spark, sf_dir):
    mask = segment.threshold_mask(voxels(spark, sf_dir, SMALL), value=20)
    return segment.watershed_split(None, mask, SHAPE_SMALL, min_distance=2)


DISTANCES = f"""d0 AS (SELECT g.z::INT AS z, h.y::INT AS y, i.x::INT AS x, CASE WHEN value >= 20 THEN NULL ELSE 0 END AS d FROM range({DEPTH}) g(z) CROSS JOIN range({SMALL}) h(y) CROSS JOIN range({SMALL}) i(x) LEFT JOIN vol ON vol.z = g.z AND vol.y = h.y AND vol.x = i.x),
d1 AS MATERIALIZED (SELECT z, y, p.x::INT AS x, min(d + (d0.x - p.x) ** 2) AS d FROM d0, range({SMALL}) p(x) WHERE d IS NOT NULL GROUP BY 1, 2, 3),
d2 AS MATERIALIZED (SELECT z, p.y::INT AS y, x, min(d + (d1.y - p.y) ** 2) AS d FROM d1, range({SMALL}) p(y) GROUP BY 1, 2, 3),
d3 AS (SELECT p.z::INT AS z, y, x, min(d + (d2.z - p.z) ** 2) AS d FROM d2, range({DEPTH}) p(z) GROUP BY 1, 2, 3)"""


@query(f"{VOL_SMALL}, {DISTANCES} SELECT z, y, x, d::DOUBLE AS d2 FROM d3 WHERE d > 0")
def distance_transform(spark, sf_dir):
    return segment.distance_squared(segment.threshold_mask(voxels(spark, sf_dir, SMALL), value=20), SHAPE_SMALL)


@query(f"""{VOL_SMALL}, {DISTANCES},
v AS MATERIALIZED (SELECT z, y, x, (z * {SMALL} + y) * {SMALL} + x AS r, d FROM d3 WHERE d > 0),
m AS (SELECT max({{'d': d, 'r': -r}}).r AS neg, (1 + y // 16 * 8 + x // 16)::INT AS marker FROM v GROUP BY y // 16, x // 16),
half AS (SELECT a.r AS u, b.r AS w, least(a.d, b.d) AS lo, greatest(a.d, b.d) AS hi, -(a.r * 3 + o.axis) AS t
  FROM v a, (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) o(axis, dz, dy, dx) JOIN v b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
e AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT w, u, lo, hi, t FROM half),
s AS (SELECT 0 AS k, r, coalesce(-marker, r)::BIGINT AS c FROM v LEFT JOIN m ON neg = -r
  UNION ALL
  (WITH h AS (SELECT a.c, max({{'lo': lo, 'hi': hi, 't': t, 'c': b.c}}).c AS to FROM e JOIN s a ON a.r = u JOIN s b ON b.r = w WHERE a.c <> b.c AND a.c >= 0 GROUP BY 1),
   n AS (SELECT h.c, CASE WHEN g.to = h.c THEN least(h.c, h.to) ELSE h.to END AS to FROM h LEFT JOIN h g ON g.c = h.to)
   SELECT k + 1, r, coalesce(n.to, s.c) FROM s LEFT JOIN n ON n.c = s.c WHERE (SELECT count(*) FROM h) > 0))
SELECT z, y, x, (-c)::INT AS label FROM s JOIN v USING (r) WHERE k = (SELECT max(k) FROM s) AND c < 0""")
def marker_flood(spark, sf_dir):
    """The distance map flooded from its highest voxel in each square of 16."""
    dist = segment.distance_squared(segment.threshold_mask(voxels(spark, sf_dir, SMALL), value=20), SHAPE_SMALL)
    raster = ((F.col("z") * SMALL + F.col("y")) * SMALL + F.col("x")).cast("long")
    best = dist.groupBy(F.floor(F.col("y") / 16).alias("j"), F.floor(F.col("x") / 16).alias("i")).agg(F.max(F.struct("d2", (-raster).alias("neg"), "z", "y", "x")).alias("m"))
    return flood.flood(dist, best.select("m.z", "m.y", "m.x", (1 + F.col("j") * 8 + F.col("i")).cast("int").alias("marker")), SHAPE_SMALL)


class _Bright:
    """Stands in for a segmentation model: labels what is above the tile's mean."""

    def eval(self, x, **options):
        plane = x[..., 0]
        return (plane > plane.mean()).astype("int32"), None, None


@query(f"""{VOL}, t AS (SELECT concat(y // 256, ':', x // 256) AS tile, z, y, x, value FROM vol),
m AS (SELECT tile, sum(value) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS mean FROM t GROUP BY 1)
SELECT tile, z, y, x, 1::INT AS label FROM t JOIN m USING (tile) WHERE value > mean""")
def model_segmentation(spark, sf_dir):
    tiles = voxels(spark, sf_dir).withColumn("tile", F.concat_ws(":", F.floor(F.col("y") / 256), F.floor(F.col("x") / 256)))
    return segment.apply_model(tiles, _Bright(), "tile string, z int, y int, x int, label int", do_3d=True)


# Filters

def _gauss(axis: str, n: int, source: str, sigma: float) -> str:
    w = filters.gaussian_weights(sigma)
    r = len(w) // 2
    rest = ", ".join(c for c in COORDS if c != axis)
    values = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in zip(range(-r, r + 1), w))
    return f"(SELECT {rest}, pos - k AS {axis}, sum(value * w) AS value FROM (SELECT {rest}, value, unnest([{axis}, -1 - {axis}, 2 * {n} - 1 - {axis}]) AS pos FROM {source}) s, (VALUES {values}) o(k, w) WHERE pos - k BETWEEN 0 AND {n - 1} GROUP BY {rest}, pos - k)"


@query(f"{VOL}, a AS {_gauss('z', DEPTH, 'vol', 0.5)}, b AS {_gauss('y', WIDE, 'a', 0.5)}, c AS {_gauss('x', WIDE, 'b', 0.5)} SELECT z::INT AS z, y::INT AS y, x::INT AS x, round(value, 6) AS value FROM c")
def gaussian_blur(spark, sf_dir):
    out = filters.gaussian_blur(voxels(spark, sf_dir), SHAPE, 0.5)
    return out.withColumn("value", F.round("value", 6))


GRID = f"grid AS MATERIALIZED (SELECT g.z::INT AS z, h.y::INT AS y, i.x::INT AS x, coalesce(value, 0) AS value FROM range({DEPTH}) g(z) CROSS JOIN range({SMALL}) h(y) CROSS JOIN range({SMALL}) i(x) LEFT JOIN vol ON vol.z = g.z AND vol.y = h.y AND vol.x = i.x)"


def _mirror(c: str, n: int) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN 2 * {n} - 1 - ({c}) ELSE {c} END)"


@query(f"""{VOL_SMALL}, {GRID}, n AS (SELECT grid.z, grid.y, grid.x, {_mirror('grid.z + a.d', DEPTH)} AS nz, {_mirror('grid.y + b.d', SMALL)} AS ny, {_mirror('grid.x + c.d', SMALL)} AS nx FROM grid, range(-1, 2) a(d), range(-1, 2) b(d), range(-1, 2) c(d)),
m AS (SELECT n.z, n.y, n.x, list_sort(list(g.value))[14] AS value FROM n JOIN grid g ON g.z = nz AND g.y = ny AND g.x = nx GROUP BY 1, 2, 3) SELECT z, y, x, value FROM m WHERE value > 0""")
def median_filter(spark, sf_dir):
    return filters.median_filter(voxels(spark, sf_dir, SMALL), SHAPE_SMALL, 1).where("value > 0")


@query(f"""{VOL_SMALL}, {GRID}, o AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx, 2 - sqrt(4 - (a.d * a.d + b.d * b.d + c.d * c.d)) AS h FROM range(-2, 3) a(d), range(-2, 3) b(d), range(-2, 3) c(d) WHERE a.d * a.d + b.d * b.d + c.d * c.d <= 4),
m AS MATERIALIZED (SELECT q.z - dz AS z, q.y - dy AS y, q.x - dx AS x, min(q.value + h) AS bg FROM grid q, o GROUP BY 1, 2, 3)
SELECT z, y, x, round(value - bg, 6) AS value FROM grid JOIN m USING (z, y, x) WHERE value - bg > 0""")
def subtract_background(spark, sf_dir):
    return filters.subtract_background(voxels(spark, sf_dir, SMALL), SHAPE_SMALL, radius=2).where("value > 0").withColumn("value", F.round("value", 6))


@query(f"{VOL} SELECT z, y, x, round((value - (SELECT min(value) FROM vol)) / (SELECT max(value) - min(value) FROM vol), 9) AS value FROM vol")
def normalize_contrast(spark, sf_dir):
    return filters.enhance_contrast(voxels(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _two_tiles(c: str, side: int, n: int) -> str:
    """The two tiles whose centres enclose a place, with the share of each."""
    at, low = f"(({c} + 0.5::DOUBLE) / {side} - 0.5::DOUBLE)", f"floor(({c} + 0.5::DOUBLE) / {side} - 0.5::DOUBLE)"
    return f"[{{'t': greatest({low}, 0)::INT, 'w': 1 - ({at} - {low})}}, {{'t': least({low} + 1, {n - 1})::INT, 'w': {at} - {low}}}]"


@query(f"""{VOL}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM vol),
r AS (SELECT z, y, x, least(255, floor((value - lo) / (hi - lo) * 256))::INT AS bin FROM vol, e),
h AS (SELECT z AS tz, y // {WIDE // 8} AS ty, x // {WIDE // 8} AS tx, bin, count(*) AS n FROM r GROUP BY 1, 2, 3, 4),
t AS (SELECT tz, ty, tx, sum(n)::DOUBLE AS every, greatest(1, ceil(0.01::DOUBLE * sum(n)::DOUBLE)) AS most FROM h GROUP BY 1, 2, 3),
f AS (SELECT tz, ty, tx, every, most, b.bin::INT AS bin, coalesce(n, 0)::DOUBLE AS n FROM t CROSS JOIN range(256) b(bin) LEFT JOIN h USING (tz, ty, tx, bin)),
s AS (SELECT *, sum(greatest(n - most, 0)) OVER (PARTITION BY tz, ty, tx) AS spare FROM f),
c AS MATERIALIZED (SELECT tz, ty, tx, bin, sum(least(n, most) + spare / 256) OVER (PARTITION BY tz, ty, tx ORDER BY bin) / every AS level FROM s),
o AS (SELECT z, y, x, bin, unnest({_two_tiles('y', WIDE // 8, 8)}) AS oy, {_two_tiles('x', WIDE // 8, 8)} AS xs FROM r), o2 AS (SELECT z, y, x, bin, oy, unnest(xs) AS ox FROM o)
SELECT z, y, x, round(sum(oy.w * ox.w * level), 6) AS value FROM o2 JOIN c ON tz = z AND ty = oy.t AND tx = ox.t AND c.bin = o2.bin WHERE oy.w * ox.w > 0 GROUP BY 1, 2, 3""")
def equalize_contrast(spark, sf_dir):
    return filters.enhance_contrast(voxels(spark, sf_dir), SHAPE, method="equalize").withColumn("value", F.round("value", 6))


# Measurements

STATS = "count(*) AS count, avg(value) AS mean, min(value) AS min, max(value) AS max, sum(value) AS sum, round(stddev_pop(value), 6) AS stddev, avg(value) FILTER (value >= hi - (hi - lo) / 4) AS threshold_mean"


@query(f"{VOL}, {LAB}, j AS (SELECT label AS object_id, value, min(value) OVER (PARTITION BY label) AS lo, max(value) OVER (PARTITION BY label) AS hi FROM lab JOIN vol USING (z, y, x)) SELECT object_id, {STATS} FROM j GROUP BY 1")
def extract_measurements(spark, sf_dir):
    return measure.extract_measurements(grid_labels(spark, sf_dir), voxels(spark, sf_dir), SHAPE, SHAPE).withColumn("stddev", F.round("stddev", 6))


@query(f"WITH j AS (SELECT user_id AS object_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events), m AS (SELECT object_id, {STATS} FROM j GROUP BY 1) SELECT object_id, count, round(mean, 9) AS mean, min, max, round(sum, 8) AS sum, stddev, round(threshold_mean, 9) AS threshold_mean FROM m")
def measure_events(spark, sf_dir):
    m = measure.measure(table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), "value"))
    return m.select("object_id", "count", F.round("mean", 9).alias("mean"), "min", "max", F.round("sum", 8).alias("sum"), F.round("stddev", 6).alias("stddev"), F.round("threshold_mean", 9).alias("threshold_mean"))


@query("WITH e AS (SELECT max(l_extendedprice) - (max(l_extendedprice) - min(l_extendedprice)) / 4 AS t, l_returnflag AS f FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(avg(l_extendedprice), 4) AS threshold_mean FROM lineitem JOIN e ON f = l_returnflag WHERE l_extendedprice >= t GROUP BY 1")
def threshold_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    return measure.threshold_mean(rows, "l_returnflag").withColumn("threshold_mean", F.round("threshold_mean", 4))


@query(f"{VOL}, {LAB}, c AS (SELECT p_partkey AS id, p_size AS class_id FROM part WHERE p_size > 10) SELECT z, y, x, coalesce(class_id, 0)::INT AS class_id FROM lab LEFT JOIN c ON label = id")
def class_map(spark, sf_dir):
    classes = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("object_id"), F.col("p_size").alias("class_id"))
    return classify.class_map(grid_labels(spark, sf_dir), classes)


FLAGSHIP = _components(1) + ", j AS (SELECT label AS object_id, value, min(value) OVER (PARTITION BY label) AS lo, max(value) OVER (PARTITION BY label) AS hi FROM comp) SELECT object_id, " + STATS + " FROM j GROUP BY 1"


@query(FLAGSHIP)
def bright_regions(spark, sf_dir):
    """Threshold, label and measure as a pipeline of steps."""
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Pipeline([
        Step("segmentation", "threshold_mask", {"value": 10}, {"volume": "volume"}, "mask"),
        Step("segmentation", "label_components", {}, {"mask": "mask", "shape": "shape"}, "labels"),
        Step("measurements", "extract_measurements", {}, {"labels": "labels", "intensity": "volume"}, "table"),
    ])
    return steps.run({"volume": voxels(spark, sf_dir), "shape": SHAPE})["table"].withColumn("stddev", F.round("stddev", 6))


# Validation

@query(f"{VOL} SELECT count(*) FILTER (value >= 20 AND x % 3 > 0) / count(*) AS iou FROM vol WHERE value >= 20 OR (x % 3 > 0 AND value >= 15)")
def iou(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return validate.segmentation_iou(v.where("value >= 20").select(*COORDS, F.lit(1).alias("label")), v.where("value >= 15 AND x % 3 > 0").select(*COORDS, F.lit(2).alias("label")))


@query("""WITH e AS (SELECT l_suppkey AS k, sum(l_quantity) AS q, count(*) AS n, avg(l_discount) AS d FROM lineitem GROUP BY 1), a AS (SELECT k, q + (k % 7 = 0)::INT * k AS q, n, d FROM e)
SELECT 'q' AS column, 'out_of_tolerance' AS status, max(abs(a.q - e.q))::DOUBLE AS max_abs, round(max(abs(a.q - e.q) / greatest(abs(e.q), 1e-6)), 9) AS max_rel, count(*) FILTER (abs(a.q - e.q) > 1e-6 + 1e-3 * abs(e.q)) AS n_failing FROM a JOIN e USING (k)
UNION ALL SELECT 'd', 'missing_in_actual', NULL, NULL, NULL""")
def feature_diff(spark, sf_dir):
    expected = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.avg("l_discount").alias("d"))
    actual = expected.select("k", (F.col("q") + F.when(F.col("k") % 7 == 0, F.col("k")).otherwise(0)).alias("q"), "n")
    return validate.feature_table_diff(actual, expected, key="k").withColumn("max_rel", F.round("max_rel", 9))


@query("""WITH p AS (SELECT label AS a, (vec_id % 7) AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT sum(n) AS n FROM p GROUP BY a), c AS (SELECT sum(n) AS n FROM p GROUP BY b),
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM p) AS i, (SELECT sum(n * (n - 1) / 2) FROM r) AS ra, (SELECT sum(n * (n - 1) / 2) FROM c) AS rb, (SELECT sum(n) FROM p) AS t)
SELECT round((i - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 9) AS ari FROM v""")
def ari(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("other"))
    return validate.cluster_assignment_ari(pairs, "label", "other").withColumn("ari", F.round("ari", 9))


# Clustering, reduction, classification

def features(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("features"))


def _fixed_centres(spark, sf_dir) -> list[list[float]]:
    """The mean of each label, of which there are ten; rounded, so that the order of the sums does not show."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    means = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("e"))
    return [r["e"] for r in means.orderBy("label").collect()]


NEAREST = """WITH m AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 9) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
c AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS k, list(x ORDER BY i) AS e FROM m GROUP BY label),
d AS (SELECT v.vec_id, k::INT AS k, (SELECT sum((v.embedding[i]::DOUBLE - c.e[i]) ** 2) FROM range(1, 65) t(i)) AS d2 FROM embeddings v, c),
n AS (SELECT vec_id AS object_id, arg_min(k, d2) AS cluster, min(d2) AS d2 FROM d GROUP BY 1)"""


@query(NEAREST + " SELECT object_id, cluster, round(d2, 6) AS d2 FROM n")
def nearest_centre(spark, sf_dir):
    return cluster.nearest_centre(features(spark, sf_dir), _fixed_centres(spark, sf_dir)).withColumn("d2", F.round("d2", 6))


@query(NEAREST + """, s AS (SELECT cluster, count(*)::DOUBLE AS m, sum(d2) AS ssd FROM n GROUP BY 1), t AS (SELECT sum(m) AS n, greatest(sum(ssd) / greatest(sum(m) - 10, 1), 1e-10) AS var FROM s)
SELECT round(sum(m * ln(m / n) - m * 64 / 2 * ln(2 * pi() * var) - (m - 1) / 2) - 10 * 65 / 2.0 * ln(any_value(n)), 4) AS bic FROM s, t""")
def kmeans_bic(spark, sf_dir):
    near = cluster.nearest_centre(features(spark, sf_dir), _fixed_centres(spark, sf_dir))
    return cluster.kmeans_bic(near, 64, 10).withColumn("bic", F.round("bic", 4))


@query()
def kmeans(spark, sf_dir):
    return cluster.kmeans(features(spark, sf_dir), 10, seed=0)


@query()
def gaussian_mixture(spark, sf_dir):
    return cluster.gaussian_mixture(features(spark, sf_dir), 5, seed=0, restarts=2)


def flagged(spark, sf_dir) -> DataFrame:
    """Every line of an order as a point in the plane; the three return flags lie apart, and A's cloud is wide, N's tilted."""
    flag = F.col("l_returnflag")
    x = F.col("l_quantity") / 10 + F.when(flag == "A", 0).when(flag == "N", 40).otherwise(20)
    y = F.col("l_discount") * 20 + F.when(flag == "A", F.col("l_tax") * 50).when(flag == "N", F.col("l_quantity") / 5).otherwise(60)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"), F.array(x.cast("double"), y.cast("double")).alias("features"))


def _named(found: DataFrame) -> DataFrame:
    """Labels in the order of the first row of each."""
    first = cut(found.groupBy("cluster").agg(F.min("object_id").alias("first")), "first")
    named = first.select("cluster", (F.row_number().over(Window.orderBy("first")) - 1).alias("name"))  # a row for each cluster
    return found.join(named, "cluster").select("object_id", F.col("name").cast("int").alias("cluster"))


FLAGGED = """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS object_id, l_returnflag AS flag FROM lineitem), n AS (SELECT flag, row_number() OVER (ORDER BY min(object_id)) - 1 AS name FROM f GROUP BY 1)
SELECT object_id, name::INT AS cluster FROM f JOIN n USING (flag)"""


@query(FLAGGED)
def mixture_of_flags(spark, sf_dir):
    """A mixture of three finds the return flags again."""
    return _named(cut(cluster.gaussian_mixture(flagged(spark, sf_dir), 3, seed=0), "mixture"))


@query(FLAGGED)
def auto_k_of_flags(spark, sf_dir):
    """The criterion chooses three clusters among one to three, and k-means finds the flags."""
    return _named(cut(cluster.auto_k_kmeans(flagged(spark, sf_dir), k_min=1, k_max=3, seed=0)[0], "clusters"))


@query()
def auto_k_kmeans(spark, sf_dir):
    return cluster.auto_k_kmeans(features(spark, sf_dir), k_min=2, k_max=4, seed=0)[0]


@query("""SELECT a.vec_id AS object_id, b.vec_id AS neighbour, rank::INT AS rank, round(sqrt(d), 6) AS distance FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, least(a.vec_id, b.vec_id), greatest(a.vec_id, b.vec_id)) AS rank
  FROM (SELECT a, b, (SELECT sum((a.embedding[i]::DOUBLE - b.embedding[i]) ** 2) FROM range(1, 65) t(i)) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 8""")
def knn_graph(spark, sf_dir):
    return neighbours.knn_graph(features(spark, sf_dir), 8).withColumn("distance", F.round("distance", 6))


def _merged(height: str, clusters: int = 10) -> str:
    """Agglomeration from the points' distances, one merge a step; a cluster is named by its first row."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, (SELECT sum((a.embedding[k]::DOUBLE - b.embedding[k]) ** 2) FROM range(1, 65) t(k)) AS d FROM embeddings a, embeddings b),
s AS (SELECT 0 AS n, vec_id AS v, vec_id AS c FROM embeddings
  UNION ALL
  (WITH size AS (SELECT c, count(*)::DOUBLE AS m FROM s GROUP BY 1),
   g AS MATERIALIZED (SELECT x.c AS a, y.c AS b, min(d) AS near, max(d) AS far, sum(d) AS total FROM p JOIN s x ON x.v = i JOIN s y ON y.v = j GROUP BY 1, 2),
   h AS (SELECT min({{'d': {height}, 'a': g.a, 'b': g.b}}) AS m FROM g JOIN size sa ON sa.c = g.a JOIN size sb ON sb.c = g.b JOIN g ga ON ga.a = g.a AND ga.b = g.a JOIN g gb ON gb.a = g.b AND gb.b = g.b WHERE g.a < g.b)
   SELECT n + 1, v, CASE WHEN c = h.m.b THEN h.m.a ELSE c END FROM s, h WHERE (SELECT count(*) FROM size) > {clusters}))
SELECT v AS object_id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS cluster FROM s WHERE n = (SELECT max(n) FROM s)"""


#: Distance of two clusters by linkage, from the distances of their points.
HEIGHTS = {"ward": "sa.m * sb.m / (sa.m + sb.m) * (g.total / (sa.m * sb.m) - ga.total / (2 * sa.m * sa.m) - gb.total / (2 * sb.m * sb.m))", "single": "g.near", "complete": "g.far"}


@query(_merged(HEIGHTS["ward"]))
def hierarchical_ward(spark, sf_dir):
    return cluster.hierarchical(features(spark, sf_dir), 10)


@query(_merged(HEIGHTS["single"]))
def hierarchical_single(spark, sf_dir):
    return cluster.hierarchical(features(spark, sf_dir), 10, linkage="single")


@query(_merged(HEIGHTS["complete"]))
def hierarchical_complete(spark, sf_dir):
    return cluster.hierarchical(features(spark, sf_dir), 10, linkage="complete")


@query()
def pca(spark, sf_dir):
    return reduce.pca(features(spark, sf_dir), 3)


@query("""WITH s AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b, covar_samp(l_quantity, l_extendedprice / 1000) AS c FROM lineitem)
SELECT 1 AS component, round(((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)) / (a + b), 7) AS explained FROM s UNION ALL SELECT 2, 1.0""")
def explained_variance_2d(spark, sf_dir):
    two = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("object_id"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000).alias("features"))
    return spark.createDataFrame([(k + 1, round(v, 7)) for k, v in enumerate(reduce.pca_explained_variance(two, 2))], "component int, explained double")


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS object_id, l_quantity::DOUBLE AS a, l_extendedprice / 1000 AS b FROM lineitem),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM v),
e AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) - vb AS p FROM s), u AS (SELECT *, p / sqrt(p * p + c * c) AS x, c / sqrt(p * p + c * c) AS y FROM e)
SELECT object_id, round((a - ma) * x + (b - mb) * y, 4) AS c0, round(((b - mb) * x - (a - ma) * y) * (CASE WHEN abs(x) >= abs(y) THEN 1 ELSE -1 END), 4) AS c1 FROM v, u""")
def pca_plane(spark, sf_dir):
    two = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000).alias("features"))
    out = reduce.pca(two, 2)
    return out.select("object_id", F.round("c0", 4).alias("c0"), F.round("c1", 4).alias("c1"))


@query()
def isomap(spark, sf_dir):
    return reduce.isomap(features(spark, sf_dir), 2)


GEODESICS = """WITH RECURSIVE near AS MATERIALIZED (SELECT u, v, d FROM (SELECT a.vec_id AS u, b.vec_id AS v, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, least(a.vec_id, b.vec_id), greatest(a.vec_id, b.vec_id)) AS rank
  FROM (SELECT a, b, (SELECT sum((a.embedding[i]::DOUBLE - b.embedding[i]) ** 2) FROM range(1, 65) t(i)) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5),
e AS MATERIALIZED (SELECT u, v, min(sqrt(d)) AS d FROM (SELECT u, v, d FROM near UNION ALL SELECT v, u, d FROM near) GROUP BY 1, 2),
s AS (SELECT 0 AS n, vec_id AS node, vec_id AS source, 0::DOUBLE AS d FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL
  (WITH c AS (SELECT e.v AS node, source, min(s.d + e.d) AS d FROM s JOIN e ON e.u = s.node GROUP BY 1, 2), m AS (SELECT node, source, min(d) AS d FROM (SELECT node, source, d FROM s UNION ALL SELECT * FROM c) GROUP BY 1, 2)
   SELECT (SELECT max(n) FROM s) + 1, m.* FROM m WHERE EXISTS (SELECT 1 FROM c LEFT JOIN s USING (node, source) WHERE s.d IS NULL OR c.d < s.d - 1e-12)))
SELECT node AS object_id, source, round(d, 6) AS distance FROM s WHERE n = (SELECT max(n) FROM s)"""


@query(GEODESICS)
def geodesic_distances(spark, sf_dir):
    """Shortest paths along the graph of five neighbours, from every fiftieth row."""
    points = features(spark, sf_dir).select(F.col("object_id").alias("node"), F.lit(1.0).alias("w"), F.transform("features", lambda x: x.cast("double")).alias("features"))
    edges = cut(reduce.neighbour_edges(points, 5), "edges")
    found = reduce.geodesics(edges, points.where("node % 50 = 0").select("node"))
    return found.select(F.col("node").alias("object_id"), "source", F.round("d", 6).alias("distance"))


@query()
def laplacian_eigenmap(spark, sf_dir):
    return reduce.laplacian_eigenmap(features(spark, sf_dir), 2)


TSNE_AFFINITIES = """WITH RECURSIVE near AS MATERIALIZED (SELECT u, list(v ORDER BY d, v) AS vs, list(d - least_d ORDER BY d, v) AS ds FROM (SELECT a.vec_id AS u, b.vec_id AS v, d, min(d) OVER (PARTITION BY a.vec_id) AS least_d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, least(a.vec_id, b.vec_id), greatest(a.vec_id, b.vec_id)) AS rank
  FROM (SELECT a, b, (SELECT sum((a.embedding[i]::DOUBLE - b.embedding[i]) ** 2) FROM range(1, 65) t(i)) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 30 GROUP BY 1),
s AS (SELECT u, 0 AS n, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS beta FROM near
  UNION ALL
  SELECT u, n + 1, CASE WHEN wide THEN beta ELSE low END, CASE WHEN wide THEN high ELSE beta END, CASE WHEN wide AND isinf(high) THEN beta * 2 WHEN wide THEN (beta + high) / 2 ELSE (low + beta) / 2 END
  FROM (SELECT s.*, ln(list_sum(list_transform(ds, lambda x: exp(-x * beta)))) + beta * list_sum(list_transform(ds, lambda x: x * exp(-x * beta))) / list_sum(list_transform(ds, lambda x: exp(-x * beta))) > ln(10) AS wide FROM s JOIN near USING (u) WHERE n < 60)),
p AS (SELECT u, unnest(vs) AS v, unnest(list_transform(ds, lambda x: exp(-x * beta) / list_sum(list_transform(ds, lambda z: exp(-z * beta))))) AS p FROM s JOIN near USING (u) WHERE n = 60)
SELECT u AS object_id, v AS other, round(sum(p) / 2, 6) AS share FROM (SELECT u, v, p FROM p UNION ALL SELECT v, u, p FROM p) GROUP BY 1, 2"""


@query(TSNE_AFFINITIES)
def tsne_affinities(spark, sf_dir):
    """Shares of the neighbours at a perplexity of 10, whose attraction makes the layout; times the number of rows."""
    points = features(spark, sf_dir).select(F.col("object_id").alias("node"), F.lit(1.0).alias("w"), F.transform("features", lambda x: x.cast("double")).alias("features"))
    n = points.count()
    return tsne_.affinities(points, 10.0, n).select(F.col("u").alias("object_id"), F.col("v").alias("other"), F.round(F.col("p") * n, 6).alias("share"))


@query()
def tsne(spark, sf_dir):
    return reduce.tsne(features(spark, sf_dir), 2, seed=0)


def _spread(spark, sf_dir, labelled: DataFrame) -> DataFrame:
    """(n, clusters, misplaced) of k-means labels: rows nearer to another cluster's mean, by more than a thousandth."""
    rows = features(spark, sf_dir).join(labelled, "object_id")
    cells = rows.select("cluster", F.posexplode("features").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    means = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("e"))
    means = [r["e"] for r in means.orderBy("cluster").collect()]  # ten rows
    near = cluster.nearest_centre(features(spark, sf_dir), means).withColumnRenamed("cluster", "near")
    place = F.element_at(F.array(*[F.array(*map(F.lit, e)) for e in means]), F.col("cluster") + 1)
    own = F.aggregate(F.zip_with("features", place, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(near, "object_id").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(own > F.col("d2") * 1.001).alias("misplaced"))


@query("SELECT count(*) AS n, 10 AS clusters, 0 AS misplaced FROM embeddings")
def kmeans_fixed_point(spark, sf_dir):
    """Whether k-means has ended where each row lies with the nearest mean."""
    return _spread(spark, sf_dir, cluster.kmeans(features(spark, sf_dir), 10, seed=0))


HIERARCHIES = " UNION ALL ".join(f"SELECT '{name}' AS method, sum(m)::BIGINT AS n, count(*)::INT AS clusters, max(m) AS largest, sum(m * (m - 1) // 2)::BIGINT AS pairs FROM (SELECT cluster, count(*) AS m FROM ({_merged(h)}) GROUP BY 1)" for name, h in HEIGHTS.items())


@query(HIERARCHIES)
def hierarchies(spark, sf_dir):
    """Rows, clusters, the largest cluster and the pairs of rows in one cluster, of each linkage."""
    sizes = [cluster.hierarchical(features(spark, sf_dir), 10, linkage=k).groupBy("cluster").agg(F.count("*").alias("m"))
             .agg(F.lit(k).alias("method"), F.sum("m").alias("n"), F.count("*").cast("int").alias("clusters"), F.max("m").alias("largest"), F.sum(F.expr("m * (m - 1) div 2")).alias("pairs")) for k in HEIGHTS]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("SELECT m.name AS method, axis::INT AS axis, (SELECT count(*) FROM embeddings) AS n, m.fit::DOUBLE AS fit FROM (VALUES ('isomap', -1), ('laplacian', 1)) m(name, fit), range(2) t(axis)")
def manifolds(spark, sf_dir):
    """How each axis lies with its image under the method's own matrix, as a correlation.

    An axis of classical scaling is an eigenvector of the centred squared geodesic
    distances, so it runs against its product with them; one of the Laplacian map
    equals the mean of its graph's neighbours but for a factor.
    """
    rows = features(spark, sf_dir)
    points = rows.select(F.col("object_id").alias("node"), F.lit(1.0).alias("w"), F.transform("features", lambda x: x.cast("double")).alias("features"))
    edges = cut(reduce.neighbour_edges(points, 5), "edges")
    out = []
    for name, found in (("isomap", reduce.isomap(rows, 2)), ("laplacian", reduce.laplacian_eigenmap(rows, 2))):
        found = cut(found, "embedded")
        ends = found.select(F.col("object_id").alias("node"), F.col("c0").alias("x0"), F.col("c1").alias("x1"))
        if name == "isomap":
            image = reduce.squared_paths_times(edges, ends, ["x0", "x1"], points)
        else:
            image = edges.join(ends, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.avg("x0").alias("x0"), F.avg("x1").alias("x1"))
        image = cut(image.withColumnRenamed("node", "object_id"), "image")
        both = found.join(image, "object_id", "left").agg(F.count("*").alias("n"), *[F.corr(f"c{i}", f"x{i}").alias(f"f{i}") for i in range(2)])
        out += [both.select(F.lit(name).alias("method"), F.lit(i).alias("axis"), "n", F.round(f"f{i}", 4).alias("fit")) for i in range(2)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: Weights of the network that SQL can repeat: entry i of layer k.
WEIGHT = "(0.1 * sin(1.7 * ({i}) + {k}))"
#: The network's output in SQL: its two convolutions over the voxels that are not 0, pooling, mean and linear layer.
NETWORK = f"""{VOL}, {LAB}, ce AS (SELECT label, round(avg(z))::INT AS oz, round(avg(y))::INT AS oy, round(avg(x))::INT AS ox FROM lab GROUP BY 1),
k AS (SELECT i, j, l, (i * 9 + j * 3 + l) AS k FROM range(3) a(i), range(3) b(j), range(3) c(l)),
crop AS (SELECT label, z - oz + 4 AS d, y - oy + 4 AS h, x - ox + 4 AS w, value AS v FROM ce JOIN vol ON z BETWEEN oz - 4 AND oz + 3 AND y BETWEEN oy - 4 AND oy + 3 AND x BETWEEN ox - 4 AND ox + 3 WHERE value <> 0),
s1 AS (SELECT label, o, d - i + 1 AS d, h - j + 1 AS h, w - l + 1 AS w, sum(v * {WEIGHT.format(i="o * 27 + k", k=0)}) AS s FROM crop, k, range(8) t(o) GROUP BY ALL),
a1 AS (SELECT label, o, d, h, w, greatest(0, {WEIGHT.format(i="o", k=1)} + coalesce(s, 0)) AS a FROM (SELECT label, o, d, h, w FROM ce, range(8) t(o), range(8) b(d), range(8) c(h), range(8) e(w)) LEFT JOIN s1 USING (label, o, d, h, w)),
pooled AS (SELECT label, o AS c, d // 2 AS d, h // 2 AS h, w // 2 AS w, max(a) AS a FROM a1 GROUP BY ALL),
s2 AS (SELECT label, o, d - i + 1 AS d, h - j + 1 AS h, w - l + 1 AS w, sum(a * {WEIGHT.format(i="o * 216 + c * 27 + k", k=2)}) AS s FROM pooled, k, range(16) t(o) WHERE d - i + 1 BETWEEN 0 AND 3 AND h - j + 1 BETWEEN 0 AND 3 AND w - l + 1 BETWEEN 0 AND 3 GROUP BY ALL),
mean AS (SELECT label, o, avg(greatest(0, s + {WEIGHT.format(i="o", k=3)})) AS m FROM s2 GROUP BY 1, 2)
SELECT label::BIGINT AS object_id, c::INT AS class_id, round(sum(m * {WEIGHT.format(i="c * 16 + o", k=4)}) + {WEIGHT.format(i="c", k=5)}, 5) AS output FROM mean, range(2) t(c) GROUP BY 1, 2, c"""


def _stated_network(spark, sf_dir):
    """The network of stated weights and a crop around each object."""
    model = classify.Cell3DClassifier(2)
    model.weights = [(0.1 * np.sin(1.7 * np.arange(w.size) + k)).reshape(w.shape) for k, w in enumerate(model.weights)]
    return model, classify.crops_around(grid_labels(spark, sf_dir), voxels(spark, sf_dir), 8)


@query(NETWORK)
def network_outputs(spark, sf_dir):
    """What the network of stated weights puts out for each object's crop."""
    return classify.outputs(*_stated_network(spark, sf_dir)).select("object_id", F.posexplode("outputs").alias("class_id", "output")).withColumn("output", F.round("output", 5))


@query(f"SELECT object_id, arg_max(class_id, output) AS class_id FROM ({NETWORK}) GROUP BY 1")
def predicted_objects(spark, sf_dir):
    """The class that the network of stated weights gives each object."""
    return classify.predict(*_stated_network(spark, sf_dir))


@query()
def train_and_predict(spark, sf_dir):
    """Crops around labelled squares, classed by their size, learned and predicted."""
    labels, v = grid_labels(spark, sf_dir), voxels(spark, sf_dir)
    sizes = labels.groupBy("label").agg((F.count("*") > 300).cast("long").alias("class_id"))
    crops = classify.crops_around(labels, v, 8).join(sizes, F.col("object_id") == F.col("label")).drop("label")
    model = classify.Cell3DClassifier(2)
    classify.train_classifier(model, crops, epochs=3, lr=1e-2)
    return classify.predict(model, crops)


# Sources and sinks

@query(f"{VOL_SMALL} SELECT 0 AS c, z, y, x, value FROM vol")
def zarr_round_trip(spark, sf_dir):
    v = volume(spark, sf_dir, SMALL).with_values(volume(spark, sf_dir, SMALL).df, "float32")
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}.zarr"
    write_zarr(v, path, (1, 4, 32, 64))
    return open_volume(spark, path).df


@query(f"{VOL_SMALL} SELECT 0 AS c, z, y, x, value FROM vol")
def tiff_round_trip(spark, sf_dir):
    v = volume(spark, sf_dir, SMALL).with_values(volume(spark, sf_dir, SMALL).df, "uint16")
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}.tif"
    write_tiff(v, path)
    return open_volume(spark, path).df


@query(f"{VOL_SMALL} SELECT 0 AS c, z, y, x, value FROM vol")
def tiff_stack_round_trip(spark, sf_dir):
    v = volume(spark, sf_dir, SMALL).with_values(volume(spark, sf_dir, SMALL).df, "uint16")
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}.tif"
    write_tiff(v, path, stack=True)
    return open_volume(spark, path).df


@query(f"{VOL_SMALL} SELECT 0 AS c, z, y, x, value FROM vol WHERE z BETWEEN 2 AND 4 AND y >= 20 AND x < 60")
def zarr_pushed_ranges(spark, sf_dir):
    """Filters on the axes choose the chunks that the scan opens."""
    v = volume(spark, sf_dir, SMALL).with_values(volume(spark, sf_dir, SMALL).df, "float32")
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}.zarr"
    write_zarr(v, path, (1, 2, 16, 16))
    return open_volume(spark, path).df.where("z BETWEEN 2 AND 4 AND y >= 20 AND x < 60")


@query(f"{CHANNELS} SELECT z - 1 AS z, y - 10 AS y, x - 50 AS x, value FROM vol WHERE c = 1 AND z >= 1 AND z < 5 AND y >= 10 AND y < 90 AND x >= 50 AND x < 300")
def block_subvolume(spark, sf_dir):
    """A box read from a table of blocks, whose statistics leave out the others."""
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    write_blocks(volume(spark, sf_dir, channels=True), path, (4, 64, 64))
    return open_volume(spark, path).subvolume(1, 1, 10, 50, 4, 80, 250)


# SQL over measurement tables

def _store(spark, sf_dir) -> MeasurementStore:
    store = MeasurementStore(spark)
    store.register("objects", table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("object_id")).agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("event_type").alias("kind")))
    store.register("clusters", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), (F.col("c_custkey") % 3).alias("cluster"), F.col("c_nationkey").alias("nation")))
    return store


@query("""SELECT o_orderkey, o.o_orderdate AS day, e.event_id, e.value FROM (SELECT o_orderkey, o_custkey % 150 AS who, o_orderdate FROM orders) o
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2) e ON o.who = e.user_id AND o.o_orderdate >= e.ts""")
def asof_join(spark, sf_dir):
    """Each order with the last event of its user before it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderdate").alias("day"))
    last = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return joins.asof_join(orders, last, on="user_id", left_time="day", right_time="ts").select("o_orderkey", "day", "event_id", "value")


OBJECTS = "WITH objects AS (SELECT user_id AS object_id, count(*) AS n, max(value) AS top, min(event_type) AS kind FROM events GROUP BY 1), clusters AS (SELECT c_custkey AS object_id, c_custkey % 3 AS cluster, c_nationkey AS nation FROM customer) "
@query("SELECT event_id, s_suppkey, value FROM events JOIN supplier ON value >= s_acctbal / 40 AND value < s_acctbal / 40 + s_nationkey / 4.0")
def range_join(spark, sf_dir):
    """Events whose value lies in a supplier's range; ranges of length 0 match nothing."""
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 40).alias("low"), (F.col("s_acctbal") / 40 + F.col("s_nationkey") / 4.0).alias("high"))
    return joins.range_join(table(spark, sf_dir, "events").select("event_id", "value"), ranges, at="value", low="low", high="high").select("event_id", "s_suppkey", "value")


STORE_SQL = {
    "store_select": "SELECT object_id, n, top FROM objects WHERE top > 100 ORDER BY object_id",
    "store_filter_count": "SELECT kind, COUNT(*) AS many FROM objects WHERE n > 50 GROUP BY kind",
    "store_join": "SELECT o.object_id, o.n, c.cluster FROM objects o JOIN clusters c ON o.object_id = c.object_id ORDER BY o.object_id",
    "store_left_join": "SELECT c.object_id, coalesce(o.n, 0) AS n FROM clusters c LEFT JOIN objects o ON o.object_id = c.object_id",
    "store_window": "SELECT object_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY object_id) AS place, lag(nation) OVER (PARTITION BY cluster ORDER BY object_id) AS previous FROM clusters",
    "store_setops": "SELECT object_id FROM clusters INTERSECT SELECT object_id FROM objects EXCEPT SELECT object_id FROM clusters WHERE cluster = 0",
    "store_cube": "SELECT cluster, nation, count(*) AS n FROM clusters GROUP BY CUBE (cluster, nation)",
    "store_rollup": "SELECT cluster, nation, count(*) AS n FROM clusters GROUP BY ROLLUP (cluster, nation)",
    "store_distinct": "SELECT cluster, count(DISTINCT nation) AS nations, count(*) FILTER (WHERE nation > 10) AS far FROM clusters GROUP BY cluster",
    "store_anti_join": "SELECT c.object_id FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.object_id = c.object_id)",
    "store_top_k": "SELECT object_id, n FROM objects ORDER BY n DESC, object_id LIMIT 10",
    "store_full_join": "SELECT coalesce(o.object_id, c.object_id) AS object_id, o.n, c.cluster FROM (SELECT * FROM objects WHERE object_id % 3 <> 0) o FULL OUTER JOIN clusters c ON o.object_id = c.object_id",
    "store_lateral": "SELECT c.cluster, c.nation, t.doubled FROM (SELECT DISTINCT cluster, nation FROM clusters) c, LATERAL (SELECT 2 * c.nation + c.cluster AS doubled) t",
}


def _store_query(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        return _store(spark, sf_dir).query(sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, OBJECTS + sql


for _name, _sql in STORE_SQL.items():
    _store_query(_name, _sql)
