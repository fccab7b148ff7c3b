"""Operators of the library against small exact expectations and brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxtable.functions.rank import dense_index
from voxtable.model import VolumeFrame
from voxtable.operators import classify, cluster, filters, gates, graph, joins, measure, reduce, segment, validate
from voxtable.operators.graph import connected_components
from voxtable.sources import open_volume, read_zarr, write_tiff, write_zarr
from voxtable.sources.golden import golden_mask, golden_metadata, golden_table
from voxtable.sources.tiff import _plane_file, _unpack_bits, page_axes, to_czyx
from voxtable.store import MeasurementStore
from voxtable.workflow import Pipeline, Step, available_steps, coerce_params, editable_parameters, get_step_function, summarize_params


def voxels(spark, a, name="value", sparse=False):
    a = np.asarray(a, float)
    a = a[None] if a.ndim == 2 else a[None, None] if a.ndim == 1 else a
    rows = [(int(z), int(y), int(x), float(a[z, y, x])) for z, y, x in np.ndindex(a.shape) if not sparse or a[z, y, x]]
    return spark.createDataFrame(rows, f"z int, y int, x int, {name} double")


def labels_of(spark, a):
    return voxels(spark, a, "label", sparse=True).withColumn("label", F.col("label").cast("int"))


def dense(df, shape, name="value"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[name]
    return out


def mask_of(spark, a):
    return voxels(spark, np.asarray(a, float)).select("z", "y", "x", (F.col("value") > 0).alias("mask"))


def test_thresholds(spark):
    v = voxels(spark, [0, 5, 10, 15, float("nan")])
    got = segment.threshold_mask(v, value=10).orderBy("x").collect()
    assert [r["mask"] for r in got] == [False, False, True, True, False]
    rng = np.random.default_rng(0)
    two = voxels(spark, np.concatenate([rng.normal(20, 2, 500), rng.normal(200, 2, 500)]))
    got = [r["mask"] for r in segment.threshold_mask(two, method="otsu").orderBy("x").collect()]
    assert sum(got[:500]) < 25 and sum(got[500:]) > 475
    hundred = voxels(spark, np.arange(100))
    assert 9 <= segment.threshold_mask(hundred, method="percentile", percentile=90).where("mask").count() <= 11
    assert segment.otsu_value(voxels(spark, [7, 7, 7])).first()["t"] == 7
    for bad in ({}, {"method": "percentile"}, {"method": "no"}):
        with pytest.raises(ValueError):
            segment.threshold_mask(v, **bad)


@pytest.mark.parametrize("connectivity,block", [(1, 64), (2, 3), (3, 2)])
def test_components_against_flood_fill(spark, connectivity, block):
    a = np.random.default_rng(connectivity).random((5, 7, 6)) < 0.3
    want, n = np.zeros(a.shape, int), 0
    for start in np.ndindex(a.shape):
        if a[start] and not want[start]:
            n += 1
            stack = [start]
            want[start] = n
            while stack:
                p = stack.pop()
                for o in np.ndindex(3, 3, 3):
                    q = tuple(i + k - 1 for i, k in zip(p, o))
                    if 0 < sum(abs(k - 1) for k in o) <= connectivity and all(0 <= i < s for i, s in zip(q, a.shape)) and a[q] and not want[q]:
                        want[q] = n
                        stack.append(q)
    got = dense(segment.label_components(mask_of(spark, a), a.shape, connectivity=connectivity, block=block), a.shape, "label")
    assert (got == want).all()


def test_components_edges(spark):
    assert segment.label_components(mask_of(spark, np.zeros((3, 3, 3))), (3, 3, 3)).count() == 0
    diagonal = np.zeros((4, 4))
    diagonal[1, 1] = diagonal[2, 2] = 1
    assert segment.label_components(mask_of(spark, diagonal), (1, 4, 4)).agg(F.max("label")).first()[0] == 2
    assert segment.label_components(mask_of(spark, diagonal), (1, 4, 4), connectivity=2).agg(F.max("label")).first()[0] == 1
    with pytest.raises(ValueError):
        segment.label_components(mask_of(spark, diagonal), (1, 4, 4), connectivity=3)


def test_connected_components_long_path_and_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in range(5, 40))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dense_index(spark):
    df = spark.range(0, 1000, 3).repartition(7)
    got = dense_index(df, "id", "n").orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))


def test_distance_against_brute_force(spark):
    a = np.random.default_rng(4).random((4, 7, 6)) < 0.8
    got = dense(segment.distance_squared(mask_of(spark, a), a.shape), a.shape, "d2")
    zeros = np.argwhere(~a)
    for p in np.argwhere(a):
        assert got[tuple(p)] == ((zeros - p) ** 2).sum(1).min()


def test_watershed_splits_a_bridge(spark):
    a = np.zeros((20, 40))
    a[5:15, 2:18] = a[5:15, 22:38] = a[9:11, 18:22] = 1
    got = dense(segment.watershed_split(None, mask_of(spark, a), (1, 20, 40), min_distance=5), (1, 20, 40), "label")[0]
    assert got[10, 10] != got[10, 30] and got[10, 10] and got[10, 30]


def test_size_filter(spark):
    a = np.zeros((10, 10), int)
    a[0, 0], a[2:5, 2:5], a[6:10, 6:10] = 1, 2, 3
    kept = dense(segment.filter_by_size(labels_of(spark, a), min_size=5, max_size=15), (1, 10, 10), "label")
    assert set(np.unique(kept)) == {0, 1} and (kept > 0).sum() == 9
    same = labels_of(spark, a)
    assert segment.filter_by_size(same) is same
    assert segment.filter_by_size(same, min_size=100).count() == 0


def test_points(spark):
    points = spark.createDataFrame([(1, 0.0, 2.0, 2.0), (2, 0.0, 7.0, 7.0), (3, 0.0, 7.0, 8.0)], "point_id int, z double, y double, x double")
    got = dense(segment.labels_from_points(points, (1, 10, 10), radius=1.5), (1, 10, 10), "label")[0]
    assert got[2, 2] == 1 and got[7, 7] == 3 and got[7, 6] == 2
    assert segment.labels_from_points(points.where("false"), (1, 5, 5), radius=1).count() == 0


def test_points_from_sql(spark):
    points = [(1, 2.0, 3.0, 3.0), (2, 2.0, 3.0, 4.5), (3, 0.0, 0.0, 0.0), (4, None, 1.0, 1.0), (5, 2.0, 3.0, 3.0), (6, 99.0, 0.0, 0.0)]
    frame = spark.createDataFrame(points, "point_id long, z double, y double, x double")
    with MeasurementStore(spark) as store:
        store.register("points", frame)
        got = store.query("SELECT b.z, b.y, b.x, CAST(max(point_id) AS INT) AS label FROM points p, LATERAL ball(p.z, p.y, p.x, 1.5D, 4, 6, 7) b GROUP BY ALL").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, segment.labels_from_points(frame.where("z IS NOT NULL"), (4, 6, 7), radius=1.5).collect())) and {r["label"] for r in got} == {2, 3, 5}


def test_gates(spark):
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-5.0, 5.0), (5.0, 15.0)], "x double, y double")
    inside = gates.polygon_gate(F.col("x"), F.col("y"), [(0, 0), (10, 0), (10, 10), (0, 10)])
    other = gates.rectangle_gate(F.col("x"), F.col("y"), x_min=5, x_max=15, y_min=5, y_max=5)
    assert [tuple(r) for r in df.select(inside, other, inside & ~other, inside | other).collect()] == [(True, True, False, True), (False, True, False, True), (False, False, False, False), (False, False, False, False)]


def test_measurements(spark):
    a = np.zeros((5, 5), int)
    a[0:2, 0:2], a[3:5, 3:5] = 1, 2
    v = np.where(a == 1, 10.0, np.where(a == 2, 20.0, 0.0))
    t = measure.extract_measurements(labels_of(spark, a), voxels(spark, v))
    assert t.columns == ["object_id", "count", "mean", "min", "max", "sum", "stddev", "threshold_mean"]
    assert [tuple(r)[:6] for r in t.orderBy("object_id").collect()] == [(1, 4, 10, 10, 10, 40), (2, 4, 20, 20, 20, 80)]
    with pytest.raises(ValueError, match="shape"):
        measure.extract_measurements(labels_of(spark, a), voxels(spark, v), (1, 5, 5), (1, 5, 6))
    twenty = spark.range(20).select(F.col("id").cast("double").alias("value"))
    assert measure.threshold_mean(twenty).first()[0] == 17
    assert math.isnan(measure.threshold_mean(twenty.where("false")).first()[0])
    assert [r["label"] for r in measure.object_ids(labels_of(spark, a)).collect()] == [1, 2]
    assert measure.object_pixel_indices(labels_of(spark, a), 999).count() == 0
    assert measure.object_pixel_indices(labels_of(spark, a), 0, (1, 5, 5)).count() == 17


def _pad(a, r):
    return np.pad(a, [(k, k) for k in r], mode="symmetric")


def test_gaussian_and_median_against_numpy(spark):
    a = np.random.default_rng(1).random((3, 9, 8)) * 50
    want = a.copy()
    for axis in range(3):
        w = filters.gaussian_weights(0.8)
        r = len(w) // 2
        wide = _pad(want, [r if k == axis else 0 for k in range(3)])
        want = sum(x * np.take(wide, range(k, k + want.shape[axis]), axis) for k, x in enumerate(w))
    assert np.allclose(dense(filters.gaussian_blur(voxels(spark, a), a.shape, 0.8), a.shape), want)
    wide = _pad(a, (1, 1, 1))
    want = np.median(np.stack([wide[i : i + 3, j : j + 9, k : k + 8] for i in range(3) for j in range(3) for k in range(3)]), axis=0)
    for block in (4, 32):  # the cut into cubes does not show
        assert np.allclose(dense(filters.median_filter(voxels(spark, a), a.shape, 1, block=block), a.shape), want)


def test_rolling_ball_against_brute_force(spark):
    a = np.random.default_rng(2).integers(0, 99, (2, 7, 9)).astype(float)
    want = np.zeros(a.shape)
    for p in np.ndindex(a.shape):
        want[p] = max(0, a[p] - min(a[q] + 3 - math.sqrt(9 - d) for q in np.ndindex(a.shape) if (d := sum((i - j) ** 2 for i, j in zip(p, q))) <= 9))
    for block in (4, 32):
        assert np.allclose(dense(filters.subtract_background(voxels(spark, a), a.shape, radius=3, block=block), a.shape), want)


def test_contrast(spark):
    v = voxels(spark, [[10, 20], [30, 40]])
    got = dense(filters.enhance_contrast(v), (1, 2, 2))
    assert got.min() == 0 and got.max() == 1
    assert dense(filters.enhance_contrast(v, dtype="uint8"), (1, 2, 2)).max() == 255
    even = dense(filters.enhance_contrast(voxels(spark, np.random.default_rng(3).random((16, 16)) ** 4), (1, 16, 16), method="equalize"), (1, 16, 16))
    assert 0 <= even.min() and even.max() <= 1 + 1e-9
    with pytest.raises(ValueError):
        filters.enhance_contrast(v, method="no")


def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(30 * k + i, [float(x) for x in rng.normal(c, 2)]) for k, c in enumerate([(0, 0), (50, 0), (25, 50)]) for i in range(30)]
    return spark.createDataFrame(rows, "object_id long, features array<double>")


def score(df):
    return validate.cluster_assignment_ari(df.withColumn("truth", F.floor(F.col("object_id") / 30)), "cluster", "truth").first()[0]


def test_clustering(spark):
    data = blobs(spark)
    assert score(cluster.kmeans(data, 3, seed=0)) > 0.95
    assert score(cluster.gaussian_mixture(data, 3, seed=0)) > 0.95
    for linkage in cluster.LINKAGES:
        assert score(cluster.hierarchical(data, 3, linkage=linkage)) > 0.9
    labels, scores = cluster.auto_k_kmeans(data, k_min=2, k_max=5, seed=0)
    assert score(labels) > 0.95 and scores.orderBy(F.desc("bic")).first()["k"] == 3
    assert cluster.kmeans(data, 1).select("cluster").distinct().count() == 1
    with pytest.raises(ValueError):
        cluster.hierarchical(data, 3, linkage="no")
    with pytest.raises(ValueError):
        cluster.auto_k_kmeans(data, k_min=3, k_max=2)


def test_the_mean_of_many_rows_is_exact(spark):
    """One pass over rows far from the origin is off by more than 1e-9."""
    data = spark.range(100_000).select(F.col("id").alias("object_id"), F.array(F.col("id") % 7 + 1e9).alias("features"))
    centred = reduce._centred(data).select(vector_to_array("centred")[0]).toPandas().iloc[:, 0]
    assert abs(math.fsum(centred)) / len(centred) < 1e-11


def test_reduction(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    rows = [(i, [float(x[i]), float(x[i] + rng.normal(0, 0.01)), float(rng.normal(0, 0.01))]) for i in range(60)]
    data = spark.createDataFrame(rows, "object_id long, features array<double>")
    var = reduce.pca_explained_variance(data, 3)
    assert var[0] > 0.9 and var == sorted(var)
    assert abs(reduce.pca(data, 2).agg(F.avg("c0")).first()[0]) < 1e-9
    for f in (reduce.isomap, reduce.laplacian_eigenmap):
        assert f(data, 2).columns == ["object_id", "c0", "c1"]
    line = np.array([r["c0"] for r in reduce.isomap(data, 1).orderBy("object_id").collect()])
    assert abs(np.corrcoef(line, x)[0, 1]) > 0.99
    a, b = (reduce.tsne(data, 2, seed=1, perplexity=5, iterations=50).orderBy("object_id").collect() for _ in range(2))
    assert a == b


def test_class_map(spark):
    a = np.array([[0, 1, 1], [2, 2, 0]])
    got = classify.class_map(labels_of(spark, a), classify.pair_up([1, 2], [5, 9], spark))
    assert (dense(got, (1, 2, 3), "class_id")[0] == [[0, 5, 5], [9, 9, 0]]).all()
    twice = classify.class_map(labels_of(spark, a), classify.pair_up([1, 1], [5, 6], spark))
    assert (dense(twice, (1, 2, 3), "class_id")[0] == [[0, 6, 6], [0, 0, 0]]).all()
    with pytest.raises(ValueError):
        classify.pair_up([1, 2], [5], spark)
    with pytest.raises(IndexError):
        classify.class_map(labels_of(spark, a), classify.pair_up([7], [5], spark), max_label=2)


def test_network(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(24):
        c = rng.normal(0, 0.1, (4, 4, 4))
        if i % 2:
            c[1:3, 1:3, 1:3] += 1
        rows.append((i, 4, 4, 4, [float(v) for v in c.ravel()], i % 2))
    crops = spark.createDataFrame(rows, "object_id long, d int, h int, w int, crop array<float>, class_id long").coalesce(2)
    model = classify.Cell3DClassifier(2)
    # numerical gradient of a few weights
    x, y = np.array([r[4] for r in rows[:3]]).reshape(3, 1, 4, 4, 4), np.array([r[5] for r in rows[:3]])
    g, loss = classify.gradients(model.weights, x, y)
    for k, at in ((0, (1, 5)), (2, (3, 7)), (4, (0, 2)), (5, (1,))):
        w = [v.copy() for v in model.weights]
        w[k][at] += 1e-6
        assert abs((classify.gradients(w, x, y)[1] - loss) / 1e-6 - g[k][at]) < 1e-3
    losses = classify.train_classifier(model, crops, epochs=15, lr=1e-2)
    assert losses[-1] < losses[0]
    right = classify.predict(model, crops).join(crops.select("object_id", F.col("class_id").alias("y")), "object_id").where("class_id = y").count()
    assert right / 24 > 0.9


def test_model_contract(spark):
    seen = []

    class Stub:
        def eval(self, x, **kw):
            masks = np.zeros(x.shape[:-1], int)
            masks[tuple(n // 2 for n in masks.shape)] = len(kw)
            assert x.shape[-1] == 3 and kw["channel_axis"] == -1 and ("z_axis" in kw) == kw["do_3D"]
            return masks, None, None

    tile = voxels(spark, np.ones((4, 5, 6))).withColumn("tile", F.lit("a"))
    for do_3d, at in ((False, (0, 2, 3)), (True, (2, 2, 3))):
        rows = segment.apply_model(tile, Stub(), "tile string, z int, y int, x int, label int", do_3d=do_3d).collect()
        seen.append([(r["z"], r["y"], r["x"]) for r in rows] == [at])
    assert all(seen)


def test_validation(spark):
    a, b = labels_of(spark, [[1, 1, 0]]), labels_of(spark, [[0, 2, 2]])
    assert validate.segmentation_iou(a, b).first()[0] == pytest.approx(1 / 3)
    assert validate.segmentation_iou(a, a).first()[0] == 1 and validate.segmentation_iou(a.where("false"), a.where("false")).first()[0] == 1
    e = spark.createDataFrame([(1, 10.0, 2.0), (2, float("nan"), 3.0)], "k int, u double, v double")
    assert validate.feature_table_diff(e, e, key="k").count() == 0
    off = e.withColumn("v", F.col("v") + 1).drop("u")
    got = {r["column"]: (r["status"], r["n_failing"]) for r in validate.feature_table_diff(off, e, key="k").collect()}
    assert got == {"u": ("missing_in_actual", None), "v": ("out_of_tolerance", 2)}
    with pytest.raises(ValueError):
        validate.feature_table_diff(e.where("k = 1"), e, key="k")


def test_volume(spark):
    a = np.arange(120, dtype=float).reshape(2, 3, 4, 5) + 1
    df = spark.createDataFrame([(*map(int, i), float(a[i])) for i in np.ndindex(a.shape)], "c int, z int, y int, x int, value double")
    v = VolumeFrame(df, a.shape, "float32")
    assert (v.n_channels, v.depth, v.height, v.width, v.nbytes) == (2, 3, 4, 5, 480)
    assert v.fits_in_memory(480) and not v.fits_in_memory(479)
    assert v.voxel(1, 2, 3, 4) == 120 and v.voxel(-1, -1, -1, -1) == 120
    with pytest.raises(IndexError):
        v.voxel(2, 0, 0, 0)
    box = dense(v.subvolume(1, 1, 2, 3, 9, 9, 1), (2, 2, 1))
    assert (box == a[1, 1:, 2:, 3:4]).all()
    with pytest.raises(ValueError):
        VolumeFrame(df, (3, 4, 5))


def test_zarr_and_tiff_round_trips(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 500, (2, 3, 8, 10))
    df = spark.createDataFrame([(*map(int, i), float(a[i])) for i in np.ndindex(a.shape)], "c int, z int, y int, x int, value double")
    v = VolumeFrame(df, a.shape, "uint16")
    for name, write in (("a.zarr", lambda p: write_zarr(v, p, (1, 2, 3, 4))), ("plain", lambda p: write_zarr(v, p, (2, 3, 8, 10), None)), ("b.tif", lambda p: write_tiff(v, p))):
        path = str(tmp_path / name)
        write(path)
        write(path)  # overwrites
        got = open_volume(spark, path)
        assert got.shape == a.shape and got.dtype == "uint16"
        back = np.zeros(a.shape, int)
        for r in got.df.collect():
            back[r["c"], r["z"], r["y"], r["x"]] = r["value"]
        assert (back == a).all()
    part = read_zarr(spark, str(tmp_path / "a.zarr"), {"y": (2, 5), "c": (1, 2)}).df
    assert part.count() == (a[1:, :, 2:5] > 0).sum()
    with pytest.raises(ValueError):
        open_volume(spark, str(tmp_path / "x.bin"))


def test_axes():
    assert to_czyx("ZYX", [2, 3, 4]) == [("C", None), ("Z", 0), ("Y", 1), ("X", 2)]
    assert to_czyx("TZYX", [1, 2, 3, 4])[1] == ("Z", 1)
    for axes, sizes, error in (("TZYX", [2, 1, 1, 1], NotImplementedError), ("YXS", [1, 1, 3], NotImplementedError), ("ZX", [1, 1], ValueError), ("QYX", [1, 1, 1], ValueError)):
        with pytest.raises(error):
            to_czyx(axes, sizes)
    assert _unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\x01\x02\x03\x09\x09\x09"


def test_store(spark):
    with MeasurementStore(spark) as store:
        store.register("m", spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "object_id int, mean double"))
        store.register("k", spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "object_id int, cluster int"))
        assert store.query("SELECT count(*) AS n FROM m WHERE mean > 15").first()["n"] == 2
        assert [r["cluster"] for r in store.query("SELECT cluster FROM m JOIN k USING (object_id) ORDER BY object_id").collect()] == [0, 1, 0]
        store.register("m", spark.createDataFrame([(9, 1.0)], "object_id int, mean double"))
        assert store.query("SELECT object_id FROM m").first()[0] == 9
        with pytest.raises(ValueError):
            store.query("CREATE TABLE t AS SELECT 1")
    with pytest.raises(RuntimeError):
        store.query("SELECT 1")


def test_workflow(spark):
    a = np.zeros((6, 6))
    a[1:3, 1:3] = a[3:5, 3:5] = 100
    p = Pipeline().add_step(Step("segmentation", "threshold_mask", {"value": 50}, {"volume": "v"}, "mask")).add_step(Step("segmentation", "label_components", {}, {"mask": "mask", "shape": "shape"}, "labels"))
    p.add_step(Step("measurements", "extract_measurements", {}, {"labels": "labels", "intensity": "v"}, "table"))
    context = {"v": voxels(spark, a), "shape": (1, 6, 6)}
    out = p.run(context)
    assert out["mask"].where("mask").count() == 8 and sorted(r["mean"] for r in out["table"].collect()) == [100, 100] and set(context) == {"v", "shape"}
    same = Pipeline([Step("a", "b"), Step("a", "b")])
    first = same.steps[0]
    same.delete_step(same.steps[1])
    assert same.steps == [first]
    with pytest.raises(KeyError, match="missing"):
        Step("segmentation", "threshold_mask", {}, {"volume": "nothing"}).run({})
    with pytest.raises(KeyError):
        get_step_function("segmentation", "no")
    with pytest.raises(KeyError):
        available_steps("no")
    assert "kmeans" in available_steps("clustering") and sum(map(len, available_steps().values())) == 24
    kinds = {s.name: s.kind for s in editable_parameters("segmentation", "threshold_mask")}
    assert kinds == {"method": "str", "value": "float", "percentile": "float", "integers": "bool"}
    assert coerce_params("segmentation", "threshold_mask", {"value": "3", "percentile": ""}) == {"value": 3.0, "percentile": None}
    assert summarize_params(Step("a", "b")) == "(default parameters)" and summarize_params(Step("a", "b", {"k": 1})) == "k=1"
    assert Step.from_json(p.steps[0].to_json()).params == {"value": 50}


def test_percentile_is_exact(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(0, 1, 5000), np.repeat([1.0, 2.0, 2.0, 9.0], 100), np.array([3.0]), np.array([0.1, 0.1 + 1e-17, 0.2]), rng.integers(0, 5, 999).astype(float), np.concatenate([rng.normal(0, 1e-9, 500), [1e12]])):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "value double")
        for p in (0, 13.7, 50, 90, 100):
            assert segment.percentile_value(frame, p) == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-15)
    assert segment.percentile_value(spark.createDataFrame([], "value double"), 50) is None


def dense_rows(spark, array):
    at = np.argwhere(array != 0)
    return spark.createDataFrame([(*map(int, p), float(array[tuple(p)])) for p in at], "z int, y int, x int, value double")


def to_dense(frame, shape):
    out = np.zeros(shape)
    for r in frame.collect():
        out[r["z"], r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize("sigma,block", [(1.0, 8), ((0, 2.5, 1), 8), (3.0, 4)])
def test_gaussian_by_cubes(spark, sigma, block):
    rng = np.random.default_rng(1)
    array = rng.integers(0, 50, (5, 19, 23)) * (rng.random((5, 19, 23)) < 0.3)
    want = array.astype(float)
    for axis, s in enumerate((sigma,) * 3 if isinstance(sigma, float) else sigma):
        if s:
            w = filters.gaussian_weights(float(s))
            r = len(w) // 2
            padded = np.pad(want, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
            want = np.apply_along_axis(lambda v, w=w: np.convolve(v, w, "valid"), axis, padded)
    got = to_dense(filters.gaussian_blur(dense_rows(spark, array), array.shape, sigma, block=block), array.shape)
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("radius", [3, 7.5, 50])
def test_background_of_any_radius(spark, radius):
    rng = np.random.default_rng(2)
    array = rng.integers(1, 99, (3, 20, 24))
    r = int(radius)
    low = np.full(array.shape, np.inf)
    for z in range(-2, 3):
        for y in range(-min(r, 19), min(r, 19) + 1):
            for x in range(-min(r, 23), min(r, 23) + 1):
                if (d := z * z + y * y + x * x) <= radius * radius:
                    h = radius - (radius * radius - d) ** 0.5
                    to = tuple(slice(max(0, -k), n - max(0, k)) for k, n in zip((z, y, x), array.shape))
                    of = tuple(slice(max(0, k), n - max(0, -k)) for k, n in zip((z, y, x), array.shape))
                    low[to] = np.minimum(low[to], array[of] + h)
    got = to_dense(filters.subtract_background(dense_rows(spark, array), array.shape, radius=radius, block=16), array.shape)
    assert np.allclose(got, np.maximum(array - low, 0), atol=1e-9)


@pytest.mark.parametrize("span", [None, "month"])
def test_asof_join(spark, span):
    import datetime as dt

    rng = np.random.default_rng(3)
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=int(k))
    left = [(i, int(rng.integers(0, 5)), day(rng.integers(0, 400))) for i in range(200)] + [(900, None, day(3)), (901, 1, None)]
    times = {(int(rng.integers(0, 4)), int(rng.integers(0, 400))) for _ in range(60)}
    right = [(u, day(k), 10 * k + u) for u, k in sorted(times)]
    a, b = spark.createDataFrame(left, "id int, who int, at timestamp_ntz"), spark.createDataFrame(right, "who int, ts timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in joins.asof_join(a, b, on="who", left_time="at", right_time="ts", span=span).collect()}
    want = {i: max(((t, v) for u, t, v in right if u == who and when is not None and t <= when), default=(None, None))[1] for i, who, when in left}
    assert got == want


def test_range_join(spark):
    """Ranges of all lengths, a point that a third of the rows share, nulls, and ends that are left out."""
    r = np.random.default_rng(9)
    points = [(i, None if i == 5 else 7.0 if i % 3 == 0 else float(r.normal(0, 50)), i % 2) for i in range(150)]
    ranges = [(k, float(a), float(a + 10.0**e), k % 2) for k, (a, e) in enumerate(zip(r.normal(0, 40, 60), r.uniform(-6, 4, 60)))] + [(900, 7.0, 7.0, 0), (901, None, 9.0, 1), (902, 3.0, 7.0, 1), (903, 7.0, 8.0, 1), (904, 9.0, 2.0, 0)]
    p, q = spark.createDataFrame(points, "i long, v double, g long"), spark.createDataFrame(ranges, "k long, a double, b double, g long")
    hit = {(i, k) for i, v, _ in points for k, a, b, _ in ranges if v is not None and a is not None and a <= v < b}
    got = joins.range_join(p.drop("g"), q.drop("g"), at="v", low="a", high="b")
    assert sorted((x["i"], x["k"]) for x in got.collect()) == sorted(hit) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    same = joins.range_join(p, q, at="v", low="a", high="b", on=["g"])
    assert {(x["i"], x["k"]) for x in same.collect()} == {(i, k) for i, k in hit if i % 2 == (dict((x[0], x[3]) for x in ranges)[k])}
    assert joins.range_join(p.drop("g"), q.drop("g").limit(0), at="v", low="a", high="b").count() == 0


def test_range_join_compares_equal_rows_once(spark, monkeypatch):
    """Lists meet in the join, and no pair is lost where a value's rows fill several lists."""
    monkeypatch.setattr(joins, "LIST", 7)
    points = spark.range(40).select("id", F.when(F.col("id") < 30, 1.0).otherwise(F.col("id") / 10).alias("v"))
    ranges = spark.range(25).select(F.col("id").alias("k"), F.lit(0.5).alias("a"), F.lit(3.5).alias("b"))
    got = joins.range_join(points, ranges, at="v", low="a", high="b")
    assert got.columns == ["id", "v", "k", "a", "b"] and sorted((r["id"], r["k"]) for r in got.collect()) == [(i, k) for i in range(36) if i < 35 for k in range(25)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(__ranges" in plan.split("Join Inner")[0]


def test_to_numpy_keeps_to_its_budget(spark):
    v = VolumeFrame(spark.createDataFrame([(0, 0, 1, 2, 5.0)], "c int, z int, y int, x int, value double"), (1, 1, 2, 3), "uint16", 7.0)
    assert v.to_numpy().tolist() == [[[[7, 7, 7], [7, 7, 5]]]] and v.to_numpy().dtype == np.uint16
    with pytest.raises(MemoryError):
        v.to_numpy(max_bytes=11)


@pytest.mark.parametrize("text,order", [('<OME><Image ID="a"><Pixels DimensionOrder="XYZCT" SizeC="2" SizeZ="3" SizeT="1"/></Image></OME>', "CZ"), ('<OME><Image ID="a"><Pixels DimensionOrder="XYCZT" SizeC="2" SizeZ="3" SizeT="1"/></Image></OME>', "ZC"), ("ImageJ=1.53\nimages=6\nchannels=2\nslices=3\n", "ZC"), ("", "Z")])
def test_pages_run_as_their_description_says(spark, tmp_path, text, order):
    array = np.random.default_rng(4).integers(1, 200, (2, 3, 4, 5)).astype(np.uint8)
    pages = array.reshape(6, 4, 5) if order in ("CZ", "Z") else array.transpose(1, 0, 2, 3).reshape(6, 4, 5)
    (tmp_path / "v.tif").write_bytes(_plane_file(list(pages), text))
    v = open_volume(spark, f"{tmp_path}/v.tif")
    want = array if order != "Z" else array.reshape(1, 6, 4, 5)
    assert v.shape == want.shape and v.to_numpy().tolist() == want.tolist()


def test_page_descriptions_are_checked():
    assert page_axes("channels=2\n", 6) == ("TZC", [1, 3, 2]) and page_axes("", 4) == ("TZC", [1, 4, 1])
    for text, pages in (("channels=4\n", 6), ('<OME><Image ID="1"><Pixels SizeC="2" SizeZ="2" SizeT="1"/></Image></OME>', 6)):
        with pytest.raises(ValueError):
            page_axes(text, pages)
    with pytest.raises(NotImplementedError):
        page_axes('<OME><Image ID="1"/><Image ID="2"/></OME>', 6)


def test_time_series_are_refused(spark, tmp_path):
    (tmp_path / "t.tif").write_bytes(_plane_file([np.ones((2, 2), np.uint8)] * 4, "ImageJ=1.53\nframes=2\nslices=2\n"))
    with pytest.raises(NotImplementedError):
        open_volume(spark, f"{tmp_path}/t.tif")


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "MANY", 3)
    edges = [(0, k) for k in range(1, 30)] + [(100, k) for k in range(25, 60)] + [(200, 201), (201, 202)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in [*range(60), 100]} | {200: 200, 201: 200, 202: 200}


def test_single_linkage_of_many_rows_is_exact(spark):
    """Against agglomeration of all rows, with repeated rows and several blocks."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (14, 3)) for c in (0, 6, 12)] + [np.repeat(rng.normal(3, 1, (2, 3)), 4, axis=0)])
    rows = spark.createDataFrame([(f"r{k:03d}", v.tolist()) for k, v in enumerate(x)], "object_id string, features array<double>")
    want = np.arange(len(x))  # pairs from the nearest on, until six clusters are left
    for _, i, j in sorted((((x[i] - x[j]) ** 2).sum(), i, j) for i in range(len(x)) for j in range(i)):
        if len(set(want)) > 6:
            want[want == want[i]] = want[j]
    got = {r["object_id"]: r["cluster"] for r in cluster.single_linkage(rows, 6, block=25).collect()}
    pairs = {(got[f"r{k:03d}"], w) for k, w in enumerate(want)}
    assert len(pairs) == len(set(want)) == len(set(got.values())) == 6


def test_expected_results_are_loaded(spark, tmp_path):
    (tmp_path / "a_measurements.csv").write_text("object_id,mean,count,sum,stddev,min,max\n1,2.5,2,5,0.5,2,3\n")
    (tmp_path / "a_segmentation_singlethreshold.tif").write_bytes(_plane_file([np.array([[0, 7], [7, 0]], np.uint16)], ""))
    (tmp_path / "a_metadata.txt").write_text("threshold: 40\nobjects = 1\n")
    (tmp_path / "synthetic_clustering_kmeans_k3.csv").write_text("point_id,cluster\n0,2\n")
    folder = f"file://{tmp_path}"
    assert [tuple(r) for r in golden_table(spark, folder, "measurements", "a").collect()] == [(1, 2, 2.5, 5.0, 0.5, 2.0, 3.0)]
    assert sorted(tuple(r) for r in golden_mask(spark, folder, "a").collect()) == [(0, 0, 1, 7), (0, 1, 0, 7)]
    assert golden_metadata(spark, folder, "a") == {"threshold": "40", "objects": "1"} and golden_table(spark, folder, "kmeans_k3").first()["cluster"] == 2
    for load in (lambda: golden_table(spark, folder, "pca"), lambda: golden_mask(spark, folder, "b"), lambda: golden_metadata(spark, folder, "b")):
        with pytest.raises(FileNotFoundError):
            load()


def test_threshold_of_many_integer_values(spark):
    """As many bins as different values, summed over several ranges."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(0, 10**6, 400), rng.integers(4 * 10**6, 5 * 10**6, 200)]).astype(float)
    x, n = np.unique(v, return_counts=True)
    w, s = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
    want = x[np.argmax(w * (n.sum() - w) * (s / w - ((n * x).sum() - s) / (n.sum() - w)) ** 2)]
    assert segment.otsu_value(spark.createDataFrame([(float(k),) for k in v], "value double").repartition(5), integers=True).first()["t"] == want


def test_distances_need_a_background(spark):
    """A volume of foreground alone has no distances; the watershed still labels its voxels."""
    full = mask_of(spark, np.ones((2, 5, 6)))
    assert segment.distance_squared(full, (2, 5, 6)).count() == 0
    assert segment.distance_squared(mask_of(spark, np.ones((1, 5, 6))), (2, 5, 6)).count() == 30  # absent voxels are background
    assert segment.watershed_split(None, full, (2, 5, 6), min_distance=3).where("label > 0").count() == 60


def test_components_of_a_dense_volume_are_not_broadcast(spark, monkeypatch):
    """A full volume's cubes are small files of many rows; only the names of their parts may go to every task."""
    full = spark.range(40 * 40).select(F.lit(0).alias("z"), F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), F.lit(True).alias("mask"))
    wide = []
    monkeypatch.setattr(segment, "connected_components", lambda edges: wide.append(edges) or connected_components(edges))
    got = segment.label_components(full, (1, 40, 40), connectivity=2, block=10)
    assert got.count() == 1600 and got.where("label = 1").count() == 1600
    assert "Broadcast" not in wide[0]._jdf.queryExecution().executedPlan().toString()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "rightHint=(strategy=broadcast)" in plan  # the names, not the voxels
    monkeypatch.setattr(segment, "NAMES", 3)
    many = segment.label_components(full.where("x % 2 = 0"), (1, 40, 40), block=10)
    assert many.select("label").distinct().count() == 20 and many.count() == 800
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_fits_read_each_different_row_once(spark, monkeypatch):
    """Forty copies of each row: fits see the row once, with its number, and the result is of all rows."""
    x = np.concatenate([np.random.default_rng(k).normal(30 * k, 1, (12, 2)) for k in range(3)])
    rows = [(40 * i + c, [float(v) for v in r]) for i, r in enumerate(x) for c in range(40)]
    data = spark.createDataFrame(rows, "object_id long, features array<double>").repartition(4)
    fitted = []
    for kind in (cluster.GaussianMixture, cluster.KMeans):
        monkeypatch.setattr(kind, "fit", lambda self, d, fit=kind.fit: (fitted.append(d.count()), fit(self, d))[1])
    for got in (cluster.gaussian_mixture(data, 3, seed=0), cluster.auto_k_kmeans(data, k_min=1, k_max=3, seed=0)[0]):
        pairs = got.select("cluster", F.floor(F.col("object_id") / 480).alias("truth"))
        assert got.count() == 1440 and validate.cluster_assignment_ari(pairs, "cluster", "truth").first()["ari"] == 1
    assert set(fitted) == {36}
    twice = cluster.nearest_centre(data, [[0.0, 0.0], [60.0, 60.0]])
    once = cluster.nearest_centre(cluster.different(data).select(F.struct("w").alias("object_id"), "features"), [[0.0, 0.0], [60.0, 60.0]])
    assert abs(cluster.kmeans_bic(twice, 2, 2).first()["bic"] - cluster.kmeans_bic(once, 2, 2, "object_id.w").first()["bic"]) < 1e-6
