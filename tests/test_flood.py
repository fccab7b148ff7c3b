"""Watershed by cubes against one flood that takes the edges in their order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import flood, segment

VOXELS = "z int, y int, x int, d2 double"


def by_edges(d2, markers):
    """Edges from the highest down; what they connect is joined unless both sides have a marker. d2 of 0 is background."""
    h, w = d2.shape[1:]
    edges = []
    for p in np.argwhere(d2 > 0):
        for axis in range(3):
            q = p.copy()
            q[axis] += 1
            if q[axis] < d2.shape[axis] and d2[tuple(q)] > 0:
                a, b = d2[tuple(p)], d2[tuple(q)]
                r = (p[0] * h + p[1]) * w + p[2]
                edges.append((-min(a, b), -max(a, b), r * 3 + axis, tuple(p), tuple(q)))
    up = {tuple(p): tuple(p) for p in np.argwhere(d2 > 0)}
    mark = {p: markers.get(p, 0) for p in up}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for *_, p, q in sorted(edges):
        a, b = top(p), top(q)
        if a != b and not (mark[a] and mark[b]):
            if mark[b]:
                a, b = b, a
            up[b] = a
    return {p: mark[top(p)] for p in up if mark[top(p)]}


def volume(seed, shape, share, levels):
    r = np.random.default_rng(seed)
    d2 = r.integers(1, levels + 1, shape) * (r.random(shape) < share)
    places = [tuple(map(int, p)) for p in np.argwhere(d2 > 0)]
    return d2, {places[int(k)]: i + 1 for i, k in enumerate(r.choice(len(places), min(len(places), 9), replace=False))}


def run(spark, d2, markers, **options):
    rows = [(*map(int, p), float(d2[tuple(p)])) for p in np.argwhere(d2 > 0)]
    marks = spark.createDataFrame([(*p, m) for p, m in markers.items()], "z int, y int, x int, marker int")
    got = flood.flood(spark.createDataFrame(rows, VOXELS), marks, d2.shape, **options).collect()
    out = {(r["z"], r["y"], r["x"]): r["label"] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed,shape,share,levels,block,small", [(1, (6, 9, 10), 0.8, 5, 4, 10**6), (2, (1, 17, 19), 0.9, 3, 5, 0), (3, (7, 8, 9), 0.7, 40, 3, 0), (4, (5, 12, 12), 1.0, 1, 4, 10), (5, (9, 9, 9), 0.5, 9, 64, 0)])
def test_regions_equal_one_flood(spark, seed, shape, share, levels, block, small):
    d2, markers = volume(seed, shape, share, levels)
    assert run(spark, d2, markers, block=block, small=small) == by_edges(d2, markers)


def test_a_long_path_takes_no_more_rounds(spark):
    """One winding corridor through many cubes with its only marker at the end."""
    d2 = np.zeros((1, 21, 60))
    d2[0, ::2, :] = 1
    for k in range(1, 21, 2):
        d2[0, k, -1 if k % 4 == 1 else 0] = 1
    assert set(run(spark, d2, {(0, 20, 59): 7}, block=4).values()) == {7}
    assert len(run(spark, d2, {(0, 20, 59): 7}, block=4, small=0)) == int((d2 > 0).sum())


def test_edges_of_the_definition(spark):
    none = np.zeros((1, 3, 3))
    assert run(spark, none, {}) == {} and run(spark, none + 1, {}) == {}
    a = none.copy()
    a[0, 0, 0], a[0, 2, 2] = 4, 4
    assert run(spark, a, {(0, 0, 0): 3, (0, 1, 1): 5}) == {(0, 0, 0): 3}  # no marker reaches the other; one lies outside
    twice = spark.createDataFrame([(0, 0, 0, 9), (0, 0, 0, 2)], "z int, y int, x int, marker int")
    assert flood.flood(spark.createDataFrame([(0, 0, 0, 1.0)], VOXELS), twice, (1, 1, 1)).first()["label"] == 2


def test_blobs_split_at_their_neck(spark):
    mask = np.zeros((3, 20, 40))
    mask[:, 5:15, 2:18] = mask[:, 5:15, 22:38] = mask[:, 9:11, 18:22] = 1
    rows = [(*map(int, p), True) for p in np.argwhere(mask)]
    got = {(r["z"], r["y"], r["x"]): r["label"] for r in segment.watershed_split(None, spark.createDataFrame(rows, "z int, y int, x int, mask boolean"), (3, 20, 40), min_distance=5).collect()}
    assert len(got) == int(mask.sum()) and got[1, 10, 10] != got[1, 10, 30]
    assert not {got[p] for p in got if p[2] < 17} & {got[p] for p in got if p[2] >= 23}


@pytest.mark.parametrize("gap", [1, 3])
def test_peaks_in_rounds_and_in_one_task(spark, gap):
    d2 = np.random.default_rng(gap).integers(0, 6, (5, 20, 20))
    rows = spark.createDataFrame([(*map(int, p), float(d2[tuple(p)])) for p in np.argwhere(d2)], VOXELS)
    found = [sorted(tuple(r) for r in segment.peaks(rows, d2.shape, gap, small).collect()) for small in (0, 30, 10**6)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 3
    places = [r[:3] for r in found[0]]
    assert all(d2[p] == d2[tuple(slice(max(0, v - gap), v + gap + 1) for v in p)].max() for p in places)
    tops = [tuple(map(int, p)) for p in np.argwhere(d2) if d2[tuple(p)] == d2[tuple(slice(max(0, v - gap), v + gap + 1) for v in p)].max() and all(gap <= v < n - gap or n <= 2 * gap for v, n in zip(p, d2.shape))]
    assert all(p in places or any(max(abs(a - b) for a, b in zip(p, q)) <= gap for q in places) for p in tops)
    assert all(max(abs(a - b) for a, b in zip(p, q)) > gap for k, p in enumerate(places) for q in places[:k])
