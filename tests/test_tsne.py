"""t-SNE by neighbour graph and grid against the matrix of all pairs."""

import numpy as np
import pytest

from voxtable.operators import reduce, tsne

ROWS = 40


def points_of(spark, x):
    return spark.createDataFrame([(i, 1.0, list(map(float, r))) for i, r in enumerate(x)], "node long, w double, features array<double>")


def shares(x, perplexity):
    """Symmetric affinities of all pairs, each row's bandwidth found by a plain search."""
    n = len(x)
    p = np.zeros((n, n))
    for i in range(n):
        d2 = np.delete(((x - x[i]) ** 2).sum(1), i)
        low, high = 1e-9, 1e9
        for _ in range(200):
            beta = np.sqrt(low * high)
            e = np.exp(-(d2 - d2.min()) * beta)
            e /= e.sum()
            if -(e * np.log(e + 1e-300)).sum() > np.log(perplexity):
                low = beta
            else:
                high = beta
        p[i, np.arange(n) != i] = e
    return (p + p.T) / (2 * n)


def test_affinities(spark):
    x = np.random.default_rng(0).normal(size=(ROWS, 5))
    got = np.zeros((ROWS, ROWS))
    for r in tsne.affinities(points_of(spark, x), 30.0, ROWS).collect():
        got[r["u"], r["v"]] = r["p"]
    assert np.abs(got - shares(x, (ROWS - 1) / 3)).max() < 1e-6 and abs(got.sum() - 1) < 1e-9


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_repulsion(spark, axes):
    y = np.random.default_rng(axes).normal(0, 4, (200, axes))
    ys = [f"y{i}" for i in range(axes)]
    state = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], ", ".join(["node long", *[f"{c} double" for c in ys]]))
    grid = tsne.Grid(y.min(axis=0).tolist(), y.max(axis=0).tolist())
    forces, pairs = grid.potentials(grid.charges(state, ys, len(y)))
    apart = y[:, None] - y[None]
    q = 1 / (1 + (apart**2).sum(-1))
    true = (q[:, :, None] ** 2 * apart).sum(1)
    assert np.linalg.norm(grid.repulsion(y, forces) - true) < 0.02 * np.linalg.norm(true) and abs(pairs - q.sum()) < 0.01 * q.sum()


def test_grid_follows_the_matrix(spark):
    """The layouts of both after some iterations from one start, where the graph holds all pairs."""
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.3, (ROWS // 2, 4)) for c in (0, 3)])
    points, rounds = points_of(spark, x), 12
    layout = lambda k: np.array([r[1:] for r in tsne._by_grid(points, 2, 30.0, 7, ROWS, k).orderBy("node").collect()])
    y, p = layout(0), shares(x, (ROWS - 1) / 3)
    assert 0.5e-4 < y.std() < 2e-4
    step, gains = np.zeros_like(y), np.ones_like(y)
    for t in range(rounds):
        apart = y[:, None] - y[None]
        q = 1 / (1 + (apart**2).sum(-1))
        np.fill_diagonal(q, 0)
        grad = 4 * (((12 * p - q / q.sum()) * q)[:, :, None] * apart).sum(1)
        gains = np.where(np.sign(grad) == np.sign(step), gains * 0.8, gains + 0.2).clip(0.01)
        step = 0.5 * step - 10 * gains * grad
        y = y + step
    got = layout(rounds)
    assert np.linalg.norm(got - y) < 0.02 * np.linalg.norm(y) and (got == layout(rounds)).all()


def test_small_and_odd_tables(spark):
    schema = "object_id string, features array<double>"
    for rows in ([], [("a", [1.0])], [("a", [1.0]), ("b", [1.0])], [("a", [1.0]), ("a", [1.0]), ("b", [2.0])]):
        for dense in (0, 500):
            got = reduce.tsne(spark.createDataFrame(rows, schema), 2, dense=dense, iterations=2).collect()
            assert sorted(r[0] for r in got) == [r[0] for r in rows] and np.isfinite(np.array([r[1:] for r in got], float)).all()
    with pytest.raises(ValueError):
        reduce.tsne(spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [4.0])], schema), 4, dense=0)


def test_an_iteration_is_one_job(spark):
    """Two jobs an iteration, a join, a write and a grid's sums, took over seven minutes for 300 on 10,256 rows."""
    points = points_of(spark, np.random.default_rng(2).normal(size=(ROWS, 4)))

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"tsne-{rounds}", "")
        tsne._by_grid(points, 2, 30.0, 7, ROWS, rounds)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tsne-{rounds}"))

    try:
        assert jobs(12) - jobs(4) == 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_places_and_joins_agree(spark):
    points = points_of(spark, np.random.default_rng(3).normal(size=(ROWS, 4)))
    told, joined = (np.array(sorted(tsne._by_grid(points, 2, 10.0, 7, ROWS, 2, places=k).collect())) for k in (ROWS, 0))
    assert np.abs(told - joined).max() <= 1e-9 * np.abs(joined).max()


def test_places_of_six_hundred_thousand_rows_are_broadcast():
    """An iteration is one job for all tables up to that size, and what is broadcast stays at 16 MB for two axes."""
    from voxtable.operators import tsne

    assert 615_384 <= tsne.PLACES <= 1_000_000
