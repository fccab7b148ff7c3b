"""t-SNE of any number of rows (object_id, features): sparse affinities, repulsion by a grid.

Affinities come from the exact neighbour graph, three times the perplexity to a row
(van der Maaten 2014). In each iteration joins and a grouped sum give the attraction
along the graph's edges, and repulsion is interpolated (Linderman et al. 2019): rows spread
their charges over the nodes of a grid, the grid's sums, of bounded size, are convolved
with the kernel by FFT, and rows read their forces from the grid. A few rows are embedded
as a dense matrix instead.

While the places of all rows are a few megabytes, they are broadcast in each iteration, and tasks
with the links of some rows each return these rows' attraction: one job without a shuffle, beside which
the driver transforms the grid. Of more rows an iteration is a join and a write of the layout.

Sums are of whole numbers, scaled to the largest that they can be, so that their order does
not show: one seed, one result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxtable.operators.neighbours import nearest, numbered
from voxtable.scratch import cut, forget

#: Rows up to which forces are those of all pairs, as a matrix.
DENSE = 500
#: Rows up to which their places are broadcast (16 MB for two axes), and rows whose links are a task's, at least.
PLACES, SHARE = 1_000_000, 1000
#: Most boxes of the grid on an axis, by number of axes; a box has 3 nodes on an axis.
BOXES = {1: 10_000, 2: 300, 3: 30}
#: Iterations with exaggerated affinities, and their factor.
EARLY, EXAGGERATION = 100, 12.0


def _bandwidths(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares of each row's neighbours, of the wished perplexity, by halving on the precision."""
    d2 = d2 - d2.min(axis=1, keepdims=True)
    target, m = math.log(perplexity), len(d2)
    low, high, beta = np.zeros(m), np.full(m, np.inf), np.ones(m)
    for _ in range(60):
        e = np.exp(-d2 * beta[:, None])
        total = e.sum(axis=1)
        wide = np.log(total) + beta * (d2 * e).sum(axis=1) / total > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    e = np.exp(-d2 * beta[:, None])
    return e / e.sum(axis=1, keepdims=True)


def affinities(points: DataFrame, perplexity: float, n: int) -> DataFrame:
    """(u, v, p): shares of the links of each of ``points`` (node, w, features), in both directions; they sum to 1."""
    perplexity = max(1.01, min(perplexity, (n - 1) / 3))
    lists = nearest(points, max(1, min(n - 1, int(3 * perplexity)))).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = _bandwidths(np.array(pdf["d"].tolist(), float), perplexity)
                yield pd.DataFrame({"node": pdf["node"], "other": pdf["other"], "p": p.tolist()})

    near = lists.select("node", F.col("l.d").alias("d"), F.col("l.other").alias("other")).mapInPandas(run, "node long, other array<long>, p array<double>")
    near = near.select(F.col("node").alias("u"), F.explode(F.arrays_zip("other", "p")).alias("x")).select("u", F.col("x.other").alias("v"), F.col("x.p").alias("p"))
    return near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "p")).groupBy("u", "v").agg((F.sum("p") / (2 * n)).alias("p"))


def _fast(n: int) -> int:
    """The least number from n on without prime factors above 5, of which transforms are fast."""
    while True:
        left = n
        for p in (2, 3, 5):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n += 1


@functools.lru_cache(maxsize=1)
def _spectra(nodes: tuple[int, ...], step: tuple[float, ...]) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """The transforms' sizes, and the kernels' spectra: 1 / (1 + d^2) (real), and on each axis d_i (1 + d^2)^-2 (imaginary parts)."""
    size = [_fast(2 * m - 1) for m in nodes]
    signed = [np.where(np.arange(k) < m, np.arange(k), np.arange(k) - k) * h for k, m, h in zip(size, nodes, step)]
    offsets = np.meshgrid(*signed, indexing="ij", sparse=True)
    kernel = 1 / (1 + sum(o * o for o in offsets))
    return size, np.fft.rfftn(kernel).real, [np.fft.rfftn(o * kernel**2).imag for o in offsets]


class Grid:
    """Boxes over the range of a layout, half a unit wide unless there would be more than BOXES or fewer than 30, with 3 nodes an axis in each.

    Other widths are of a scale with 16 steps to an octave, and numbers of boxes above 30
    are multiples of 10, so that the kernels' spectra last for many iterations.
    """

    def __init__(self, low: list[float], high: list[float]):
        d = len(low)
        self.low, spans = np.array(low), [max(b - a, 1e-9) for a, b in zip(low, high)]
        widths = [0.5 if 15 <= s <= BOXES[d] / 2 else 2.0 ** (math.ceil(16 * math.log2(s / (30 if s < 15 else BOXES[d]))) / 16) for s in spans]
        self.boxes = np.array([max(30, min(BOXES[d], 10 * math.ceil(math.ceil(s / w) / 10))) for s, w in zip(spans, widths)])
        self.step = np.array(widths) / 3
        self.nodes = tuple((3 * self.boxes).tolist())

    def _corners(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """(weight, node) of every row, for each node of its box."""
        at = (y - self.low) / self.step
        box = np.minimum((at / 3).astype(int), self.boxes - 1).clip(0)
        t = at - 3 * box - 0.5
        weights = np.stack([(t - 1) * (t - 2) / 2, t * (2 - t), t * (t - 1) / 2])
        for js in itertools.product(range(3), repeat=y.shape[1]):
            yield np.prod([weights[j, :, i] for i, j in enumerate(js)], axis=0), tuple(3 * box[:, i] + j for i, j in enumerate(js))

    def _unit(self, n: int) -> float:
        return 2.0 ** math.floor(60 - math.log2(2.0 ** len(self.nodes) * max(n, 1)))

    def _sent(self, y: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """The nodes to which rows send their weights, and these, in whole numbers of 1 / ``unit``."""
        weights, nodes = zip(*self._corners(y))
        return np.concatenate([np.ravel_multi_index(node, self.nodes) for node in nodes]), np.rint(np.concatenate(weights) * unit).astype(np.int64)

    def charges_of(self, y: np.ndarray) -> np.ndarray:
        """What :meth:`charges` tells of a table, for rows at hand."""
        unit = self._unit(len(y))
        out = np.zeros(int(np.prod(self.nodes)), np.int64)
        np.add.at(out, *self._sent(y, unit))
        return (out / unit).reshape(self.nodes)

    def charges(self, state: DataFrame, ys: list[str], n: int) -> np.ndarray:
        """Sums of the rows' weights at each node."""
        unit = self._unit(n)
        held = state.sparkSession.sparkContext.broadcast(self)

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grid = held.value
            for pdf in batches:
                cells, sent = grid._sent(pdf[ys].to_numpy(float), unit)
                cells, at = np.unique(cells, return_inverse=True)
                sums = np.zeros(len(cells), np.int64)
                np.add.at(sums, at, sent)
                yield pd.DataFrame({"cell": cells, "q": sums})

        sums = state.select(*ys).mapInPandas(spread, "cell long, q long")
        got = sums.groupBy("cell").agg(F.sum("q").alias("q")).toPandas()  # the grid's nodes at most
        out = np.zeros(int(np.prod(self.nodes)))
        out[got["cell"].to_numpy()] = got["q"].to_numpy() / unit
        return out.reshape(self.nodes)

    def potentials(self, charges: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums of the charges times d (1 + d^2)^-2 at each node, for each axis, and the sum of 1 / (1 + d^2) over all pairs of rows, equal ones included."""
        size, near, pushes = _spectra(self.nodes, tuple(self.step.tolist()))
        spectrum = np.fft.rfftn(charges, size, range(charges.ndim))
        power = (spectrum.real**2 + spectrum.imag**2) * near
        twice = power[..., 1 : (size[-1] + 1) // 2].sum()  # half of a real table's spectrum mirrors the other
        forces = np.empty((len(pushes), *self.nodes))
        for force, push in zip(forces, pushes):
            s = spectrum * (1j * push)
            for axis, m in enumerate(self.nodes[:-1]):
                s = np.fft.ifft(s, axis=axis)[(slice(None),) * axis + (slice(m),)]
            force[:] = np.fft.irfft(s, size[-1])[..., : self.nodes[-1]]
        return forces, float((power.sum() + twice) / np.prod(size))

    def repulsion(self, y: np.ndarray, forces: np.ndarray) -> np.ndarray:
        """Sums over all rows of (y - other) (1 + d^2)^-2, read from the grid."""
        got = np.zeros((len(forces), len(y)))
        for w, node in self._corners(y):
            got += w * forces[(slice(None), *node)]
        return got.T


def attraction(edges: DataFrame, state: DataFrame, ys: list[str], n: int, unit: float) -> DataFrame:
    """(__u, a0, ...): sums over each row's links of n p (y - other) / (1 + d^2), in whole numbers of 1 / ``unit``."""
    ends = lambda side: state.select(F.col("node").alias("__" + side), *[F.col(y).alias(side + y) for y in ys])
    both = edges.join(ends("v"), F.col("v") == F.col("__v")).join(ends("u"), F.col("u") == F.col("__u"))
    d2 = sum(((F.col("u" + y) - F.col("v" + y)) * (F.col("u" + y) - F.col("v" + y)) for y in ys), F.lit(0.0))
    pull = F.col("p") * float(n) / (1 + d2)
    return both.groupBy("__u").agg(*[F.sum(F.round(pull * (F.col("u" + y) - F.col("v" + y)) * unit).cast("long")).alias(f"a{i}") for i, y in enumerate(ys)])


def _step(y: np.ndarray, step: np.ndarray, gains: np.ndarray, grad: np.ndarray, t: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gains = np.where(np.sign(grad) == np.sign(step), gains * 0.8, gains + 0.2).clip(0.01)
    step = (0.5 if t < EARLY else 0.8) * step - max(10.0, n / EXAGGERATION) * gains * grad
    return y + step, step, gains


def _pull_unit(grid: Grid, n: int, heaviest: float) -> float:
    span = float((grid.step * grid.nodes).max())
    return 16.0 ** math.floor((60 - math.log2(max(n * heaviest * span, 1e-300))) / 4)  # seldom another, since it is part of generated code


def _by_places(start: DataFrame, edges: DataFrame, ys: list[str], n: int, heaviest: float, iterations: int) -> DataFrame:
    """(node, y0, ...) after all iterations from the places ``start``, which the driver keeps: PLACES rows at most."""
    context, d = start.sparkSession.sparkContext, len(ys)
    got = start.orderBy("node").toArrow()
    nodes, y = got.column(0).to_numpy(), np.stack([got.column(1 + i).to_numpy() for i in range(d)], axis=1)
    numbers = context.broadcast(nodes)

    def numbered_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, other = (np.searchsorted(numbers.value, c.to_numpy()).astype(np.int32) for c in (b.column(0), b.column(1).flatten()))
            offsets = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (pa.array(other), b.column(2).flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(at), *lists], ["at", "other", "p"])

    lists = edges.groupBy("u").agg(F.collect_list(F.struct("v", "p")).alias("l")).select("u", "l.v", "l.p")
    links = lists.repartition(max(1, min(context.defaultParallelism, -(-n // SHARE)))).mapInArrow(numbered_links, "at int, other array<int>, p array<double>").persist()

    def pulled(held, unit: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y, at, sizes = held.value, b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
                apart = y[np.repeat(at, sizes)] - y[b.column(1).flatten().to_numpy()]
                pull = (b.column(2).flatten().to_numpy() * float(n) / (1 + (apart * apart).sum(axis=1)))[:, None] * apart
                sums, ends = np.concatenate([np.zeros((1, d), np.int64), np.cumsum(np.rint(pull * unit).astype(np.int64), axis=0)]), np.cumsum(sizes)
                sums = sums[ends] - sums[ends - sizes]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sums[:, i]) for i in range(d))], ["at", *[f"a{i}" for i in range(d)]])

        return run

    step, gains = np.zeros_like(y), np.ones_like(y)
    with ThreadPoolExecutor(1) as aside:
        for t in range(iterations):
            grid = Grid(y.min(axis=0).tolist(), y.max(axis=0).tolist())
            field = aside.submit(lambda grid=grid, y=y: grid.potentials(grid.charges_of(y)))
            unit, held = _pull_unit(grid, n, heaviest), context.broadcast(y)
            got = links.mapInArrow(pulled(held, unit), ", ".join(["at int", *[f"a{i} long" for i in range(d)]])).toArrow()
            pull = np.zeros((n, d), np.int64)
            pull[got.column(0).to_numpy()] = np.stack([got.column(1 + i).to_numpy() for i in range(d)], axis=1)
            held.unpersist()
            forces, pairs = field.result()
            grad = 4 * ((EXAGGERATION if t < EARLY else 1.0) * pull / unit / n - grid.repulsion(y, forces) / max(pairs - n, 1e-12))
            y, step, gains = _step(y, step, gains, grad, t, n)
    links.unpersist()
    return start.sparkSession.createDataFrame(pa.table({"node": nodes} | {c: y[:, i] for i, c in enumerate(ys)}))


def _by_grid(points: DataFrame, n_components: int, perplexity: float, seed: int, n: int, iterations: int, places: int = PLACES) -> DataFrame:
    """(node, c0, ...) by broadcast places for at most ``places`` rows; by rounds for more: each writes the layout, and the one before it is deleted."""
    if n_components not in BOXES:
        raise ValueError(f"a grid of {n_components} axes is not supported, only of 1 to 3")
    axes = range(n_components)
    ys, steps, gains = ([f"{k}{i}" for i in axes] for k in "ysg")
    edges = cut(affinities(points, perplexity, n), "affinities")
    heaviest = edges.groupBy("u").agg(F.sum("p").alias("p")).agg(F.max("p")).first()[0] or 0.0
    uniform = lambda i, j: (F.shiftrightunsigned(F.xxhash64("node", F.lit(seed), F.lit(i), F.lit(j)), 11) + 1) / float(2**53 + 1)
    normal = [F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)) * 1e-4 for i in axes]
    state = points.select("node", *[c.alias(y) for c, y in zip(normal, ys)], *[F.lit(0.0).alias(s) for s in steps], *[F.lit(1.0).alias(g) for g in gains])
    columns = ["node", *ys, *steps, *gains]
    if n <= places:
        placed = _by_places(state.select("node", *ys), edges, ys, n, heaviest, iterations)
        forget(edges)
        return placed.select("node", *[F.col(y).alias(f"c{i}") for i, y in enumerate(ys)])
    old = None
    for t in range(iterations + 1):
        seen = Observation()
        state = cut(state.observe(seen, *[f(y).alias(f"{k}_{y}") for y in ys for k, f in (("low", F.min), ("high", F.max))]), "layout")
        if old is not None:
            forget(old)
        old = state
        if t == iterations:
            break
        ends = seen.get
        grid = Grid([ends[f"low_{y}"] for y in ys], [ends[f"high_{y}"] for y in ys])
        forces, pairs = grid.potentials(grid.charges(state, ys, n))
        unit = _pull_unit(grid, n, heaviest)
        held = points.sparkSession.sparkContext.broadcast((grid, forces))

        def move(batches: Iterator[pd.DataFrame], held=held, total=max(pairs - n, 1e-12), unit=unit, t=t) -> Iterator[pd.DataFrame]:
            grid, forces = held.value
            for pdf in batches:
                y, step, gain, pull = (pdf[c].to_numpy(float) for c in (ys, steps, gains, [f"a{i}" for i in axes]))
                grad = 4 * ((EXAGGERATION if t < EARLY else 1.0) * pull / unit / n - grid.repulsion(y, forces) / total)
                new = _step(y, step, gain, grad, t, n)
                yield pd.concat([pdf[["node"]].reset_index(drop=True), pd.DataFrame(np.concatenate(new, axis=1), columns=columns[1:])], axis=1)

        pulled = attraction(edges, state, ys, n, unit)
        rows = state.join(pulled, F.col("node") == F.col("__u"), "left").select(*columns, *[F.coalesce(f"a{i}", F.lit(0).cast("long")).alias(f"a{i}") for i in axes])
        state = rows.mapInPandas(move, ", ".join(["node long", *[f"{c} double" for c in columns[1:]]]))
    forget(edges)
    return state.select("node", *[F.col(y).alias(f"c{i}") for i, y in enumerate(ys)])


def _by_pairs(points: DataFrame, n_components: int, perplexity: float, seed: int, n: int, iterations: int) -> DataFrame:
    """(node, c0, ...) of at most DENSE rows as one matrix (van der Maaten and Hinton 2008)."""
    got = points.orderBy("node").select("node", "features").collect()
    x = np.array([r["features"] for r in got], float)
    others = ~np.eye(n, dtype=bool)
    p = np.zeros((n, n))
    if n > 1:
        d2 = np.stack([((x - row) ** 2).sum(1) for row in x])
        p[others] = _bandwidths(d2[others].reshape(n, n - 1), max(1.01, min(perplexity, (n - 1) / 3))).ravel()
    p = np.maximum((p + p.T) / max(1, 2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, n_components))
    step, gains = np.zeros_like(y), np.ones_like(y)
    for t in range(iterations if n else 0):
        apart = y[:, None] - y[None]
        q = 1 / (1 + (apart**2).sum(-1))
        np.fill_diagonal(q, 0)
        grad = 4 * (((p * (EXAGGERATION if t < EARLY else 1) - np.maximum(q / max(q.sum(), 1e-12), 1e-12)) * q)[:, :, None] * apart).sum(1)
        y, step, gains = _step(y, step, gains, grad, t, n)
        y = y - y.mean(0)
    return points.sparkSession.createDataFrame([(r["node"], *map(float, v)) for r, v in zip(got, y)], ", ".join(["node long", *[f"c{i} double" for i in range(n_components)]]))


def tsne(data: DataFrame, n_components: int = 2, *, perplexity: float = 30.0, seed: int | None = None, dense: int = DENSE, iterations: int = 300) -> DataFrame:
    """(object_id, c0, ...): t-SNE of all rows; one seed, one result. Rows of equal ids lie in one place.

    At most ``dense`` rows are embedded by the forces of all pairs; more, in 1 to 3
    dimensions, by the neighbour graph and a grid.
    """
    numbers, points = numbered(data)
    n = points.count()
    placed = (_by_pairs if n <= max(dense, 2) else _by_grid)(points, n_components, perplexity, seed or 0, n, iterations)
    return data.select("object_id").join(numbers, "object_id").join(placed, "node").select("object_id", *[f"c{i}" for i in range(n_components)])
