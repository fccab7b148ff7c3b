"""Marker-controlled watershed as a spanning forest of the voxels' face graph.

An edge between two face neighbours is as high as the lower of its ends, then as
the higher one, then by its place, so that no two edges are alike. Flooding
from the markers downwards takes edges in that order and joins what they connect unless
both sides have a marker; the result is the one greatest spanning forest rooted in
the markers (Cousty et al. 2009), whatever the order of work. So work can be
parallel: the highest edge of any part without a marker belongs to the forest.

First each cube of the volume contracts what it can on its own: a part joins along its
highest edge as long as that edge stays inside. What is left is a graph of basins,
whose edges are the highest between each two, at the faces of the cubes and inside.
Its basins are joined in rounds of the same kind, which at least halve those without a
marker, until the graph is small enough for one task. The volume is written twice, however
long the paths of the flood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.model import COORDS
from voxtable.scratch import cut

#: Edge of the cubes that are flooded on their own.
BLOCK = 64
#: Edges of basins that one task joins.
SMALL = 1_000_000
EDGES = "a long, b long, am int, bm int, lo double, hi double, tie long"
#: What a cube returns: its voxels with their basin and marker (0: none), edges of its basins, and the basins of its lower faces.
PARTS = "kind int, z int, y int, x int, comp long, marker int, other long, lo double, hi double, tie long"
VOXEL, INNER, CROSSING, FACE = range(4)


def contract(n: int, rooted: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray, leaves: np.ndarray, leaves_rank: np.ndarray) -> np.ndarray:
    """The part of each of ``n`` nodes once no part without a root has its highest edge inside.

    ``rank`` orders all edges, inner ones (a, b) and those of ``leaves`` that lead outside.
    Rooted parts do not choose an edge; ``rooted`` is updated for the parts' first nodes.
    """
    comp = np.arange(n)
    while True:
        ca, cb = comp[a], comp[b]
        live = ca != cb
        a, b, rank, ca, cb = a[live], b[live], rank[live], ca[live], cb[live]
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, ca, rank)
        np.maximum.at(best, cb, rank)
        np.maximum.at(best, comp[leaves], leaves_rank)
        parent = np.arange(n)
        for own, to in ((ca, cb), (cb, ca)):
            chosen = (rank == best[own]) & ~rooted[own]
            parent[own[chosen]] = to[chosen]
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        if (parent == np.arange(n)).all():
            return comp
        while (parent != (up := parent[parent])).any():
            parent = up
        comp = parent[comp]


def _ranks(lo: np.ndarray, hi: np.ndarray, tie: np.ndarray) -> np.ndarray:
    out = np.empty(len(lo), np.int64)
    out[np.lexsort((-tie, hi, lo))] = np.arange(len(lo))
    return out


def _highest(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The edge of the highest rank between each two nodes."""
    u, v = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((-rank, v, u))
    first = np.ones(len(order), bool)
    first[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    return order[first]


def _cube(block: int, height: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y, x = (pdf[c].to_numpy(np.int64) for c in COORDS)
        raster = (z * height + y) * width + x
        order = np.argsort(raster)
        z, y, x, raster = z[order], y[order], x[order], raster[order]
        d2, marker, inner = (pdf[c].to_numpy()[order] for c in ("d2", "marker", "own"))
        found = []
        for axis, step, inside in ((0, height * width, True), (1, width, y < height - 1), (2, 1, x < width - 1)):
            at = np.minimum(np.searchsorted(raster, raster + step), len(raster) - 1)
            hit = np.flatnonzero((raster[at] == raster + step) & inside & (inner | inner[at]))
            found.append((hit, at[hit], raster[hit] * 3 + axis))
        a, b, tie = (np.concatenate(c) for c in zip(*found))
        lo, hi = np.minimum(d2[a], d2[b]), np.maximum(d2[a], d2[b])
        rank = _ranks(lo, hi, tie)
        within = inner[a] & inner[b]
        leaves = np.where(inner[a], a, b)[~within]
        comp = contract(len(raster), marker > 0, a[within], b[within], rank[within], leaves, rank[~within])
        label = marker[comp]
        voxels = pd.DataFrame({"kind": VOXEL, "z": z, "y": y, "x": x, "comp": raster[comp], "marker": label})[inner]
        between = within & (comp[a] != comp[b]) & ((label[a] == 0) | (label[b] == 0))
        k = np.flatnonzero(between)
        k = k[_highest(comp[a[k]], comp[b[k]], rank[k])]
        edges = pd.DataFrame({"kind": INNER, "comp": raster[comp[a[k]]], "marker": label[a[k]], "z": label[b[k]], "other": raster[comp[b[k]]], "lo": lo[k], "hi": hi[k], "tie": tie[k]})
        out = np.flatnonzero(~within & inner[a])  # each crossing edge from its lower end's cube
        crossing = pd.DataFrame({"kind": CROSSING, "comp": raster[comp[a[out]]], "marker": label[a[out]], "other": raster[b[out]], "lo": lo[out], "hi": hi[out], "tie": tie[out]})
        low = inner & ((z % block == 0) | (y % block == 0) | (x % block == 0))
        faces = pd.DataFrame({"kind": FACE, "comp": raster[comp[low]], "marker": label[low], "other": raster[low]})
        parts = pd.concat([voxels, edges, crossing, faces], ignore_index=True)
        return parts.reindex(columns=[f.split()[0] for f in PARTS.split(", ")]).astype({c: "Int32" for c in ("z", "y", "x")} | {c: "Int64" for c in ("other", "tie")})

    return run


def _one_task(batches):
    """All edges of basins at once: (node, top, marker)."""
    pdf = pd.concat(list(batches), ignore_index=True)
    if not len(pdf):
        return
    nodes, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    marker = np.zeros(len(nodes), np.int64)
    marker[at[:, 0]], marker[at[:, 1]] = pdf["am"], pdf["bm"]
    none = np.empty(0, np.int64)
    comp = contract(len(nodes), marker > 0, at[:, 0], at[:, 1], _ranks(*(pdf[c].to_numpy() for c in ("lo", "hi", "tie"))), none, none)
    yield pd.DataFrame({"node": nodes, "top": nodes[comp], "marker": marker[comp].astype(np.int32)})


def _simplified(edges: DataFrame) -> DataFrame:
    """Without loops and edges between two markers, and with the highest edge between each two basins."""
    live = edges.where("a <> b AND (am = 0 OR bm = 0)")
    flip = F.col("a") > F.col("b")
    pair = [F.when(flip, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("a", "b"), ("am", "bm"))] + [F.when(flip, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("b", "a"), ("bm", "am"))]
    return live.select(*pair, F.struct("lo", "hi", (-F.col("tie")).alias("tie")).alias("key")).groupBy("a", "b", "am", "bm").agg(F.max("key").alias("key")).select("a", "b", "am", "bm", "key.lo", "key.hi", (-F.col("key.tie")).alias("tie"))


def _round(edges: DataFrame) -> DataFrame:
    """(node, top, marker): each basin without a marker joined along its highest edge, chains followed to their ends."""
    both = edges.select("a", "am", "b", "bm", F.struct("lo", "hi", (-F.col("tie")).alias("tie")).alias("key"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("bm").alias("am"), F.col("a").alias("b"), F.col("am").alias("bm"), "key"))
    picked = both.where("am = 0").groupBy("a").agg(F.max(F.struct("key", "b", "bm")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("top"), F.col("m.bm").alias("marker"))
    picked = cut(picked, "picked")
    back = picked.select(F.col("node").alias("__n"), F.col("top").alias("__t"))
    # Of two basins that choose each other the first stays.
    ways = picked.join(back, (F.col("top") == F.col("__n")) & (F.col("node") == F.col("__t")), "left").where("__n IS NULL OR node > top").select("node", "top", "marker")
    ways = cut(ways, "ways")
    while True:
        ahead = ways.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("marker").alias("__m"))
        step = ways.join(ahead, F.col("top") == F.col("__n"), "left")
        if not step.where("__n IS NOT NULL").limit(1).count():
            return ways
        ways = cut(step.select("node", F.coalesce("__t", "top").alias("top"), F.coalesce("__m", "marker").alias("marker")), "ways")


def flood(distance: DataFrame, markers: DataFrame, shape: tuple[int, int, int], *, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(z, y, x, label): each voxel of ``distance`` (z, y, x, d2) with the marker (z, y, x, marker > 0) whose flood reaches it.

    Parts that no marker reaches are left out. Voxels with several markers take the
    first; markers outside the voxels are ignored; an empty table gives an empty result.
    """
    height, width = int(shape[1]), int(shape[2])
    at = list(COORDS)
    marks = markers.groupBy(*at).agg(F.min("marker").cast("int").alias("marker"))
    rows = distance.select(*[F.col(c).cast("int").alias(c) for c in at], F.col("d2").cast("double").alias("d2")).join(marks, at, "left").withColumn("marker", F.coalesce("marker", F.lit(0)))
    # A voxel belongs to its cube and, as a neighbour, to those behind the faces that it lies on.
    homes = [F.struct(*[F.lit(0).alias("s" + c) for c in at])]
    for c in at:
        for side, place in ((-1, 0), (1, block - 1)):
            homes.append(F.when(F.pmod(c, F.lit(block)) == place, F.struct(*[F.lit(side if n == c else 0).alias("s" + n) for n in at])))
    dealt = rows.withColumn("h", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull())))
    own = (F.col("h.sz") == 0) & (F.col("h.sy") == 0) & (F.col("h.sx") == 0)
    dealt = dealt.select(*at, "d2", "marker", own.alias("own"), *[(F.floor(F.col(c) / block) + F.col(f"h.s{c}")).cast("int").alias("b" + c) for c in at])
    parts = cut(dealt.groupBy(*["b" + c for c in at]).applyInPandas(_cube(block, height, width), PARTS), "basins")

    faces = parts.where(F.col("kind") == FACE).select(F.col("other").alias("__voxel"), F.col("comp").alias("b"), F.col("marker").alias("bm"))
    crossing = parts.where(F.col("kind") == CROSSING).join(faces, F.col("other") == F.col("__voxel")).select(F.col("comp").alias("a"), "b", F.col("marker").alias("am"), "bm", "lo", "hi", "tie")
    inner = parts.where(F.col("kind") == INNER).select(F.col("comp").alias("a"), F.col("other").alias("b"), F.col("marker").alias("am"), F.col("z").alias("bm"), "lo", "hi", "tie")
    edges = cut(_simplified(crossing.unionByName(inner)), "edges")
    tops: DataFrame | None = None

    def composed(new: DataFrame) -> DataFrame:
        if tops is None:
            return new
        after = new.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("marker").alias("__m"))
        moved = tops.join(after, F.col("top") == F.col("__n"), "left").select("node", F.coalesce("__t", "top").alias("top"), F.coalesce("__m", "marker").alias("marker"))
        return moved.unionByName(new.join(tops.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti"))

    while True:
        n = edges.count()
        if n <= small:
            if n:
                tops = cut(composed(edges.repartition(1).mapInPandas(_one_task, "node long, top long, marker int")), "tops")
            break
        new = _round(edges)
        tops = cut(composed(new), "tops")
        for u, m in (("a", "am"), ("b", "bm")):
            to = new.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("marker").alias("__m"))
            edges = edges.join(to, F.col(u) == F.col("__n"), "left").withColumns({u: F.coalesce("__t", u), m: F.coalesce("__m", m)}).drop("__n", "__t", "__m")
        edges = cut(_simplified(edges), "edges")
    voxels = parts.where(F.col("kind") == VOXEL).select(*at, "comp", "marker")
    if tops is None:
        return voxels.where("marker > 0").select(*at, F.col("marker").alias("label"))
    named = tops.select(F.col("node").alias("__n"), F.col("marker").alias("__m"))
    return voxels.join(named, F.col("comp") == F.col("__n"), "left").select(*at, F.coalesce("__m", "marker").alias("label")).where("label > 0")
