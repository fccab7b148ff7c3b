"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut


#: Neighbours above which a node's edges are joined apart from the others.
MANY = 1000
#: Edges that one task holds (4 MB), whose components need no rounds.
SMALL = 250_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of at most SMALL edges: ends hang their roots on the smaller one, and paths are halved, until nothing changes."""
    held = pa.Table.from_batches(list(batches) or [pa.record_batch([pa.array([], pa.int64())] * 2, ["u", "v"])])
    nodes, at = np.unique(np.concatenate([held.column(k).to_numpy() for k in range(2)]), return_inverse=True)
    u, v = at[: len(held)], at[len(held) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if np.array_equal(a, b):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], ["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node on an edge; the component is its smallest node.

    Kiveris et al. 2014. A round costs two grouped minima and joins on the node,
    and rounds are logarithmic in practice. A node with many neighbours is never
    gathered: its minimum is aggregated in part before the shuffle and joined
    back to the edges. Nodes of more than MANY neighbours are few (a share of
    2 / MANY of the edges at most); their minima are a table of their own, which
    Spark broadcasts while it is small, and only the other edges are shuffled by
    their node. Each round's edges are written to the shared folder.
    At most SMALL edges are one task's. Loops and null ends are ignored; an empty table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    state = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(state)
    kinds = {kind for _, kind in state.dtypes}
    if mark[0] <= SMALL and kinds <= {"bigint", "int"}:
        kind = "bigint" if "bigint" in kinds else "int"
        found = state.select(*[F.col(c).cast("long") for c in ("u", "v")]).repartition(1).mapInArrow(_at_once, "node long, component long")
        return cut(found, "components").select(*[F.col(c).cast(kind) for c in ("node", "component")])
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select(F.col("u").alias("x"), F.least("u", "w").alias("m"), "n"), "least")
        hubs = cut(least.where(F.col("n") > MANY).select(F.col("x").alias("hub"), F.col("m").alias("hub_m")), "hubs")
        up = both.where("v > u").join(hubs, F.col("u") == F.col("hub"), "left")
        large = (up.where("hub IS NOT NULL").select(F.col("v").alias("u"), F.col("hub_m").alias("v"))
                 .unionByName(up.where("hub IS NULL").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        was, mark = mark, _mark(state)
        if mark == was:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
