"""Class maps, and a small 3D network trained by gradients summed in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_map(labels: DataFrame, classes: DataFrame, *, max_label: int | None = None) -> DataFrame:
    """``labels`` with ``class_id`` in place of the label, 0 where ``classes`` (object_id, class_id[, position]) has none.

    Of several rows of one id the one with the largest ``position`` counts. With
    ``max_label`` an id outside 1..max_label raises IndexError. The table of
    objects is joined as small or large as it is.
    """
    if max_label is not None and (odd := classes.where((F.col("object_id") < 0) | (F.col("object_id") > max_label)).limit(1).collect()):
        raise IndexError(f"object id {odd[0]['object_id']} is not in 0..{max_label}")
    place = F.col("position") if "position" in classes.columns else F.lit(0)
    one = classes.groupBy(F.col("object_id").alias("__id")).agg(F.max_by("class_id", F.struct(place.alias("p"), F.col("class_id").alias("c"))).alias("class_id"))
    rest = [c for c in labels.columns if c not in ("label", "class_id")]
    return labels.drop("class_id").join(one, F.col("label") == F.col("__id"), "left").select(*rest, F.coalesce("class_id", F.lit(0)).cast("int").alias("class_id"))


def pair_up(object_ids: list[int], class_labels: list[int], spark) -> DataFrame:
    """Two lists as a class table; later pairs win."""
    if len(object_ids) != len(class_labels):
        raise ValueError(f"shape mismatch: {len(object_ids)} ids and {len(class_labels)} classes")
    return spark.createDataFrame([(int(a), int(b), k) for k, (a, b) in enumerate(zip(object_ids, class_labels))], "object_id long, class_id int, position int")


class Cell3DClassifier:
    """Two 3x3x3 convolutions of 8 and 16 channels with a pooling between, a global mean and a linear layer."""

    def __init__(self, n_classes: int, *, in_channels: int = 1, seed: int = 0):
        rng = np.random.default_rng(seed)
        he = lambda *shape: rng.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)
        self.n_classes, self.in_channels = n_classes, in_channels
        self.weights = [he(8, in_channels * 27), np.zeros(8), he(16, 8 * 27), np.zeros(16), he(n_classes, 16), np.zeros(n_classes)]


def _patches(x: np.ndarray) -> np.ndarray:
    """(N, C, D, H, W) -> (N, D, H, W, C * 27) with a border of zeros."""
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1), (1, 1)))
    v = np.lib.stride_tricks.sliding_window_view(p, (3, 3, 3), axis=(2, 3, 4))
    return v.transpose(0, 2, 3, 4, 1, 5, 6, 7).reshape(*x.shape[:1], *x.shape[2:], -1)


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple:
    w1, b1, w2, b2, w3, b3 = weights
    p1 = _patches(x)
    a1 = np.maximum(p1 @ w1.T + b1, 0)
    n, d, h, w, c = a1.shape
    even = a1[:, : d // 2 * 2, : h // 2 * 2, : w // 2 * 2].reshape(n, d // 2, 2, h // 2, 2, w // 2, 2, c)
    pooled = even.max(axis=(2, 4, 6))
    p2 = _patches(pooled.transpose(0, 4, 1, 2, 3))
    a2 = np.maximum(p2 @ w2.T + b2, 0)
    mean = a2.mean(axis=(1, 2, 3))
    return p1, a1, even, pooled, p2, a2, mean, mean @ w3.T + b3


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Sums over the crops of the gradients and of the cross-entropy."""
    w1, b1, w2, b2, w3, b3 = weights
    p1, a1, even, pooled, p2, a2, mean, logits = _forward(weights, x)
    e = np.exp(logits - logits.max(1, keepdims=True))
    prob = e / e.sum(1, keepdims=True)
    loss = float(-np.log(prob[np.arange(len(y)), y] + 1e-300).sum())
    g = prob
    g[np.arange(len(y)), y] -= 1
    out3 = [g.T @ mean, g.sum(0)]
    ga2 = (g @ w3)[:, None, None, None] / np.prod(a2.shape[1:4]) * (a2 > 0)
    out2 = [np.einsum("ndhwo,ndhwk->ok", ga2, p2), ga2.sum((0, 1, 2, 3))]
    gp2 = (ga2 @ w2).reshape(*ga2.shape[:4], 8, 3, 3, 3)
    n, d, h, w = ga2.shape[:4]
    gpool = np.zeros((n, d + 2, h + 2, w + 2, 8))
    for i in range(3):
        for j in range(3):
            for k in range(3):
                gpool[:, i : i + d, j : j + h, k : k + w] += gp2[..., i, j, k]
    gpool = gpool[:, 1:-1, 1:-1, 1:-1]
    hit = even == pooled[:, :, None, :, None, :, None]
    geven = hit * gpool[:, :, None, :, None, :, None] / hit.sum(axis=(2, 4, 6), keepdims=True)
    ga1 = np.zeros_like(a1)
    ga1[:, : 2 * d, : 2 * h, : 2 * w] = geven.reshape(n, 2 * d, 2 * h, 2 * w, 8)
    ga1 *= a1 > 0
    return [np.einsum("ndhwo,ndhwk->ok", ga1, p1), ga1.sum((0, 1, 2, 3)), *out2, *out3], loss


def _dense(pdf: pd.DataFrame, channels: int) -> np.ndarray:
    d, h, w = (int(pdf[c].iloc[0]) for c in "dhw")
    return np.array(pdf["crop"].tolist(), float).reshape(len(pdf), channels, d, h, w)


def train_classifier(model: Cell3DClassifier, crops: DataFrame, *, epochs: int = 20, lr: float = 1e-3) -> list[float]:
    """Adam on the whole table of crops (object_id, d, h, w, crop, class_id); returns each epoch's mean loss.

    An epoch is one job: tasks add up gradients over their batches, Spark adds
    the tasks' up, and one vector of the weights' size reaches the driver.
    """
    shapes = [w.shape for w in model.weights]
    rows = crops.select("d", "h", "w", "crop", "class_id").cache()
    m, v, losses = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], []
    try:
        for t in range(1, epochs + 1):
            weights = model.weights

            def run(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
                total, n = np.zeros(sum(w.size for w in weights) + 1), 0
                for pdf in batches:
                    for a in range(0, len(pdf), 64):
                        part = pdf.iloc[a : a + 64]
                        g, loss = gradients(weights, _dense(part, model.in_channels), part["class_id"].to_numpy(np.int64))
                        total += np.concatenate([*[x.ravel() for x in g], [loss]])
                        n += len(part)
                yield pd.DataFrame({"at": np.arange(len(total)), "g": total, "n": n})

            got = rows.mapInPandas(run, "at int, g double, n long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).orderBy("at").collect()
            flat, n = np.array([r["g"] for r in got]), max(1, got[0]["n"])
            losses.append(flat[-1] / n)
            at, new = 0, []
            for k, (w, s) in enumerate(zip(model.weights, shapes)):
                g = flat[at : at + w.size].reshape(s) / n
                at += w.size
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                new.append(w - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
            model.weights = new
    finally:
        rows.unpersist()
    return losses


def outputs(model: Cell3DClassifier, crops: DataFrame) -> DataFrame:
    """(object_id, outputs array<double>): the network's output for each class; weights travel with the task."""
    weights, channels = model.weights, model.in_channels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_forward(weights, _dense(pdf.iloc[a : a + 64], channels))[-1] for a in range(0, len(pdf), 64)]
            yield pd.DataFrame({"object_id": pdf["object_id"], "outputs": [row.tolist() for part in out for row in part]})

    kind = crops.schema["object_id"].dataType.simpleString()
    return crops.select("object_id", "d", "h", "w", "crop").mapInPandas(run, f"object_id {kind}, outputs array<double>")


def predict(model: Cell3DClassifier, crops: DataFrame) -> DataFrame:
    """(object_id, class_id): the class of the largest output, the first of ties."""
    return outputs(model, crops).select("object_id", (F.array_position("outputs", F.array_max("outputs")) - 1).cast("int").alias("class_id"))


def crops_around(labels: DataFrame, intensity: DataFrame, side: int) -> DataFrame:
    """(object_id, d, h, w, crop): the cube of ``side`` voxels around each object's centre, zeros where there is none."""
    centre = labels.where("label <> 0").groupBy("label").agg(*[F.round(F.avg(c)).cast("int").alias("o" + c) for c in "zyx"])
    cells = centre.select("label", *["o" + c for c in "zyx"], F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1))).alias("at"))
    half = side // 2
    offset = {"z": F.floor(F.col("at") / side**2), "y": F.floor(F.col("at") / side) % side, "x": F.col("at") % side}
    cells = cells.select("label", "at", *[(F.col("o" + c) + offset[c] - half).cast("int").alias(c) for c in "zyx"])
    filled = cells.join(intensity.select("z", "y", "x", "value"), ["z", "y", "x"], "left")
    rows = filled.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("c"))
    return rows.select(F.col("label").cast("long").alias("object_id"), *[F.lit(side).alias(c) for c in "dhw"], F.transform("c", lambda e: e["v"].cast("float")).alias("crop"))
