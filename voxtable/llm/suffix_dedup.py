"""Repeated passages by a depth-limited radix sort of suffixes.

Only the first ``threshold`` bytes of a suffix count, so the suffixes of a text
are its windows of that many bytes, and two are equal when all digit passes put
them in one group. A pass over all windows would cost a row for every byte.
Instead windows travel in runs, most significant digit first:

* The first digit is the window's anchor: the place of its smallest hash of a
  64-byte gram, leftmost on ties. It depends on the window's bytes alone, so
  equal windows have it at the same distance d. Consecutive windows with one
  anchor form a run, about 1 for each 170 bytes.
* In a pass with cells of S distances, a run is cut at multiples of S. The digit
  is the hash of the bytes that all windows of the whole cell have in common
  (``threshold`` - S + 1 of them), with d. Cells alone in their group are unique
  and drop out. Cells whose rows also agree on all bytes that their windows
  cover are repeated as a whole. Only groups that disagree go to the next pass.
* The passes have S = 64, 8 and 1. In the last the digit is the whole window, so
  its equal groups are exactly the repeated windows.

Groups are counted by partial aggregation and joined back to their rows, so a
passage that a third of all documents share is never gathered; Spark splits
such a join's hot partitions. Hashes of runs have 64 bits over random bytes'
weights; with the first digit two runs are compared by over 100 bits.

Defined cases: a null text is empty; texts shorter than the threshold keep
everything; repeated rows are separate documents, so each is repeated as a
whole; rows are told apart by a number of their own, whatever their ids, which may
be null or equal; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.scratch import cut

THRESHOLD = 400
GRAM = 64
PASSES = (64, 8, 1)
#: Windows that are hashed at a time.
SEGMENT = 1 << 20
#: Row numbers that are broadcast at most (about 8 MB); more are joined by a shuffle.
BROADCAST_ROWS = 250_000

MULTIPLIER = 0x9E3779B97F4A7C15
CELLS = "key long, sup long, row long, p int, n int, d int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse modulo 2 ** 64, for i to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


#: A random 64-bit weight for each byte value.
WEIGHTS = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)


class Spans:
    """Hashes of any spans of a byte string, by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(WEIGHTS[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by running minima of blocks from both ends."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored_runs(spans: Spans, m: int, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, distance of the anchor from the first) of the runs of a string of ``m`` bytes."""
    at = np.arange(m - gram + 1)
    grams = (_mix((spans.sums[gram:] - spans.sums[: m - gram + 1]) * spans.down[: m - gram + 1]) & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    anchor = (_sliding_min(grams, threshold - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    return first, np.diff(np.append(first, len(anchor))), anchor[first] - first


def cells(spans: Spans, p: np.ndarray, n: np.ndarray, d: np.ndarray, size: int, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, sup, p, n, d) of the runs' cells of ``size`` distances."""
    low = d - n + 1
    count = d // size - low // size + 1
    run = np.repeat(np.arange(len(p)), count)
    k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    anchor, c = (p + d)[run], (low // size)[run] + k
    d1, d2 = np.maximum(low[run], c * size), np.minimum(d[run], c * size + size - 1)
    core = spans(anchor - c * size, anchor - np.minimum(c * size + size - 1, threshold - gram) + threshold)
    whole = spans(anchor - d2, anchor - d1 + threshold)
    key = _mix(core + (c * size + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sup = _mix(whole + (d1 * 1024 + d2 + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return key.view(np.int64), sup.view(np.int64), anchor - d2, d2 - d1 + 1, d2


def _batch(rows, parts: list[tuple[int, tuple]]) -> pa.RecordBatch:
    which = np.concatenate([np.full(len(c[0]), i, np.int64) for i, c in parts]) if parts else np.empty(0, np.int64)
    cols = [np.concatenate([c[k] for _, c in parts]) if parts else np.empty(0, np.int64) for k in range(5)]
    take = pa.array(which)
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), rows.take(take), *[pa.array(c.astype(np.int32)) for c in cols[2:]]], ["key", "sup", "row", "p", "n", "d"])


def _first_pass(threshold: int, gram: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for i, t in enumerate(b.column(1)):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                for s in range(0, len(data) - threshold + 1, SEGMENT):
                    x = data[s : s + SEGMENT + threshold - 1]
                    spans = Spans(x)
                    key, sup, p, n, d = cells(spans, *anchored_runs(spans, len(x), threshold, gram), size, threshold, gram)
                    parts.append((i, (key, sup, p + s, n, d)))
                    held += len(key)
                    if held > 200_000:
                        yield _batch(b.column(0), parts)
                        parts, held = [], 0
            yield _batch(b.column(0), parts)

    return run


def _next_pass(threshold: int, gram: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for i, (t, runs) in enumerate(zip(b.column(1), b.column(2))):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                own = runs.values
                p, n, d = (own.field(k).to_numpy().astype(np.int64) for k in range(3))
                order = np.argsort(p, kind="stable")
                p, n, d = p[order], n[order], d[order]
                a = 0
                while a < len(p):  # runs within a segment at a time
                    e = int(np.searchsorted(p, p[a] + SEGMENT))
                    s = int(p[a])
                    end = int((p[a:e] + n[a:e]).max()) + threshold
                    key, sup, q, m, dd = cells(Spans(data[s:end]), p[a:e] - s, n[a:e], d[a:e], size, threshold, gram)
                    parts.append((i, (key, sup, q + s, m, dd)))
                    held += len(key)
                    a = e
                    if held > 200_000:
                        yield _batch(b.column(0), parts)
                        parts, held = [], 0
            yield _batch(b.column(0), parts)

    return run


def _with_lists(bodies: DataFrame, lists: DataFrame) -> DataFrame:
    """``bodies`` (row, body, ...) of the rows that ``lists`` (row, ...), a written table, has, with its columns.

    The row numbers go ahead as a filter where they are few, so that other texts are not shuffled.
    """
    if lists.count() <= BROADCAST_ROWS:
        bodies = bodies.join(F.broadcast(lists.select("row")), "row", "left_semi")
    return bodies.join(lists, "row")


def bodies_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, body), written once, so that each row keeps its number."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("body")), "bodies", "zstd")


def repeated_runs(bodies: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(row, p, n): runs of n windows from p on that occur elsewhere too, for the rows of :func:`bodies_of`."""
    bodies = bodies.select("row", "body")
    found: list[DataFrame] = []
    todo: DataFrame | None = None
    for size in PASSES:
        if todo is None:
            rows = bodies.where(F.length("body") >= threshold).mapInArrow(_first_pass(threshold, gram, size), CELLS)
        else:
            lists = cut(todo.groupBy("row").agg(F.collect_list(F.struct("p", "n", "d")).alias("runs")), "lists")  # of one text
            rows = cut(_with_lists(bodies, lists).select("row", "body", "runs").mapInArrow(_next_pass(threshold, gram, size), CELLS), "cells")
        groups = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("sup").alias("a"), F.max("sup").alias("b")).where("rows > 1")
        # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
        groups = cut(groups.select("key", (F.col("a") == F.col("b")).alias("same")), "groups")
        kept = cut(rows.join(groups, "key"), "repeats")
        found.append(kept.where("same").select("row", "p", "n"))
        if size == 1:
            break
        mixed = kept.where("NOT same")
        classes = cut(mixed.groupBy("key", "sup").agg(F.count("*").alias("rows"), F.min(F.struct("row", "p", "n", "d")).alias("one")), "classes")
        found.append(mixed.join(classes.where("rows > 1").select("key", "sup"), ["key", "sup"]).select("row", "p", "n"))
        todo = classes.select("one.*")  # one of each class meets the others in the next pass
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


RESULT = T.StructType().add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept_sha256", T.StringType()).add("kept", T.BinaryType())


def _remove(threshold: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, runs in zip(b.column(1), b.column(2)):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                p, n = (runs.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                steps = np.bincount(p, minlength=len(data) + 1) - np.bincount(p + n - 1 + threshold, minlength=len(data) + 1)
                gone = np.cumsum(steps[: len(data)]) > 0
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], ["doc_id", *RESULT.names])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs``.

    ``kept`` are the bytes that no repeated string covers (null unless
    ``with_kept``); removal can split a character, so they are bytes.
    """
    bodies = bodies_of(docs, doc_id, text)
    runs = repeated_runs(bodies, threshold, gram)
    lists = cut(runs.groupBy("row").agg(F.collect_list(F.struct("p", "n")).alias("runs")), "runs")
    hit = _with_lists(bodies, lists).select("doc_id", "body", "runs")
    changed = hit.mapInArrow(_remove(threshold, with_kept), T.StructType([bodies.schema["doc_id"], *RESULT.fields]))
    rows = lists.select("row")
    other = bodies.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", "left_anti")
    same = other.select("doc_id", F.length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), (F.col("body") if with_kept else F.lit(None).cast("binary")).alias("kept"))
    return changed.unionByName(same)
