"""Best-fit packing with bounds that certify each partition's bin count.

Texts become token ids, each document ends with id 2, and documents longer than
a sequence are cut into full pieces after a first, possibly shorter, piece. Full
pieces are sequences of their own. The others are dealt to partitions by a hash;
each partition packs its pieces by best-fit decreasing and computes a lower
bound on the number of bins that any packing of them needs, the largest over a
family of dual-feasible functions. A partition whose count equals its bound is
certified. From the others the worst-filled bins are opened again, their
documents are exchanged between partitions by another hash and packed anew; the
new packing is taken when it needs fewer bins in total.

Defined cases: a null text is empty and gives one piece that holds only id 2;
strings of the vocabulary's added tokens are those tokens, as in its JSON file;
repeated rows are separate documents and each is packed; an empty table gives an
empty result; ties in length are broken by id, piece and row; rows are dealt by a
number of their own, so that a share of null or equal ids makes no task large.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs; bounds its memory.
PER_TASK = 40_000


def encoder(path: str | None = None):
    """text -> token ids by the merges of the byte-level vocabulary; strings of added tokens are ordinary text here.

    ``path`` is the vocabulary as ranks; they are the ids of the JSON file of
    the same vocabulary (tests compare the two), and encoding by them is three
    times as fast.
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = sys.__dict__.setdefault("_voxtable_encoders", {})  # once for each Python worker
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path].encode_ordinary


def token_ids(path: str | None = None):
    """text -> token ids as the JSON file of the vocabulary gives them: its added tokens are ids of their own, the rest is encoded by :func:`encoder`.

    The JSON file stands beside the ranks of ``path``, under the same name.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = encoder(path)
    kept = sys.__dict__.setdefault("_voxtable_added", {})
    if path not in kept:
        with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens are read only where their strings stand as they are")
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        kept[path] = {t["content"]: t["id"] for t in added}, re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
    ids, pattern = kept[path]

    def run(text: str) -> list[int]:
        if pattern is None or not pattern.search(text):
            return encode(text)
        out: list[int] = []
        for k, part in enumerate(pattern.split(text)):
            if k % 2:
                out.append(ids[part])
            else:
                out += encode(part)
        return out

    return run


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(t.as_py() or "") + [END_ID], dtype="<u4")
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item, and each bin's free room. ``lengths`` are in decreasing order."""
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has exactly r free
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        where[i], at[i] = b, capacity - room
        free[b] = left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return where, at, free


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of the dual-feasible functions: u(k), k to 20, and the threshold functions U(a), a to half the capacity."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    for a in range(1, capacity // 2 + 1):
        # above capacity - a: 1; from a to capacity - a: its share; below a: 0
        large = count[-1] - count[capacity - a + 1]
        middle = total[capacity - a + 1] - total[a]
        best = max(best, int(large) - (-int(middle) // capacity))
    return best


def _pack(capacity: int, round_: int):
    """Packs the partition; its worst bins are marked open if its count exceeds its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # narrow rows, about PER_TASK of them
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        where, at, free = best_fit_decreasing(t["length"].to_numpy(), capacity)
        bound = lower_bound(t["length"].to_numpy(), capacity)
        gap = len(free) - bound
        room = np.array(free)
        opened = np.zeros(len(free), bool)
        if gap > 0:  # the emptiest bins, until they hold several times the room that the gap wastes
            worst = np.argsort(-room, kind="stable")
            take = int(np.searchsorted(np.cumsum(room[worst]), 4 * gap * capacity)) + 1
            opened[worst[:take]] = room[worst[:take]] > 0
        base = (round_ << 56) + (TaskContext.get().partitionId() << 28)
        for name, values in (("sequence_id", base + where), ("offset", at), ("open", opened[where]), ("gap", np.where(np.arange(len(where)) == 0, gap, 0))):
            t = t.append_column(name, pa.array(values))
        yield from t.to_batches(max_chunksize=10_000)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, rounds: int = 2) -> DataFrame:
    """``items`` (as of :func:`pieces`) with sequence_id and offset.

    Runs a job for the first packing and up to ``rounds`` exchanges; their
    results are narrow tables in the shared folder. Only counts reach the driver.
    """
    columns = items.columns
    items = cut(items.withColumn("row", F.monotonically_increasing_id()), "pieces")  # so that rows of equal or null ids are dealt apart
    full = items.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    full = full.select(*columns, "sequence_id", "offset")
    schema = PIECES + ", row long, sequence_id long, offset long, open boolean, gap long"

    def packed(rows: DataFrame, n: int, k: int) -> DataFrame:
        parts = max(1, -(-n // per_task))
        dealt = rows.repartition(parts, F.xxhash64(F.lit(k), "row"))
        return cut(dealt.mapInArrow(_pack(capacity, k), schema), "packed")

    short = items.where(F.col("length") < capacity)
    done, state = [full], packed(short, short.count(), 0)
    for k in range(1, rounds + 1):
        s = state.agg(F.sum("gap").alias("gap"), F.count_if("open").alias("n"), F.count_distinct(F.when(F.col("open"), F.col("sequence_id"))).alias("bins")).first()
        if not s["gap"] or not s["n"]:
            break
        fresh = packed(state.where("open").select(*columns, "row"), s["n"], k)
        if fresh.select("sequence_id").distinct().count() >= s["bins"]:
            break
        done.append(state.where(~F.col("open")).select(*columns, "sequence_id", "offset"))
        state = fresh
    out = state.select(*columns, "sequence_id", "offset")
    for d in done:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and place there."""
    return pack(pieces(docs, doc_id, text, capacity, tokenizer), capacity)
