"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes
of the text's word shingles. Two fingerprints with at most 3 differing bits
link; documents that chains of links join are one group.

Candidates come from the pigeonring principle: split the 64 bits in two halves,
of which one has at most half of the 3 differences, that is at most 1. Put the
half's 8 segments of 4 bits on a ring. With at most 1 difference over 8
segments, some segment starts a chain whose every prefix of l segments has at
most l/8 differences; for l up to 7 that is none, so 7 consecutive segments, 28
bits, agree. Each distinct fingerprint is therefore filed under 16 such chains
(2 halves, 8 starts), and only fingerprints that share a chain reach the full
Hamming check. No pair at 3 or fewer bits is lost.

Copies meet once: chains are filed for distinct fingerprints. A chain that holds
many fingerprints is cut into blocks and each pair of blocks is a work unit of
its own; a unit compares its fingerprints but emits no pairs, only a spanning
forest of its links, which joins the same groups.

Word edits that leave a Jaccard similarity of 0.8 change about 10 of the 64 bits,
far beyond any chain that could be looked up. With ``similarity`` set, groups also join texts of that
similarity: candidates then share one of their smallest shingle hashes, and the
pigeonring test and the Hamming check at the wide radius prune them. These two
are on a second fingerprint, of the different shingles, since the similarity too
is of sets: a line repeated many times moves the first fingerprint far away. A
short sketch of smallest hashes prunes further, so that only narrow rows are dealt to
the keys. The pairs that are left are confirmed on the whole sets, made again from
the texts of those pairs alone; texts with fewer shingles than the short sketch
holds are decided by it.

Defined cases: a null text is empty; texts without words have fingerprint zero
and link like any other; texts shorter than a shingle are one shingle; repeated
rows share a group; the smallest id ignores null ids, and is null in a group
without any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.graph import connected_components
from voxtable.scratch import cut

SEED = 42
BITS = 3
#: For a wished similarity: differing bits that candidates may have (more at 0.8 has a chance of 2e-7, in texts of
#: 4 or 5 shingles of 1e-5), smallest hashes that file a text, and smallest hashes that estimate the similarity where
#: texts are dealt out (a pair at 0.8 fails it with a chance of 3e-6) and where whole sets are at hand.
WIDE_BITS = 26
FILED = 6
SHORT = 16
SKETCH = 256
#: Standard errors below the similarity at which an estimate still leaves a pair to the exact check.
SLACK = 5
#: Chains of this many segments are tested by the pigeonring at the wide radius.
SEGMENTS = 16
#: Fingerprints of one chain that a block holds; bounds a task's memory and time.
BLOCK = 2048
#: The same of texts with their sketches that share a shingle hash.
UNIT = 1024
#: Rows (two numbers each) that are broadcast at most, about 8 MB; beyond them the join shuffles.
BROADCAST = 250_000
#: The row of a group that stays is the least: that of the smallest id, null last, and of rows of equal ids that of the least hash.
_FIRST = "min(struct(doc_id IS NULL AS none, CAST(doc_id AS LONG) AS id, row AS row)) AS first"


def shingle_hashes(text: str, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, in order, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    return np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits: 1 where more than half of the hashes have 1."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return majority(shingle_hashes(text, shingle, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(every column but the text, fp long): the fingerprint as signed 64 bits; no shuffle."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*rest).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in b.column(len(rest))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(fps.view(np.int64))], [*rest, "fp"])

    return docs.select(*rest, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _chain(half: int, start: int):
    """28 bits of 7 consecutive segments on the half's ring, with the chain's number."""
    word = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    left_out = (start + 7) % 8
    mask = 0xFFFFFFFF & ~(0xF << (4 * left_out))
    return F.shiftleft(F.lit(half * 8 + start).cast("long"), 32).bitwiseOR(word.bitwiseAND(F.lit(mask)))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chain, i, j): the links of each unit, as a spanning forest."""

    def unit(fps: np.ndarray, side: np.ndarray, same: bool) -> list[tuple[int, int]]:
        n = len(fps)
        if n == 2:
            return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= BITS and (same or side[0] != side[1]) else []
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for k in range(0, n, 256):
            near = np.bitwise_count(fps[k : k + 256, None] ^ fps[None, k:]) <= BITS
            for a, b in zip(*(x.tolist() for x in np.nonzero(near))):
                if b > a and (x := root(a + k)) != (y := root(b + k)):
                    parent[max(x, y)] = min(x, y)
                    out.append((a + k, b + k))
        return out

    def units(rows: list[np.ndarray], last: bool):
        chain, i, j, side, fp = rows
        edge = np.flatnonzero((chain[1:] != chain[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = [0, *edge.tolist(), len(chain)]
        found = []
        for a, b in zip(bounds[:-1], bounds[1:] if last else bounds[1:-1]):
            if b - a > 1:
                found += [(a + x, a + y) for x, y in unit(fp[a:b], side[a:b], i[a] == j[a])]
        return found, (len(chain) if last else bounds[-2])

    kept: list[np.ndarray] | None = None
    waiting: list[list[np.ndarray]] = []

    def flush(last: bool):
        nonlocal kept, waiting
        if not waiting:
            return None
        rows = [np.concatenate(c) for c in zip(*waiting)]
        found, end = units(rows, last)
        waiting = [[c[end:] for c in rows]] if end < len(rows[0]) else []
        fp = rows[4].view(np.int64)
        src, dst = ([fp[p[k]] for p in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if len(cols[0]):
            waiting.append([cols[0], cols[1], cols[2], cols[3], cols[4].view(np.uint64)])
            yield flush(False)
    if waiting:
        yield flush(True)


def crowded(filed: DataFrame, *keys: str) -> DataFrame:
    """``filed`` with n, the number of rows of its key, where that is more than one.

    Counts are aggregated in part before their shuffle and joined back from a
    written table, so the rows of a common key are never gathered in one task.
    """
    counts = cut(filed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "keys")
    return filed.join(counts, list(keys))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst): a subset of the links of distinct fingerprints ``fps`` (fp) that joins the same groups."""
    chains = F.array(*[_chain(h, s) for h in (0, 1) for s in range(8)])
    filed = crowded(fps.select("fp", F.explode(chains).alias("chain")), "chain")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    filed = filed.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = dealt.select("chain", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    return rows.repartition("chain", "i", "j").sortWithinPartitions("chain", "i", "j").mapInArrow(_forest, "src long, dst long")


def _describe(shingle: int):
    """Fingerprint, fingerprint of the different shingles, a hash of all words, the number of different shingles, and the sorted smallest shingle hashes of each text (FILED of them, and the heads of SHORT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, wide, words, sizes, filed, sketches = [], [], [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py() or "", shingle)
                fps.append(majority(h))
                words.append(hash_of(h))
                own = np.unique(h)
                wide.append(majority(own) if len(own) < len(h) else fps[-1])
                sizes.append(len(own))
                least = own[:SHORT].copy()  # not a view that keeps a long text's hashes
                filed.append(least[:FILED].view(np.int64))
                sketches.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))  # in the same order
            fp, wide, word = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, wide, words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp, wide, word, pa.array(sizes, pa.int64()), pa.array(filed, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int32()))], ["doc_id", "row", "fp", "wide", "node", "size", "filed", "sketch"])

    return run


def hash_of(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 7)


def chains_pass(x: np.ndarray, bits: int) -> np.ndarray:
    """The pigeonring test on differences ``x``: some segment starts chains of 1 to 4 segments within l * bits / SEGMENTS each."""
    width = 64 // SEGMENTS
    mask = np.uint64((1 << width) - 1)
    parts = np.stack([np.bitwise_count(x >> np.uint64(width * k) & mask) for k in range(SEGMENTS)])
    total, ok = np.zeros_like(parts, np.int16), np.ones(parts.shape, bool)
    for length in range(1, 5):
        total += np.roll(parts, 1 - length, axis=0)
        ok &= total * SEGMENTS <= length * bits
    return ok.any(axis=0)


def least_shared(filed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest hash that rows a and b of ``filed`` share; rows are filled up with their first hash."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for x in range(filed.shape[1]):
        for y in range(filed.shape[1]):
            v = filed[a, x]
            np.minimum(out, v, out=out, where=v == filed[b, y])
    return out


def similar_pairs(key: int, fps: np.ndarray, filed: np.ndarray, sketches: list[np.ndarray], similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure), a < b: pairs that pass the pigeonring, the Hamming check and the similarity of sketches of ``most`` hashes.

    A pair belongs to the smallest hash that files both, so that it is looked at
    once. The similarity of two sketches is that of the hashes up to the smaller
    end of the two; a sketch that holds all of a text's hashes has no end. Of two
    such texts that is the similarity itself, and the pair is sure; an estimate may
    fall short by SLACK standard errors, and its pair has still to be confirmed.
    """
    n = len(fps)
    found = [np.nonzero(np.triu(np.bitwise_count(fps[k : k + 256, None] ^ fps[None, k:]) <= WIDE_BITS, 1)) for k in range(0, n, 256)]  # a bounded part at a time
    a, b = (np.concatenate([(f[side] + 256 * k).astype(np.int32) for k, f in enumerate(found)]) for side in (0, 1))
    keep = np.concatenate([chains_pass(fps[a[k : k + 65536]] ^ fps[b[k : k + 65536]], WIDE_BITS) for k in range(0, len(a), 65536)]) if len(a) else np.empty(0, bool)
    a, b = a[keep], b[keep]
    own = least_shared(filed, a, b) == key
    a, b = a[own], b[own]
    if not len(a):
        return a, b, np.empty(0, bool)
    whole = np.array([len(s) < most for s in sketches])
    ends = np.array([np.iinfo(np.uint32).max if w else s[-1] for s, w in zip(sketches, whole)], np.uint32)
    upto = np.stack([np.searchsorted(s, ends, side="right") for s in sketches])
    common = np.zeros((n, n), np.float32)
    values, at, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sketches])
    shared = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[at]
    rows, column = rows[column >= 0], column[column >= 0]
    for k in range(0, len(shared), 4096):  # a bounded part of the hashes at a time
        inside = (column >= k) & (column < k + 4096)
        m = np.zeros((n, min(4096, len(shared) - k)), np.float32)
        m[rows[inside], column[inside] - k] = 1
        common += m @ m.T
    i = common[a, b]
    union = upto[a, b] + upto[b, a] - i
    sure = whole[a] & whole[b]
    slack = np.where(sure, 0.0, SLACK * (similarity * (1 - similarity) / most) ** 0.5)
    good = i >= (similarity - slack) * union - 1e-9
    return a[good], b[good], sure[good]


def confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, sure: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of those pairs a < b that are sure or whose whole sets of sorted hashes have the similarity."""
    label = np.arange(len(sets))
    out = []
    order = np.lexsort((b, a))
    a, b, sure = a[order], b[order], sure[order]
    bounds = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else []
    for start, end in zip(bounds[:-1], bounds[1:]):
        x, others = a[start], b[start:end]
        for y in others[sure[start:end]].tolist():
            if label[y] != label[x]:
                out.append((int(x), y))
                label[label == label[y]] = label[x]
        others = others[label[others] != label[x]]  # pairs that links already join need no check
        sizes = np.array([len(sets[y]) for y in others], np.int64)
        most = len(sets[x])
        near = np.minimum(sizes, most) >= similarity * np.maximum(sizes, most) - 1e-9
        for y in others[near].tolist():
            if label[y] == label[x]:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if common >= similarity * (most + len(sets[y]) - common) - 1e-9:
                out.append((int(x), y))
                label[label == label[y]] = label[x]
    return out


UNITS = "key long, band int, i int, j int"


def _alike(similarity: float):
    """Rows sorted by (key, band, i, j): each unit's sure links, joined to the first of their group, and with a null dst the texts of its pairs to confirm."""

    def unit(key: int, rows: list[tuple]) -> list[tuple]:
        nodes = [r[0] for r in rows]
        filed = np.array([np.resize(r[2], FILED) for r in rows])
        a, b, sure = similar_pairs(key, np.array([r[1] for r in rows], np.int64).view(np.uint64), filed, [r[3] for r in rows], similarity, SHORT)
        label = np.arange(len(nodes))
        while True:  # along the sure links to the first of each group
            low = label.copy()
            np.minimum.at(low, a[sure], label[b[sure]])
            np.minimum.at(low, b[sure], label[a[sure]])
            low = low[low]
            if (low == label).all():
                break
            label = low
        open_ = np.unique(np.concatenate([a[~sure], b[~sure]]))
        return [(nodes[k], nodes[r]) for k, r in enumerate(label.tolist()) if k != r] + [(nodes[k], None) for k in open_.tolist()]

    def of(b: pa.RecordBatch, k: int) -> tuple:
        return (b.column(4)[k].as_py(), b.column(5)[k].as_py(), b.column(6)[k].values.to_numpy(), b.column(7)[k].values.to_numpy().view(np.uint32))

    return _by_unit(unit, of)


def _confirm(similarity: float):
    """The same of the texts to confirm, with their whole sets: a forest of each unit's links. A longer sketch of the sets goes ahead, and decides texts that it holds whole."""

    def unit(key: int, rows: list[tuple]) -> list[tuple]:
        sets = [r[2] for r in rows]
        filed = np.array([np.resize(s[:FILED].view(np.int64), FILED) for s in sets])
        sketches = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32) for s in sets]
        a, b, sure = similar_pairs(key, np.array([r[1] for r in rows], np.int64).view(np.uint64), filed, sketches, similarity, SKETCH)
        return [(rows[x][0], rows[y][0]) for x, y in confirmed(sets, a, b, sure, similarity)]

    def of(b: pa.RecordBatch, k: int) -> tuple:
        return (b.column(4)[k].as_py(), b.column(5)[k].as_py(), b.column(6)[k].values.to_numpy().view(np.uint64))

    return _by_unit(unit, of)


def _by_unit(unit, of):
    """Applies ``unit`` to the key and the rows, read by ``of``, of each run of equal (key, band, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, found = None, [], []

        def done():
            if len(rows) > 1:
                found.extend((*own, *pair) for pair in unit(own[0], rows))

        def batch():
            cols = list(zip(*found)) or [()] * 6
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["key", "band", "i", "j", "src", "dst"])

        for b in batches:
            for k, unit_of in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                if unit_of != own:
                    done()
                    own, rows = unit_of, []
                rows.append(of(b, k))
            yield batch()
        done()
        yield batch()

    return run


def _sets(shingle: int):
    """The whole set of sorted shingle hashes of each text whose hash of all words is its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                nodes, fps, sets = [], [], []
                for node, fp, t in zip(*(b.column(c)[at : at + 500] for c in range(3))):
                    h = shingle_hashes(t.as_py() or "", shingle)
                    if hash_of(h) == node.as_py() & 0xFFFFFFFFFFFFFFFF:
                        nodes.append(node.as_py())
                        fps.append(fp.as_py())
                        sets.append(np.unique(h).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "wide", "shingles"])

    return run


def similar_links(texts: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(src, dst): links of ``texts`` (node, row, wide, size, filed, sketch) that join the groups of that similarity.

    ``rows`` (row, text) has each node's text under its row; only texts with pairs
    to confirm are turned into whole sets.

    A pair of similarity 0.8 shares one of its FILED smallest hashes but for a
    chance of 0.2 ** FILED. Texts of a key are compared in units of two blocks of
    UNIT texts. A key of more texts than a block is split by their sizes first:
    the sizes of a pair differ by a factor of 1 / similarity at most, so bands of
    that width hold each pair together if a text is filed in its own band and the
    next. Nothing is left out, however common the key is.
    """
    band = F.floor(F.ln("size") / F.lit(-1.0001 * math.log(similarity))).cast("int")  # a little wider, for rounding
    filed = crowded(texts.select("node", "size", F.explode("filed").alias("key")), "key")
    few = filed.where(F.col("n") <= UNIT).select("node", "key", F.lit(-1).alias("band"), "n")
    many = crowded(filed.where(F.col("n") > UNIT).select("node", "key", F.explode(F.array(band, band + 1)).alias("band")), "key", "band")
    filed = few.unionByName(many.select(*few.columns)).withColumn("m", F.ceil(F.col("n") / F.lit(UNIT)).cast("int"))
    filed = filed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    unit = ["key", "band", "i", "j"]

    def compared(members: DataFrame, about: DataFrame, run) -> DataFrame:
        units = members.join(about, "node").select(*unit, *about.columns).repartition(*unit).sortWithinPartitions(*unit)
        return units.mapInArrow(run, UNITS + ", src long, dst long")

    members = filed.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    found = cut(compared(members, texts.select("node", "wide", "filed", "sketch"), _alike(similarity)), "candidates")
    unsure = found.where("dst is null").select(*unit, F.col("src").alias("node"))
    wanted = cut(texts.join(unsure.select("node").distinct(), "node", "left_semi").select("row", "node", "wide"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted  # else a shuffle of all texts
    sets = rows.join(few, "row").dropDuplicates(["row"]).select("node", "wide", "text").mapInArrow(_sets(shingle), "node long, wide long, shingles array<long>")
    exact = compared(unsure, cut(sets, "sets"), _confirm(similarity))
    return found.where("dst is not null").select("src", "dst").unionByName(exact.select("src", "dst"))


def _row(doc_id: str, text: str):
    """A hash of a row's id and text: rows that agree in both are one document, rows of equal ids and different texts are two."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def _similar(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(rows, nodes, components, the nodes' column): groups by fingerprints within BITS bits or texts of that similarity."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", _row("doc_id", "text").alias("row"))
    table = cut(rows.mapInArrow(_describe(shingle), "doc_id long, row long, fp long, wide long, node long, size long, filed array<long>, sketch array<int>"), "sketches")
    texts = table.groupBy("node").agg(F.min("doc_id").alias("least"), F.expr(_FIRST), F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("wide").alias("wide"), F.first("size").alias("size"), F.first("filed").alias("filed"), F.first("sketch").alias("sketch"))
    texts = cut(texts, "texts")
    fps = texts.groupBy("fp").agg(F.min("node").alias("one"))
    close = links(fps.select("fp"))
    by_bits = (close.join(fps.select(F.col("fp").alias("src"), F.col("one").alias("a")), "src").join(fps.select(F.col("fp").alias("dst"), F.col("one").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
               .unionByName(texts.select("node", "fp").join(fps, "fp").where("node <> one").select(F.col("node").alias("src"), F.col("one").alias("dst"))))
    edges = cut(similar_links(texts, rows.select("row", "text"), shingle, similarity).unionByName(by_bits).distinct(), "links")
    return table.select("doc_id", "row", "fp", "node"), texts.select("node", "least", "first"), connected_components(edges), "node"


def _by_bits(docs: DataFrame, doc_id: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The same by fingerprints within BITS bits alone."""
    own = docs.select(F.col(doc_id).alias("doc_id"), _row(doc_id, text).alias("row"), F.col(text).alias("text"))
    table = cut(with_fingerprint(own, "text", shingle), "fingerprints")
    nodes = table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.expr(_FIRST))
    edges = cut(links(nodes.select("fp")).distinct(), "links")
    return table, nodes, connected_components(edges), "fp"


def _component(nodes: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """``nodes`` with c, their group; ``comps`` has linked nodes only."""
    return nodes.join(comps.select(F.col("node").alias("__node"), "component"), F.col(key) == F.col("__node"), "left").withColumn("c", F.coalesce("component", key)).drop("__node", "component")


def _named(table: DataFrame, nodes: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """(doc_id, fp, component_id): each row's group by the smallest id in it."""
    named = _component(nodes, comps, key)
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    member = named.join(smallest, "c").select(F.col(key).alias("__key"), "component_id")
    return table.join(member, F.col(key) == F.col("__key")).select("doc_id", "fp", "component_id")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest id of its group."""
    return _named(*_by_bits(docs, doc_id, text, shingle))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for each row: groups by fingerprints within BITS bits or texts of that similarity."""
    return _named(*_similar(docs, doc_id, text, shingle, similarity))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, a null one last.

    Groups are those of :func:`similar_groups`, or of :func:`groups` without a
    similarity. Rows are told apart by id and text, so different texts of one id, or
    without an id, are documents of their own; of rows that agree in both one stays.
    """
    _, nodes, comps, key = _by_bits(docs, doc_id, text, shingle) if similarity is None else _similar(docs, doc_id, text, shingle, similarity)
    first = _component(nodes, comps, key).groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    # Joined by the row's hash alone, so that its partitions serve the rows of equal hash too.
    kept = docs.withColumn("__own", _row(doc_id, text)).join(first, F.col("__own") == F.col("__row"), "left_semi")
    return kept.dropDuplicates(["__own", doc_id]).drop("__own")
