"""Ranked lexical search by the Best Position Algorithm.

A term's impact on a document is w * (1e9 tf div (1000 tf + 12 m)), with m from
the document's length; a document's score for an item is the sum over the
item's terms. Documents are dealt with in blocks, each with its own impact
lists: of each term of the queries, the block's documents by descending impact,
and an index by (term, document) for direct access. An item reads its lists in
parallel. Each document met is looked up in all of them at once, which gives
its whole score and marks its position in every list as seen. A list's best
position is the end of its contiguous run of seen positions. No document unseen
so far can score more than the sum of the impacts at the best positions (0 for
a list seen to its end), a bound that direct accesses to later positions tighten
beyond that of the positions read last. Reading stops when the bound is strictly
below the k-th score, so that equal scores are never missed. The k best of a
task's earlier blocks count for its later ones, and a task returns only them;
tasks meet in two rounds of ranking by item.

Two passes over the documents: the first writes a row for each, with its number
of terms and its counts of the queries' terms, from which document frequencies
and totals are aggregated; the second reads those rows. Neither shuffles
documents. Queries are the side of a stated size: they are taken in blocks of
QUERIES items, so that a task and the driver hold one block's terms.

Defined cases: a null text has no terms, and a document without any counts
neither for N nor for L; an item without terms, or without a document that
scores above 0, returns nothing; items of equal ids are items of their own;
repeated documents are ranked each; equal scores go by doc_id, a null one last;
an empty table of either kind gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.scratch import cut

#: Results of an item.
BEST = 20
#: Items whose terms the driver and a task hold at a time.
QUERIES = 4096
#: Postings of a block of documents, and documents of one; they bound a task's memory.
POSTINGS = 1 << 20
DOCUMENTS = 1 << 15
#: Positions of each list read in the first step; each step reads twice as many as the one before, MOST at most.
FIRST, MOST = 4, 256
RESULT = "item_id long, item int, doc_id long, score long"

#: ASCII letters in lower case and digits, everything else in ASCII a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.binary()):
        yield t.as_py() or b""


def profiles(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms and its counts of those in ``vocabulary``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded, whatever the texts' lengths
                part = b.slice(at, 256)
                sizes, ids, tfs = [], [], []
                for t in _texts(part.column(1)):
                    words = terms(t)
                    counts = Counter(words)
                    own = counts.keys() & known
                    sizes.append(len(words))
                    ids.append([vocabulary[w] for w in own])
                    tfs.append([counts[w] for w in own])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Lists:
    """The impact lists of a block of documents and their direct access."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weights: np.ndarray):
        self.n_docs = len(m)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        ends = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.start, self.length = ends[:-1], np.diff(ends)
        key = term[order].astype(np.int64) * self.n_docs + self.doc
        self.at = np.argsort(key)
        self.key = key[self.at]

    def direct(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where each of ``doc`` is in the list of each of ``term``, counted over all lists; -1 where it is not."""
        wanted = term[:, None].astype(np.int64) * self.n_docs + doc
        k = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[k] == wanted, self.at[k], -1)


class Best:
    """The k best (score, id) met so far, ids that are null last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, none: np.ndarray, ident: np.ndarray) -> None:
        good = score >= max(self.kth(), 1)
        if good.any():
            score, none, ident = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.none, none), (self.id, ident)))
            first = np.lexsort((ident, none, -score))[: self.k]
            self.score, self.none, self.id = score[first], none[first], ident[first]

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0


def best_positions(lists: Lists, term: np.ndarray, times: np.ndarray, best: Best, none: np.ndarray, ident: np.ndarray) -> int:
    """Reads the lists of one item's terms until no unseen document can be among the best; returns the documents looked up."""
    held = lists.length[term] > 0
    term, times = term[held], times[held]
    if not len(term):
        return 0
    start, length = lists.start[term], lists.length[term]
    base = np.concatenate([[0], np.cumsum(length)[:-1]])  # of the seen marks, one for each position
    seen = np.zeros(int(length.sum()), bool)
    met = np.zeros(lists.n_docs, bool)
    through = np.zeros(len(term), np.int64)  # best position: so many positions from the first are seen
    read, step = 0, FIRST
    while True:
        found = np.concatenate([lists.doc[s + read : s + min(read + step, n)] for s, n in zip(start.tolist(), length.tolist())])
        new = np.unique(found[~met[found]])
        read, step = read + step, min(2 * step, MOST)
        if len(new):
            met[new] = True
            where = lists.direct(term, new)
            there = where >= 0
            best.add((np.where(there, lists.impact[where], 0) * times[:, None]).sum(0), none[new], ident[new])
            seen[((where - start[:, None]) + base[:, None])[there]] = True
        bound = 0
        for k, (b, n) in enumerate(zip(base.tolist(), length.tolist())):
            t = int(through[k])
            if t < n:
                rest = seen[b + t : b + n]
                t += int(rest.argmin()) if not rest.all() else n - t
                through[k] = t
            if t < n:  # the first positions have been read, so t is not 0
                bound += int(times[k]) * int(lists.impact[start[k] + t - 1])
        if bound < best.kth() or (through == length).all():
            return int(met.sum())


def _search(items: list[tuple[int | None, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The k best of each item over the documents of a task."""
    wanted = [(np.array(t, np.int64), np.array(c, np.int64)) for _, t, c in items]

    def blocks(batches: Iterator[pa.RecordBatch]):
        waiting, postings, rows = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                waiting.append(part)
                postings, rows = postings + len(part.column(2).flatten()), rows + part.num_rows
                if postings >= POSTINGS or rows >= DOCUMENTS:
                    yield pa.Table.from_batches(waiting).combine_chunks()
                    waiting, postings, rows = [], 0, 0
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for table in blocks(batches):
            ids, n, own, tfs = (table.column(c).combine_chunks() for c in range(4))
            if not len(flat := own.flatten()):
                continue
            doc = np.repeat(np.arange(len(n)), own.value_lengths().to_numpy(zero_copy_only=False))
            m = 100 - 25 + (25 * n.to_numpy() * n_docs) // n_terms
            lists = Lists(doc, flat.to_numpy(), tfs.flatten().to_numpy(), m, weights)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ident = ids.fill_null(0).to_numpy()
            for b, (term, times) in zip(best, wanted):
                best_positions(lists, term, times, b, none, ident)
        for i, b in enumerate(best):
            if len(b.score):
                many = len(b.score)
                yield pa.RecordBatch.from_arrays([pa.array([items[i][0]] * many, pa.int64()), pa.array([i] * many, pa.int32()), pa.array(b.id, pa.int64(), mask=b.none), pa.array(b.score)], ["item_id", "item", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of each item, first among its rows of a slice and then among the slices' best."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", "slice").orderBy(*order)
    few = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: list, k: int, doc_id: str, text: str) -> DataFrame:
    counts = [(i, Counter(terms((t or "").encode("utf-8", "surrogatepass")))) for i, t in items]
    vocabulary = {w: x for x, w in enumerate(sorted({w for _, c in counts for w in c}))}
    rows = cut(profiles(docs, vocabulary, doc_id, text).where("n > 0"), "profiles")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    df = dict(map(tuple, rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))  # the block's terms at most
    weights = np.array([weight(n_docs, df.get(x, 0)) for x in range(len(vocabulary))], np.int64)
    asked = [(i, own := [vocabulary[w] for w in c if weights[vocabulary[w]] > 0 and vocabulary[w] in df], [c[w] for w in c if vocabulary[w] in own]) for i, c in counts]
    found = rows.where(F.size("terms") > 0).mapInArrow(_search(asked, weights, n_docs, n_terms, k), RESULT)
    return cut(_ranked(found, k), "ranked")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above score 0 of each row of ``queries``."""
    asked = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).toLocalIterator()
    out = None
    while items := [tuple(r) for r in itertools.islice(asked, QUERIES)]:
        found = _block(docs, items, k, doc_id, text)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
own AS (SELECT r, doc_id, len(ws)::BIGINT AS size FROM d WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(size)::BIGINT AS n_terms FROM own),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY 1), totals),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS term FROM benchmark) GROUP BY 1, 2, 3),
s AS (SELECT i, item_id, r, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN own USING (r), totals GROUP BY 1, 2, 3),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s JOIN own USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {BEST}
"""
