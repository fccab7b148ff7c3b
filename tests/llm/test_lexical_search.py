"""Ranked search against scores of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.llm import lexical_search as ls

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def by_hand(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(split(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    N, L = len(own), sum(n for *_, n in own)
    out = []
    for item, t in items:
        found = []
        for i, c, n in own:
            score = 0
            for w, times in collections.Counter(split(t)).items():
                if c[w]:
                    df = sum(w in x for _, x, _ in own)
                    score += times * math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * (100 - 25 + (25 * n * N) // L)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 20, 20, 60])))) for i in range(n)]


def test_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(ls, "POSTINGS", 400)
    docs = corpus(1, 400)
    docs += docs[:5] + [(i + 1000, docs[7][1]) for i in range(30)]  # repeated rows, and ties at the last rank
    items = [(k, " ".join(docs[k * 7][1].split()[:12]) + " and W1 w2") for k in range(40)] + [(90, docs[7][1]), (90, docs[7][1])]
    got = ls.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items)


def test_edge_rows(spark):
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha"), (None, None), (2, ""), (3, " .,;\x7f"), (4, "ALPHA-alpha_alpha" + " z" * 50_000), (5, "É é 中文 alpha"), (6, "É"), (7, "beta \x00gamma")]
    items = [(1, "alpha beta Beta"), (1, "é"), (2, None), (None, "É 中文"), (3, "none such"), (4, ""), (5, "GAMMA")]
    odd = {c: F.lit("own") for c in ("n", "terms", "tfs", "rank", "score", "item")}
    got = ls.search(spark.createDataFrame(docs, DOCS).withColumns(odd).repartition(3), spark.createDataFrame(items, ITEMS).withColumns(odd)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame(items, ITEMS)
    assert ls.search(no_docs, some).count() == ls.search(spark.createDataFrame(docs, DOCS), no_items).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERIES", 3)
    docs, items = corpus(2, 60), [(k, f"w{k} w1 w3") for k in range(8)]
    got = ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items, 4)


@pytest.mark.parametrize("seed", range(6))
def test_reading_stops_early_and_loses_nothing(seed):
    """Lists with a few high impacts: far from all documents are looked up, and no tie at the last rank is lost."""
    r = np.random.default_rng(seed)
    n = 5000
    doc = np.concatenate([r.permutation(n)[: n // 2] for _ in range(5)])
    term = np.repeat(np.arange(5), n // 2)
    tf = np.ones(len(doc), np.int64)
    m = np.maximum(75, (75 + r.pareto(1.0, n) * 20).astype(np.int64))
    lists = ls.Lists(doc, term, tf, m, np.array([900, 700, 300, 200, 50], np.int64))
    best, times = ls.Best(10), np.array([1, 1, 2, 1, 3])
    none, ident = np.zeros(n, bool), np.arange(n)
    looked_up = ls.best_positions(lists, np.arange(5), times, best, none, ident)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, np.array([900, 700, 300, 200, 50])[term] * times[term] * (10**9 // (1000 + 12 * m[doc])))
    want = np.lexsort((ident, -score))[:10]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert looked_up < n
