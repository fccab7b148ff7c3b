"""Exact duplicates against a plain grouping in Python."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from voxtable.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows):
    """Groups by normalised text; which row of equal ids stays is left open, so rows are compared as a multiset."""
    groups = collections.defaultdict(list)
    for k, (i, text, *_) in enumerate(rows):
        t = text or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0, k, i))
    out = []
    for text, members in groups.items():
        members.sort()
        for m in members:
            out.append((m[4], members[0][4], len(members), m is members[0], hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


EDGE = [
    (1, "a b c", "en"), (2, "abc", "en"), (3, "a\tb\nc\x0b\x0c\r", "de"), (4, None, None), (5, "", "en"), (6, " \n ", "en"), (None, "abc", "en"), (None, None, "en"),
    (7, "a bc", "en"), (7, "a bc", "en"), (8, "x " * 40_000, "en"), (9, "x" * 40_000, "en"), (10, "ABC", "en"), (11, "é😀 é", "fr"), (12, "é😀é", "fr"), (3, "a\tb\nc\x0b\x0c\r", "de"),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    got = collections.Counter(tuple(r) for r in exact_dedup.groups(docs).collect())
    assert got == by_hand(EDGE)
    kept = exact_dedup.keep_one(docs.withColumns({c: F.lit("own") for c in ("kept", "keep_id", "digest", "best", "heavy", "n_chars")}))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "keep_id", "digest", "best", "heavy", "n_chars"]
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["heavy"]) for r in kept.collect()) == sorted(
        (i or 0, t or "", "own") for i, t in [(3, "a\tb\nc\x0b\x0c\r"), (6, " \n "), (7, "a bc"), (8, "x " * 40_000), (10, "ABC"), (11, "é😀 é")])
    assert exact_dedup.groups(spark.createDataFrame([], SCHEMA)).count() == exact_dedup.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_heavy_and_light_digests_agree(spark, support):
    """A third of the rows are one text, another sixth a second; the split point changes nothing."""
    rows = [(i, ("hot  text" if i % 2 else "hot text") if i % 3 == 0 else "warm" if i % 6 == 1 else f"text {i % 700}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collections.Counter(tuple(r) for r in exact_dedup.groups(docs, support=support).collect()) == by_hand(rows)
    narrow = exact_dedup.digests(docs)
    named = {r["heavy"] for r in exact_dedup.frequent(narrow, support).collect()}
    assert len(named) <= 1 / support
    counts = collections.Counter(r["text_sha256"] for r in narrow.collect())
    assert {d for d, n in counts.items() if n > support * len(rows)} <= named


def test_heavy_rows_do_not_shuffle(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 2 else str(i), "en") for i in range(500)], SCHEMA)
    plan = exact_dedup.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Window" not in plan and "Python" not in plan
    assert exact_dedup.keep_one(docs).count() == 251
