"""Quality rules with weak supervision (native).

Rules vote good (+1), bad (-1) or abstain (0) on a document. Expectation
maximisation over the counts of vote patterns estimates each rule's accuracy and
the share of good documents without any label; a document is kept by its
posterior probability instead of by passing every rule. Features, votes, counts
and posteriors are Spark SQL; only the table of vote patterns, at most 3 to the
power of the number of rules (2,187 rows), comes to the driver for the fit.

Defined cases: a null text counts as empty; a text without words has no votes
other than the length rule's and fails the base rule; repeated rows are judged
alike; an empty table gives an empty result; columns that are named like the
added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

#: ASCII white space, which separates words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: name, SQL for "bad", SQL for "good"; both false or null: abstain. Integers only, so that every engine agrees.
RULES = [
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    ("capitals", "2 * n_upper > word_chars", "5 * n_upper <= word_chars"),
    ("exclamations", "5 * n_bangs > n_words", "20 * n_bangs <= n_words"),
]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
ROUNDS = 12


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, FEATURES...): one narrow row for each document, no shuffle."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), body.alias("t"))
    d = d.select("doc_id", "t", F.filter(F.split("t", SPACE + "+", -1), lambda w: w != "").alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "t", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"), lines.alias("lines"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("wh", i), F.get("wh", i + 1), F.get("wh", i + 2)))
    d = d.select(
        "doc_id", "n_words",
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long").alias("n_bangs"),
        F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # Only documents with some window twice pay for the sort.
    twice = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h")
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    hit = F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    d = d.withColumn("p", F.sort_array(F.transform(hit, lambda x: x["i"]))).drop("s")
    steps = F.transform("p", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("p", k - 1), p - 3)))
    repeats = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return d.withColumn("n_repeat_words", repeats).select("doc_id", *FEATURES)


def votes(feats: DataFrame) -> DataFrame:
    """Adds ``pattern``: a character +, - or 0 for each rule."""
    cols = [F.expr(f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END") for _, bad, good in RULES]
    return feats.withColumn("pattern", F.concat(*cols))


def fit(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior probability of "good" for each vote pattern, from the patterns' counts.

    Every rule that votes is right with its own probability, whatever the class.
    Starts from accuracy 0.7 and an even prior; ``rounds`` rounds of EM; counts
    are smoothed by one vote each way.
    """
    n = len(RULES)
    acc, prior = [0.7] * n, 0.5
    total = sum(patterns.values())
    post: dict[str, float] = {}
    for step in range(rounds + 1):
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum((1 if v == "+" else -1) * math.log(a / (1 - a)) for v, a in zip(p, acc) if v != "0")
            post[p] = 1 / (1 + math.exp(-odds))
        if step == rounds or not total:
            break
        prior = (sum(c * post[p] for p, c in patterns.items()) + 1) / (total + 2)
        for r in range(n):
            right = sum(c * (post[p] if p[r] == "+" else 1 - post[p]) for p, c in patterns.items() if p[r] != "0")
            cast = sum(c for p, c in patterns.items() if p[r] != "0")
            acc[r] = (right + 1) / (cast + 2)
    return post


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, FEATURES..., pattern, posterior, base_failed, kept) for each row of ``docs``."""
    voted = cut(votes(features(docs, doc_id, text)), "quality")
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    post = fit(counts)
    table = docs.sparkSession.createDataFrame(sorted(post.items()), "pattern string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # At most 3 ** len(RULES) rows.
    return (voted.join(F.broadcast(table), "pattern")
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= least))
            .select("doc_id", *FEATURES, "pattern", "posterior", "base_failed", "kept"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects."""
    kept = judge(docs, doc_id, text, least).where("kept").select("doc_id").distinct()
    return docs.join(kept.select(F.col("doc_id").alias("__kept")), F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi")


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    cases = " || ".join(f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END" for _, bad, good in RULES)
    out = [f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
g3 AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE c > 1),
g4 AS (SELECT doc_id, count(DISTINCT j) AS r FROM g3 GROUP BY 1),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_bangs,
  coalesce(r, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN g4 ON w.doc_id = g4.doc_id),
v AS (SELECT *, {cases} AS pattern FROM f),
c AS MATERIALIZED (SELECT pattern, count(*)::DOUBLE AS n FROM v GROUP BY 1),
m0 AS (SELECT 0.5::DOUBLE AS pi, {', '.join(f'0.7::DOUBLE AS a{r}' for r in range(len(RULES)))})"""]
    for k in range(ROUNDS + 1):
        odds = " + ".join(f"CASE substr(pattern, {r + 1}, 1) WHEN '+' THEN ln(a{r} / (1 - a{r})) WHEN '-' THEN -ln(a{r} / (1 - a{r})) ELSE 0 END" for r in range(len(RULES)))
        out.append(f"p{k} AS MATERIALIZED (SELECT pattern, n, 1 / (1 + exp(-(ln(pi / (1 - pi)) + {odds}))) AS q FROM c, m{k})")
        if k < ROUNDS:
            accs = ", ".join(f"(coalesce(sum(n * CASE substr(pattern, {r + 1}, 1) WHEN '+' THEN q WHEN '-' THEN 1 - q ELSE 0 END), 0) + 1) / (coalesce(sum(n) FILTER (substr(pattern, {r + 1}, 1) <> '0'), 0) + 2) AS a{r}" for r in range(len(RULES)))
            out.append(f"m{k + 1} AS MATERIALIZED (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS pi, {accs} FROM p{k})")
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return ",\n".join(out) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND q >= 0.5 AS kept
FROM v JOIN p{ROUNDS} USING (pattern)"""


ORACLE = _oracle()
