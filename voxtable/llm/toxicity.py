"""Toxicity by maximum-scoring segments of token log-odds.

A word is read as three tokens: itself, its first 5 and its first 4 letters (so
that inflected forms share evidence). Tokens are filed under a fixed number of
hash buckets. From labelled rows, each bucket gets the log-odds of toxic
against clean documents under a Dirichlet prior, and its standard error; a word's score is the log-odds of
its most significant token, or a small penalty if none is significant. A
linear-time scan (Ruzzo and Tompa 1999) finds every maximal-scoring segment.
Segment scores are put in units of the Gumbel law of the best segments of clean
documents, whose location grows with the log of the length. All segments above the law's location are aggregated by
the sum statistic of that law (Karlin and Altschul 1993): of the r best, the chance
of so large a sum, and of all r the least chance after a penalty of a factor 2 for
each further segment. So several weaker passages add up, and one strong passage
counts as itself. A logistic curve turns the negative log of that chance, the
excess, into a probability. Law and curve are fitted on scores of rows whose fold
took no part in the word scores, since words learned from a row flatter it. The passages listed for a toxic document are the
segments of that sum and any other that reaches the threshold alone.

The fit uses at most ``MAX_LABELS`` labelled rows (the bound is a parameter);
rows are taken in the order of a hash of their ids. The counts have BUCKETS
rows at most whatever the vocabulary, so the model has a fixed size. Scoring
covers every row and all of its text.

Defined cases: a null text is empty; a text without words has segment score 0
and the probability that belongs to it; labels with null ids or values are
ignored; without labels of both kinds every score is 0; repeated rows get equal
scores; an empty table gives an empty result; columns named like the added ones
(score, predicted, passages, held_out) are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.scratch import cut

#: Fixed size of the model.
BUCKETS = 1 << 18
#: Labelled rows that the fit takes at most.
MAX_LABELS = 40_000
#: Tokens below this many standard errors count as noise.
LEAST_Z = 2.7
#: Score of a word without a significant token.
DRIFT = -0.05
#: Strength of the Dirichlet prior: documents for each bucket.
PRIOR = 0.5
#: Parts of the labelled rows, each scored by the others for the calibration.
FOLDS = 4
#: Probability at which a document is called toxic.
TOXIC_AT = 0.7
PASSAGE = T.StructType().add("first", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType())
WORD = r"[^\W\d_]+"
_WORD = re.compile(WORD)


COUNTS = [f"n{k}_{y}" for k in range(FOLDS) for y in (0, 1)]


def held_out(doc_id):
    """Column: the row's label is never learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def tokens(word: str) -> tuple[str, ...]:
    return (word, "5" + word[:5], "4" + word[:4]) if len(word) > 3 else (word,)


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y, fold) of at most ``most`` labelled rows that are not held out; copies of a text count once."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    taken = usable.orderBy(F.xxhash64("__id"), "__id").limit(most)
    # At most ``most`` rows of two numbers; so the texts are not shuffled.
    return docs.select(F.col(doc_id).alias("__d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(taken), F.col("__d") == F.col("__id")).select("text", "y").dropDuplicates().withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket by fold and class, one set of rows for each task."""
    counts = np.zeros((2 * FOLDS, BUCKETS), np.int32)
    for b in batches:
        for t, y, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = {bucket(x) for w in set(_WORD.findall(t.as_py().lower())) for x in tokens(w)}
            counts[2 * fold + y, list(own)] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(c[used]) for c in counts]], ["bucket", *COUNTS])


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Each bucket's log-odds where it is significant, else 0 (Monroe et al. 2008).

    The Dirichlet prior has PRIOR clean documents for each bucket and as many
    toxic ones as the classes' sizes make of that, so it favours neither.
    """
    if not clean.any() or not toxic.any():
        return np.zeros(len(clean), np.float32)
    p, q = toxic + PRIOR * toxic.sum() / clean.sum(), clean + PRIOR
    delta = np.log(p) - np.log(p.sum() - p) - np.log(q) + np.log(q.sum() - q)
    z = delta / np.sqrt(1 / p + 1 / q)
    return np.where((np.abs(z) >= LEAST_Z) & (clean + toxic > 0), delta, 0.0).astype(np.float32)


class Scorer:
    """Word scores by bucket; remembers words."""

    def __init__(self, weights: np.ndarray, remember: int = 200_000):
        self.weights, self.known, self.remember = weights, {}, remember

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            own = [float(self.weights[bucket(t)]) for t in tokens(w)]
            s = max(own, key=abs)
            s = DRIFT if s == 0 else s
            if len(self.known) < self.remember:
                self.known[w] = s
        return s

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words and every maximal-scoring segment (first word, end word, score)."""
        scores = [self.word(w) for w in _WORD.findall(text.lower())]
        return len(scores), maximal_segments(scores)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring subsequences in linear time: (start, end, score), disjoint, in order.

    Each found segment keeps the place of the last one before it with a smaller
    sum on its left, so a search follows these links and looks at a segment that
    it passes over only once.
    """
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []  # sum before the segment
    right: list[float] = []  # sum after it
    lower: list[int] = []  # the last segment before it with a smaller left sum, -1 if none
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = i, before
        j = len(start) - 1
        while j >= 0 and left[j] >= low:
            j = lower[j]
        while j >= 0 and right[j] < total:  # joined with segment j and what lies between
            first, low = start[j], left[j]
            j, k = lower[j], j
            del start[k:], end[k:], left[k:], right[k:], lower[k:]
        start.append(first)
        end.append(i + 1)
        left.append(low)
        right.append(total)
        lower.append(j)
    return [(a, e, r - x) for a, e, x, r in zip(start, end, left, right)]


def _best(weights: list[np.ndarray]):
    """(y, words, best) of each labelled row by its fold's weights, for the law of clean rows' best segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(w, 200_000 // FOLDS) for w in weights]
        for b in batches:
            out = [scorers[k].segments(t.as_py()) for t, k in zip(b.column(0), b.column(2).to_pylist())]
            best = [max((s[2] for s in x), default=0.0) for _, x in out]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array(best, pa.float64())], ["y", "words", "best"])

    return run


def _excesses(weights: list[np.ndarray], law: Law):
    """(y, excess) of each labelled row by its fold's weights, for the logistic curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(w, 200_000 // FOLDS) for w in weights]
        for b in batches:
            out = [scorers[k].segments(t.as_py()) for t, k in zip(b.column(0), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([aggregate([s[2] for s in x], n, law)[0] for n, x in out], pa.float64())], ["y", "excess"])

    return run


#: Location at length 0, its growth with the log of the length, and scale.
Law = tuple[float, float, float]


def gumbel(words: np.ndarray, best: np.ndarray) -> Law:
    """The law of clean rows' best segments: least squares on the log of the length, then moments."""
    if not len(best):
        return 0.0, 0.0, 1.0
    lengths = np.log1p(words)
    spread = float(((lengths - lengths.mean()) ** 2).sum())
    slope = max(0.0, float(((lengths - lengths.mean()) * (best - best.mean())).sum()) / spread) if spread > 0 else 0.0
    x = best - slope * lengths
    scale = max(0.25, float(x.std()) * math.sqrt(6) / math.pi)
    return float(x.mean()) - 0.5772 * scale, slope, scale


def calibrate(y: np.ndarray, excess: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve by Newton's method with halved steps and a weak prior that keeps separable rows finite."""
    features = np.column_stack([excess, np.ones(len(excess))])
    theta = np.zeros(2)

    def loss(t: np.ndarray) -> float:
        z = features @ t
        return float((np.logaddexp(0, z) - y * z).sum()) + 0.05 * float(t @ t)

    for _ in range(100):
        p = 1 / (1 + np.exp(-features @ theta))
        down = features.T @ (y - p) - 0.1 * theta
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(2), down)
        if np.abs(step).max() < 1e-10:
            break
        size = 1.0
        while size > 1e-6 and loss(theta + size * step) > loss(theta):  # the full step may lead too far
            size /= 2
        theta = theta + size * step
    return float(theta[0]), float(theta[1])


def tail(x: float) -> float:
    """Negative log of the chance that the best segment of a clean document reaches ``x`` in units of the law."""
    return -math.log(max(-math.expm1(-math.exp(-max(-50.0, min(50.0, x)))), 1e-300))


def aggregate(scores: list[float], words: int, law: Law) -> tuple[float, float]:
    """(excess, least score of the segments that make it) of one document.

    The chance of a sum of at least t of the r best normalised scores is about
    exp(-t) * t ** (r - 1) / (r! (r - 1)!); for r = 1 the law itself is used. The
    excess is the largest negative log, less log 2 for each segment after the
    first; at most 30.
    """
    location, slope, scale = law
    shift = location + slope * math.log1p(words)
    if not scores:
        return tail(-shift / scale), math.inf
    x = sorted(((s - shift) / scale for s in scores), reverse=True)
    most, chosen, total = tail(x[0]), 1, max(x[0], 0.0)
    for r in range(2, len(x) + 1):
        if x[r - 1] <= 0:
            break
        total += x[r - 1]
        e = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
        if e > most and total > r:
            most, chosen = e, r
    return min(30.0, most), x[chosen - 1] * scale + shift


class Model:
    """A fitted model: fixed size, whatever the corpus. ``law`` is that of Gumbel, ``curve`` the logistic one's; None without labels of both kinds."""

    def __init__(self, weights: np.ndarray, law: Law | None, curve: tuple[float, float] | None = None):
        self.weights, self.law, self.curve = weights, law, curve

    def judge(self, words: int, segments: list[tuple[int, int, float]], toxic_at: float) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of a document, and the passages that make it toxic."""
        if self.law is None or self.curve is None:
            return 0.0, []
        e, least = aggregate([s[2] for s in segments], words, self.law)
        p = self.probability(e)
        if p < toxic_at:
            return p, []
        location, slope, scale = self.law
        shift = location + slope * math.log1p(words)
        return p, [s for s in segments if s[2] >= least - 1e-9 or self.probability(tail((s[2] - shift) / scale)) >= toxic_at]

    def probability(self, excess: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * min(30.0, excess) + b)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELS) -> Model:
    """Learns from labelled rows that are not held out; only the bounded sample is shuffled and written."""
    rows = cut(sample(docs, labels, doc_id, text, label, most), "toxicity")
    counts = rows.mapInArrow(_bucket_counts, f"bucket long, {', '.join(f'{c} int' for c in COUNTS)}").groupBy("bucket").agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS])
    all_ = np.zeros((FOLDS, 2, BUCKETS))
    got = counts.toArrow()  # at most BUCKETS rows
    at = got.column(0).to_numpy()
    for k, c in enumerate(COUNTS):
        all_[k // 2, k % 2, at] = got.column(c).to_numpy()
    clean, toxic = all_.sum(axis=0)
    weights = log_odds(clean, toxic)
    if not weights.any():
        return Model(weights, None)
    others = [log_odds(clean - own[0], toxic - own[1]) for own in all_]
    seen = rows.mapInArrow(_best(others), "y int, words long, best double").where("y = 0").toArrow()  # at most ``most`` rows
    law = gumbel(seen.column(1).to_numpy(), seen.column(2).to_numpy())
    seen = rows.mapInArrow(_excesses(others, law), "y int, excess double").toArrow()  # the same
    return Model(weights, law, calibrate(seen.column(0).to_numpy(), seen.column(1).to_numpy()))


def score(docs: DataFrame, model: Model, text: str = "text", toxic_at: float = TOXIC_AT, added: tuple[str, str, str] = ("score", "predicted", "passages")) -> DataFrame:
    """``docs`` with score (probability), predicted (1 if it is at least ``toxic_at``) and passages.

    ``passages`` are the maximal segments that make the document toxic, as
    (first word, end word, score). One pass, no shuffle.
    """
    rest = [c for c in docs.columns if c not in added]
    schema = docs.select(*rest).schema.add(added[0], T.DoubleType()).add(added[1], T.IntegerType()).add(added[2], T.ArrayType(PASSAGE))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.weights)
        for b in batches:
            out = [model.judge(*scorer.segments(t.as_py() or ""), toxic_at) for t in b.column(len(rest))]
            p = np.array([x for x, _ in out], np.float64)
            passages = [[{"first": a, "end": e, "score": v} for a, e, v in x] for _, x in out]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(p, pa.float64()), pa.array((p >= toxic_at).astype(np.int32)), pa.array(passages, kind)], [*rest, *added])

    return docs.select(*rest, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the fitted model calls toxic."""
    own = ("__score", "__predicted", "__passages")
    return score(docs.withColumn("__body", F.col(text)), fit(docs, labels, doc_id, text), "__body", added=own).where("__predicted = 0").select(*docs.columns)
