"""Personal data by candidate generation and gradient boosting (native).

High-recall patterns propose spans, which may overlap: the base patterns of each
kind, and looser ones (spelled-out addresses, local phone numbers, card numbers
with other separators, IPv6). Every candidate gets a vector of small numbers for
its format (digits, separators, how at and dot are written) and its context (what
it touches and whether a cue word stands before it).

Labels come from what the vector does not hold. Of looser e-mail addresses it is the
last part of the domain: 1 for well-known ones, none for two small letters, which may be
a country or a word, 0 for all others; of the other kinds the checksum or the number of
digits (0 if it fails), and a cue word before the number (1). A candidate that overlaps
a certified base span of another kind is not personal; one that overlaps its own kind's
is left out, as it is never added. A few fixed examples are added (``SEEDS``), so that a
corpus without spelled-out addresses, or without prose that looks like one, still has
both. Boosted trees of depth 3 learn from the counts of vectors over all candidates of
all rows, a table bounded by the product of the bins, and score as SQL.

A label by a check is right by chance for some junk (a tenth of all numbers pass
Luhn's). With chance c, of candidates that pass among those of probability p a
share (p - c) / ((1 - c) p) is personal. A kind's threshold is the lowest score of
its looser candidates at which that share, by the model and by the counts from
there up, reaches the wished precision. Base spans stay; looser ones are added when
their score reaches the threshold and they touch no base span. No list of domains stands
before the trees; only numbers that cannot be of their kind (by checksum, range or number
of digits) are never added.

Patterns have possessive repeats and may start a match only at the head of a run
or at the end of the previous match, which finds the same matches as the plain
patterns in linear time. Positions come from the lengths of the pieces between
matches, in code points.

Defined cases: a null text is empty; texts without candidates have zero counts
and empty span lists; repeated rows are treated alike; an empty table gives an
empty result; a corpus without labelled candidates is scored by the fixed examples
alone; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

KINDS = ("email", "ip", "card", "phone")

# The base patterns, made linear (see above).
_EMAIL_HEAD = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _EMAIL_HEAD + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators by kind.
LOOSE = {
    "email": _EMAIL_HEAD + r"\x20?(?:@|[(\[{](?:at|AT)[)\]}]|(?<=\x20)(?:at|AT)(?=\x20))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{](?:dot|DOT)[)\]}]|(?<=\x20)(?:dot|DOT)(?=\x20))\x20?[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Texts without a match of these have no candidate of the kind.
NEEDS = {"email": r"@|[(\[{](?:at|AT)[)\]}]|\x20(?:at|AT)\x20", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]", "phone": r"[0-9]"}
CUE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|addr)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|carte|karte|tarjeta|pay)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|t[ée]l[ée]fono|telefon)\W*(?:\w+\W+){0,2}$",
}
#: Largest value of each feature; so at most 4*2*5*5*3*3*2*4*3 = 43,200 vectors, of which few occur.
#: cue: of e-mail addresses. dot: 0 plain, 1 spelled out, 2 with a blank beside it, 3 and a capital next. at: 0 the sign, 1 in brackets, 2 the word.
FEATURES = {"kind": 3, "loose": 1, "digits": 4, "seps": 4, "left": 2, "right": 2, "cue": 1, "dot": 3, "at": 2}
#: Chance that junk passes its kind's label.
CHANCE = (0.02, 0.02, 0.1, 0.02)
# Top-level domains that are no common words of prose.
DOMAINS = "com org net edu gov mil int info biz io uk de fr nl ch pl se dk fi cz pt jp cn kr br mx ru eu dev app example test invalid".split()
CONTEXT = 32
#: Of the boosted trees.
DEPTH = 3
#: Characters of a candidate: no kind passes its check with fewer, but for e-mail addresses and IP numbers of at least 5 and 7.
SHORTEST = 5
#: Levels of eight of running sums: lists of 8 ** LEVELS entries.
LEVELS = 9


def _cased(exprs: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN {exprs[k]}" for i, k in enumerate(KINDS)) + " END"


def _luhn(d: str) -> str:
    """SQL: the digit string passes the Luhn check."""
    at = f"CAST(substring({d}, length({d}) - i, 1) AS INT)"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> CASE WHEN i % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END), 0, (a, x) -> a + x) % 10 = 0"


def _q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "r'" + pattern.replace("'", "\\'") + "'"


def _running(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Array columns as their running sums (+) or maxima (max), level by level: linear in their length but for LEVELS.

    After level l an entry covers the 8 ** (l + 1) entries up to it; short arrays
    stay as they are. Slices and grown lists would copy the array for each entry.
    """
    for level in range(LEVELS):
        step = 8**level
        terms = [f"get({{c}}, i - {j * step})" for j in range(1, 8)]
        new = "x + " + " + ".join(f"coalesce({t}, 0)" for t in terms) if how == "+" else f"greatest(x, {', '.join(terms)})"
        rest = [f"`{c}`" for c in rows.columns if c not in columns]
        rows = rows.selectExpr(*rest, *[f"CASE WHEN size({c}) > {step} THEN transform({c}, (x, i) -> {new.format(c=c)}) ELSE {c} END AS {c}" for c in columns])
    return rows


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds ``cands`` to rows with column __t: array of (kind, base, s, e, m, before, after)."""
    names = [(f"{g}_{k}", p[k], i, g == "b") for g, p in (("b", BASE), ("l", LOOSE)) for i, k in enumerate(KINDS)]
    keep = [f"`{c}`" for c in rows.columns]
    none = "CAST(array() AS ARRAY<STRING>)"
    out = rows.selectExpr(*keep, *[f"__t RLIKE {_q(NEEDS[k])} AS n_{k}" for k in KINDS])
    out = out.selectExpr(*keep, *[f"CASE WHEN n_{KINDS[i]} THEN regexp_extract_all(__t, {_q(p)}, 0) ELSE {none} END AS m_{n}" for n, p, i, _ in names])
    out = out.selectExpr(*keep, *[f"m_{n}" for n, *_ in names], *[f"CASE WHEN size(m_{n}) > 0 THEN split(__t, {_q(p)}, -1) ELSE {none} END AS p_{n}" for n, p, *_ in names])
    ends = [f"zip_with(m_{n}, slice(p_{n}, 1, size(m_{n})), (m, p) -> length(m) + length(p)) AS e_{n}" for n, *_ in names]
    out = out.selectExpr(*keep, *[f"{c}_{n}" for n, *_ in names for c in "mp"], *ends)
    out = _running(out, [f"e_{n}" for n, *_ in names], "+")
    lists = []
    for n, _, i, base in names:
        one = f"named_struct('kind', {i}, 'base', {str(base).lower()}, 's', get(e_{n}, k) - length(m), 'n', length(m), 'm', m, 'before', right(get(p_{n}, k), {CONTEXT}), 'after', left(get(p_{n}, k + 1), 2))"
        # Numbers of fewer than SHORTEST characters are no candidates, only texts between them.
        lists.append(f"filter(transform(m_{n}, (m, k) -> CASE WHEN length(m) >= {SHORTEST} THEN {one} END), x -> x IS NOT NULL)")
    return out.selectExpr(*keep, f"concat({', '.join(lists)}) AS cands")


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``cands``: every candidate with its span, check, features and weak label."""
    rows = docs.drop("cands", "__t", "__sure").withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = _candidates(rows)
    digits = "regexp_replace(c.m, '[^0-9]', '')"
    out = out.withColumn("cands", F.expr(f"transform(cands, c -> named_struct('c', c, 'd', {digits}))"))
    part = "get(split(c.m, '[.]'), {})"
    octets = " AND ".join(f"length(ltrim('0', {part.format(k)})) <= 3 AND CAST(concat('0', right({part.format(k)}, 3)) AS INT) <= 255" for k in range(4))
    last = "regexp_extract(c.m, '([A-Za-z0-9-]+)$', 1)"
    known = f"CASE WHEN lower({last}) IN ({', '.join(map(repr, DOMAINS))}) THEN 1 WHEN NOT {last} RLIKE '^[a-z]{{2}}$' THEN 0 END"
    cue = _cased({k: f"c.before RLIKE {_q(v)}" for k, v in CUE.items()}, "c.kind")
    prose = "c.m RLIKE '[.] | [.]'"
    checks = {
        "email": "true",
        "ip": f"CASE WHEN c.m LIKE '%:%' THEN true ELSE {octets} END",
        "card": f"CASE WHEN length(d) BETWEEN 16 AND 19 THEN {_luhn('d')} ELSE false END",
        "phone": "length(d) BETWEEN 8 AND 15",
    }
    spelled = "c.m RLIKE '(?i)[(\\\\[{]dot[)\\\\]}]| dot '"
    features = {
        "kind": "c.kind",
        "loose": "CAST(NOT c.base AS INT)",
        "digits": "CASE WHEN length(d) = 0 THEN 0 WHEN length(d) < 8 THEN 1 WHEN length(d) < 12 THEN 2 WHEN length(d) < 16 THEN 3 ELSE 4 END",
        "seps": "least(4, length(regexp_replace(c.m, '[A-Za-z0-9]', '')))",
        "left": "CASE WHEN c.before RLIKE '[\\\\p{L}\\\\p{N}_]$' THEN 2 WHEN c.before RLIKE '[^\\\\s(\\\\[,;:]$' THEN 1 ELSE 0 END",
        "right": "CASE WHEN c.after RLIKE '^[\\\\p{L}\\\\p{N}_]' THEN 2 WHEN c.after RLIKE '^[^\\\\s)\\\\],;:.!?]' THEN 1 ELSE 0 END",
        "cue": f"CASE WHEN c.kind > 0 THEN 0 ELSE CAST(c.before RLIKE {_q(CUE['email'])} AS INT) END",
        "dot": f"CASE WHEN c.kind > 0 THEN 0 WHEN c.m RLIKE '[.] [A-Z]' THEN 3 WHEN {prose} THEN 2 WHEN {spelled} THEN 1 ELSE 0 END",
        "at": "CASE WHEN c.kind > 0 OR c.m LIKE '%@%' THEN 0 WHEN c.m RLIKE '(?i)[(\\\\[{]at[)\\\\]}]' THEN 1 ELSE 2 END",
    }
    body = ", ".join(f"'{k}', {v}" for k, v in features.items())
    ok = f"coalesce({_cased(checks, 'c.kind')}, false)"
    own = f"CASE WHEN c.base THEN NULL WHEN c.kind = 0 THEN {known} WHEN NOT {ok} THEN 0 WHEN c.kind = 2 OR {cue} THEN 1 END"
    out = out.withColumn("cands", F.expr(f"transform(cands, x -> transform(array(x), y -> named_struct('c', y.c, 'f', named_struct({_inner(body)}), 'ok', {_inner(ok)}, 'own', {_inner(own)}))[0])"))
    sure = "filter(cands, b -> b.c.base AND b.ok)"
    # Evidence on a looser candidate: certified spans that it meets, else its own.
    meets = "b.c.s < x.c.s + x.c.n AND x.c.s < b.c.s + b.c.n"
    label = f"CASE WHEN x.c.base THEN CAST(x.ok AS INT) WHEN exists(__sure, b -> {meets} AND b.c.kind <> x.c.kind) THEN 0 WHEN NOT exists(__sure, b -> {meets}) THEN x.own END"
    out = out.withColumn("__sure", F.expr(sure))
    return out.withColumn("cands", F.expr(f"transform(cands, x -> named_struct('kind', x.c.kind, 'base', x.c.base, 's', x.c.s, 'e', x.c.s + x.c.n, 'f', x.f, 'ok', x.ok, 'y', {label}))")).drop("__t", "__sure")


def _inner(sql: str) -> str:
    """Field names of the lambda in place of the short ones."""
    import re

    return re.sub(r"(?<![\w.'])d(?![\w'])", "y.d", re.sub(r"(?<![\w.'])c\.", "y.c.", sql))


class Model:
    """Boosted trees over FEATURES, and a threshold for each kind."""

    def __init__(self, bias: float, trees: list[tuple], thresholds: list[float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def score(self, v: dict[str, int]) -> float:
        return self.bias + sum(_leaf(t, v) for t in self.trees)

    def sql(self, f: str) -> str:
        """The score as SQL over a struct of features."""
        def tree(t) -> str:
            return f"CAST({t!r} AS DOUBLE)" if isinstance(t, float) else f"CASE WHEN {f}.{t[0]} <= {t[1]} THEN {tree(t[2])} ELSE {tree(t[3])} END"

        return " + ".join([f"CAST({self.bias!r} AS DOUBLE)", *map(tree, self.trees)])


def _leaf(t, v: dict[str, int]) -> float:
    while not isinstance(t, float):
        t = t[2] if v[t[0]] <= t[1] else t[3]
    return t


def _grow(rows: list[tuple[dict, float, float]], depth: int):
    """A tree on (vector, gradient, hessian) sums by exact gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = float(max(-3.0, min(3.0, 0.3 * g / (h + 1.0))))
    best = (1e-6, None)
    for name, most in FEATURES.items() if depth else ():
        for cut_at in range(most):
            a = [r for r in rows if r[0][name] <= cut_at]
            if a and len(a) < len(rows):
                ga, ha = sum(r[1] for r in a), sum(r[2] for r in a)
                gain = ga * ga / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (name, cut_at))
    if best[1] is None:
        return leaf
    name, cut_at = best[1]
    return (name, cut_at, _grow([r for r in rows if r[0][name] <= cut_at], depth - 1), _grow([r for r in rows if r[0][name] > cut_at], depth - 1))


def _vector(**values: int) -> dict[str, int]:
    return {k: 0 for k in FEATURES} | values


#: Fixed examples (vector, clean, personal): spelled-out addresses and sentence ends, numbers that stand alone and numbers inside others.
SEEDS = [
    *[(_vector(kind=0, loose=1, seps=seps, at=at, dot=dot, cue=cue), 0, 4) for seps in (3, 4) for at in (0, 1) for dot in (0, 1) for cue in (0, 1)],
    *[(_vector(kind=0, loose=1, seps=4, at=2, dot=1, cue=cue), 0, 8) for cue in (0, 1)],
    *[(_vector(kind=0, loose=1, seps=seps, at=2, dot=dot), 40, 0) for seps in (3, 4) for dot in (2, 3)],
    *[(_vector(kind=0, loose=1, seps=seps, at=at, dot=dot), 20, 0) for seps in (3, 4) for at in (0, 1) for dot in (2, 3)],
    (_vector(kind=0, loose=1, seps=3, at=2, dot=0), 10, 0),
    *[(_vector(kind=k, loose=1, digits=d, seps=seps), 0, 8) for k, d, seps in ((1, 4, 4), (1, 3, 4), (2, 4, 3), (3, 2, 2), (3, 2, 4), (3, 3, 4))],
    *[(_vector(kind=k, loose=1, digits=d, seps=seps, **side), 10, 0) for k, d, seps in ((1, 4, 4), (1, 3, 4), (2, 4, 3), (3, 2, 2), (3, 2, 4), (3, 3, 4)) for side in ({"left": 2}, {"right": 2}, {"left": 1}, {"right": 1})],
]


def fit(table: list[tuple[dict[str, int], int, int]], rounds: int = 40, precision: float = 0.98, seeds: list[tuple] = SEEDS) -> Model:
    """Trees on (vector, rows labelled 0, rows labelled 1); each kind's threshold by the precision of its looser candidates."""
    table = [*table, *seeds]
    clean, personal = sum(t[1] for t in table), sum(t[2] for t in table)
    if not clean or not personal:
        return Model(0.0, [], [math.inf] * len(KINDS))
    bias = math.log(personal / clean)
    score, trees = [bias] * len(table), []
    for _ in range(rounds):
        rows = []
        for (v, a, b), s in zip(table, score):
            p = 1 / (1 + math.exp(-s))
            rows.append((v, b - (a + b) * p, (a + b) * p * (1 - p)))
        trees.append(_grow(rows, DEPTH))
        score = [s + _leaf(trees[-1], v) for s, (v, _, _) in zip(score, table)]
    thresholds = []
    for k, chance in enumerate(CHANCE):
        least = chance / (1 - precision * (1 - chance))  # the probability at which the share of personal ones is ``precision``
        own = sorted(((s, a, b) for s, (v, a, b) in zip(score, table) if v["kind"] == k and v["loose"]), reverse=True)
        best, right, all_ = math.inf, 0, 0
        for i, (s, a, b) in enumerate(own):
            right, all_ = right + b, all_ + a + b
            if right >= least * all_ and (i + 1 == len(own) or own[i + 1][0] < s):
                best = s
        thresholds.append(max(best, math.log(least / (1 - least))))
    return Model(bias, trees, thresholds)


def fit_candidates(found: DataFrame) -> Model:
    """The model of all rows' candidates; at most the product of the bins, 43,200 rows, comes to the driver."""
    each = found.select(F.explode("cands").alias("x")).where("x.y IS NOT NULL")
    counts = each.groupBy(*[F.col(f"x.f.{k}").alias(k) for k in FEATURES]).agg(F.sum(1 - F.col("x.y")).alias("a"), F.sum("x.y").alias("b"))
    rows = [({k: r[k] for k in FEATURES}, r["a"], r["b"]) for r in counts.collect()]
    return fit(sorted(rows, key=lambda r: tuple(r[0].values())))


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Rows of :func:`with_candidates` with base_spans and pii_spans (kind, s, e) in place of the candidates."""
    strip = "x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)"
    out = found.withColumn("base_spans", F.expr(f"array_sort(transform(filter(cands, x -> x.base AND x.ok), {strip}))"))
    if model.trees:
        least = "CASE x.kind " + " ".join(f"WHEN {k} THEN {'1e300D' if math.isinf(t) else f'CAST({t!r} AS DOUBLE)'}" for k, t in enumerate(model.thresholds)) + " END"
        more = f"filter(cands, x -> NOT x.base AND x.ok AND ({model.sql('x.f')}) >= {least} AND NOT exists(base_spans, b -> b.s < x.e AND x.s < b.e))"
        out = out.withColumn("pii_spans", F.expr(f"array_sort(concat(base_spans, transform({more}, {strip})))"))
    else:
        out = out.withColumn("pii_spans", F.col("base_spans"))
    return out.drop("cands")


def _listed(spans: str) -> str:
    name = "CASE x.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return f"array_join(transform({spans}, x -> concat({name}, ':', x.s, ':', x.e)), ',')"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row of ``docs``; n_spans counts all spans, overlapping ones each.

    Candidates are written once, as a narrow table, and read for the fit and the result.
    """
    found = cut(with_candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "cands"), "pii")
    out = with_spans(found, fit_candidates(found))
    counts = [F.expr(f"CAST(size(filter(base_spans, x -> x.kind = {i})) AS BIGINT) AS n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.expr(f"sha2({_listed('base_spans')}, 256) AS base_sha256"), F.expr(f"{_listed('pii_spans')} AS spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, as [EMAIL].

    Overlapping spans are one, named by the first. ``length``: a column to set
    to the new text's length. Null texts stay null. The patterns run twice, for
    the fit over all rows and for the rows themselves; texts are not shuffled.
    """
    columns = docs.columns
    clash = {c: f"__own_{c}" for c in ("cands", "base_spans", "pii_spans") if c in columns}
    docs, types = docs.withColumnsRenamed(clash), docs.schema
    model = fit_candidates(cut(with_candidates(docs.select(F.col(text).alias("text")), "text").select("cands"), "pii"))
    rows = with_spans(with_candidates(docs.withColumn("__body", F.coalesce(F.col(text).cast("string"), F.lit(""))), "__body"), model)
    ordered = "array_sort(transform(pii_spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    rows = rows.withColumn("__spans", F.expr(ordered))
    rows = _running(rows.withColumn("__ends", F.expr("transform(__spans, x -> x.e)")), ["__ends"], "max")
    # Spans that meet are one: it begins where none before it reaches, and ends where the next begins to be clear.
    rows = rows.withColumn("__first", F.expr("filter(sequence(0, size(__spans)), k -> k < size(__spans) AND get(__spans, k).s >= coalesce(get(__ends, k - 1), 0))"))
    rows = rows.withColumn("__spans", F.expr("transform(__first, (k, g) -> named_struct('s', get(__spans, k).s, 'e', get(__ends, coalesce(get(__first, g + 1), size(__spans)) - 1), 'kind', get(__spans, k).kind))"))
    tag = "CASE x.kind " + " ".join(f"WHEN {i} THEN '[{k.upper()}]'" for i, k in enumerate(KINDS)) + " END"
    last = "coalesce(get(__spans, k - 1).e, 0)"
    parts = f"transform(__spans, (x, k) -> concat(substring(__body, {last} + 1, x.s - {last}), {tag}))"
    new = f"concat(array_join({parts}, ''), substring(__body, element_at(__spans, -1).e + 1))"
    rows = rows.withColumn(text, F.expr(f"CASE WHEN size(__spans) > 0 THEN {new} ELSE `{text}` END"))
    if length:
        rows = rows.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text).cast(types[length].dataType)))
    return rows.drop(*clash).withColumnsRenamed({v: k for k, v in clash.items()}).select(*columns)
