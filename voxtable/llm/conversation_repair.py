"""Repair of conversation structure by weighted interval parsing.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Edits turn it into such a sequence at least cost: a turn is kept (0), given another
role (2) or deleted (3), and an empty turn can be inserted anywhere (2); a
truncated turn that is not deleted costs 1 more, blank and duplicate turns have
to be deleted. The grammar is in Chomsky normal form: its symbols X_pq, for the
states p, q of the sequence (start, after s, after u, after a), derive X_pr X_rq
for every r, or the edit of one row, with the closure of insertions on both
sides; the start symbols are X_00 and X_03. The cell of a span of rows has for
each symbol the least (cost, audit), where the audit is the edits' initials. Two
audits of a span with equal costs are never each other's prefix, since they edit the
same rows and a longer one would have more insertions; so least audits join to
least audits. As every r is tried, a span's cell is the same wherever it is split:
one split of each span is enough, and spans are combined bottom-up by their
lengths 1, 2, 4 and so on.

Rows are dealt out by ranges of (conversation, turn, role, text), so that a long
conversation takes several tasks; a task returns one span for each of its
conversations, and spans of conversations that cross into other tasks (two a
task at most) are combined afterwards. The digest of such a conversation is taken from its
rows once more, streamed in their order: SHA-256 has no parallel form, so the one
thing that a single task does is to stream a crossing conversation through it.
The audit is a cell of the result and bounded as Spark's cells are (2 GB).

Defined cases: null roles and texts are one space, and so are null ids and
turns where damage is drawn; a conversation with a null id is one like
others; rows of equal turn follow each other by role and text, null turns come first;
repeated rows are duplicates of the first; an empty role has no initial; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: States: start, after s, after u, after a; the sequence may end at the start or after a.
STATES, ENDS = range(4), (0, 3)
#: The state that each initial leads to, from each state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: The initial that a turn of a new role gets in each state, of those that can be given.
GIVEN = {p: i for (p, i) in NEXT if i in ROLES}
COUNTS = ["blank", "duplicate", "truncated", "illegal"]

Cell = list  # of STATES x STATES entries (cost, audit), or None where nothing derives


def joined(a: Cell, b: Cell) -> Cell:
    """The cell of two spans that follow each other."""
    out = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                x, y = a[4 * p + r], b[4 * r + q]
                if x is not None and y is not None:
                    if best is None or x[0] + y[0] < best[0]:
                        best = (x[0] + y[0], x[1] + y[1])
                    elif x[0] + y[0] == best[0]:
                        best = min(best, (best[0], x[1] + y[1]))
            out.append(best)
    return out


def _inserted() -> Cell:
    """The span without rows: the closure of insertions."""
    out: Cell = [(0, "") if p == q else None for p in STATES for q in STATES]
    for p in STATES:
        q, cost, audit = p, 0, ""
        while True:
            q, cost, audit = NEXT[q, GIVEN[q]], cost + INSERT, audit + "I"
            if out[4 * p + q] is not None:
                break
            out[4 * p + q] = (cost, audit)
    return out


EMPTY = _inserted()


@lru_cache
def row_cell(initial: str, fault: str | None) -> Cell:
    """The span of one row, with insertions on both sides."""
    own: Cell = [(DELETE, "D") if p == q else None for p in STATES for q in STATES]
    if fault not in ("blank", "duplicate"):
        more = UNFINISHED if fault == "truncated" else 0
        for p in STATES:
            edits = [(NEXT[p, GIVEN[p]], (REROLE + more, "R"))]
            if (p, initial) in NEXT:
                edits.append((NEXT[p, initial], (KEEP + more, "K")))
            for q, edit in edits:
                own[4 * p + q] = min(own[4 * p + q] or edit, edit)
    return joined(joined(EMPTY, own), EMPTY)


class Spans:
    """Consecutive spans, of which two of equal length are combined; so lengths are powers of two and memory is that of the audits."""

    def __init__(self):
        self.stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        length = 1
        while self.stack and self.stack[-1][0] == length:
            cell, length = joined(self.stack.pop()[1], cell), 2 * length
        self.stack.append((length, cell))

    def whole(self) -> Cell:
        cell = EMPTY
        for _, left in reversed(self.stack):
            cell = joined(left, cell)
        return cell


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[q] for q in ENDS if cell[q] is not None)


def rendered(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns: the audit decides where each edit leads."""
    state = 0
    for edit in audit:
        if edit == "I":
            initial, text = GIVEN[state], ""
            role = ROLES[initial]
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[GIVEN[state]]
            initial = role[:1]
        state = NEXT[state, initial]
        yield edit, role, text


def digest(rows: Iterator[tuple[str, str]], audit: str) -> str:
    """SHA-256 of the repaired turns as ``role:text``, joined by newlines."""
    sha = hashlib.sha256()
    for k, (_, role, text) in enumerate(rendered(rows, audit)):
        sha.update((("\n" if k else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
    return sha.hexdigest()


class Run:
    """What is known of consecutive rows of one conversation; runs that follow each other can be added up."""

    def __init__(self, conv):
        self.conv = conv
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.low, self.high = 0, None, None
        self.first, self.last = None, None
        self.spans = Spans()

    def meet(self, first: str | None, low: int | None, turns: int, high: int | None, last: str | None) -> None:
        """Adds turns and initials that follow."""
        if first is not None:
            if self.last is not None and self.last + first not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        if fault == "dropped":
            return
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        self.meet(initial, turn, turn is not None, turn, initial)
        self.spans.add(row_cell(initial if initial in ("s", *ROLES) else "", fault))

    def span(self, other: dict) -> None:
        for c in COUNTS:
            self.counts[c] += other[c]
        self.meet(other["first"], other["low"], other["turns"], other["high"], other["last"])
        self.spans.add([None if c is None else (c, a) for c, a in zip(other["costs"], other["audits"])])

    def report(self) -> dict:
        cost, audit = cheapest(self.spans.whole())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": cost, "audit": audit}

    def open(self) -> dict:
        cell = self.spans.whole()
        return {"conv_id": self.conv, **self.counts, "turns": self.turns, "low": self.low, "high": self.high, "first": self.first, "last": self.last,
                "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
OPEN = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, audits array<string>"


def _output(schema: pa.Schema):
    """Collects rows and gives them as batches of a bounded number."""
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        return out

    return rows, batch


def _schema(of: list[tuple[str, pa.DataType]], conv: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv), *of])


_LONGS = [(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")]
_REPORT = [*_LONGS, ("audit", pa.string())]
_OPEN = [*[(c, pa.int64()) for c in (*COUNTS, "turns", "low", "high")], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]


#: Characters of a conversation that a task holds until it knows whether the conversation ends in it; longer ones are treated as crossing.
LONG = 1 << 24


def _first_pass(long: int):
    """Rows sorted by conversation: a report with its digest for each conversation that lies within, a span for the first and the last."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run, rows, batch = None, None, None

        def done() -> None:
            if crosses:
                rows.append({"conv_id": run.conv, "part": part, "span": run.open()})
            else:
                report = run.report()
                rows.append({"conv_id": run.conv, "part": part, "report": report | {"repaired_sha256": digest(iter(kept), report["audit"])}})

        for b in batches:
            if rows is None:
                rows, batch = _output(_schema([("part", pa.int32()), ("report", pa.struct([*_REPORT, ("repaired_sha256", pa.string())])), ("span", pa.struct(_OPEN))], b.schema.field(0).type))
            for at in range(0, b.num_rows, 1024):
                for ident, turn, role, text, fault in zip(*(b.column(c)[at : at + 1024].to_pylist() for c in range(5))):
                    if run is None or ident != run.conv:
                        if run is not None:
                            done()
                        crosses = run is None  # the first may have begun in another task
                        run, kept, size = Run(ident), [], 0
                    run.row(turn, role, fault)
                    if not crosses and fault != "dropped":
                        kept.append((role, text))
                        size += len(text)
                        if size > long:
                            kept, crosses = [], True
                yield batch()
        if run is not None:
            crosses = True  # the last may go on in another task
            done()
            yield batch()

    return run_task


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (conversation, task): the reports of the whole conversations."""
    run, rows, batch = None, None, None
    for b in batches:
        if rows is None:
            rows, batch = _output(_schema(_REPORT, b.schema.field(0).type))
        for ident, span in zip(*(b.column(c).to_pylist() for c in range(2))):
            if run is None or ident != run.conv:
                if run is not None:
                    rows.append(run.report())
                run = Run(ident)
            run.span(span)
        yield batch()
    if run is not None:
        rows.append(run.report())
        yield batch()


def _streamed(each, of: list[tuple[str, pa.DataType]]):
    """Applies ``each`` to the audit and the rows of each conversation, which come in this order; memory is constant but for the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                schema[:] = [_schema(of, b.schema.field(0).type)]
                for at in range(0, b.num_rows, 1024):
                    yield from zip(*(b.column(c)[at : at + 1024].to_pylist() for c in range(4)))

        stream = rows()
        head = next(stream, None)
        while head is not None:
            after = None

            def own() -> Iterator[tuple[str, str]]:
                nonlocal after
                for r in stream:
                    if r[1] is not None:  # the next conversation's audit
                        after = r
                        return
                    yield r[2], r[3]

            turns = own()
            for part in each(turns, head[1]):
                yield pa.RecordBatch.from_pylist([{"conv_id": head[0]} | x for x in part], schema[0])
            for _ in turns:  # to the next audit
                pass
            head = after

    return run


def _digests(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[list[dict]]:
    yield [{"repaired_sha256": digest(turns, audit)}]


def _turns(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[list[dict]]:
    out = ({"place": k, "edit": edit, "role": role, "text": text} for k, (edit, role, text) in enumerate(rendered(turns, audit)))
    while part := list(islice(out, 1024)):
        yield part


def in_order(rows: DataFrame, reports: DataFrame, each, of: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """``each`` over the rows of the conversations of ``reports``, streamed in order behind their audits."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    ids = reports.select(F.col("conv_id").alias("__conv"))
    turns = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi").where("fault IS NULL OR fault <> 'dropped'")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    heads = reports.select("conv_id", "audit", *none("long", "turn", "seq"), *none("string", "role", "text"))
    mixed = turns.select("conv_id", *none("string", "audit"), "turn", "seq", "role", "text").unionByName(heads)
    dealt = mixed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text", "seq")
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_streamed(each, of), f"conv_id {conv}, {ddl}")


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): ``rows`` with faults drawn by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, which stays as a mark so that its conversation is known; 1
    empties its text, 2 takes the sentence ends out of it, 3 repeats it, 4 makes
    its role user.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn)).cast("binary")), F.lit(20))
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), draw.alias("draw"))
    d = F.col("draw")
    changed = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (d == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, seq): each row's first fault, with a number of its own.

    The first of equal rows is an aggregate of narrow rows, kept only where
    there are several; so no conversation is gathered.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    # A row that was dropped is a mark of its conversation only.
    own = F.when(F.col("dropped"), "dropped").when(blank, "blank").when(~last.isin(".", "!", "?"), "truncated")
    numbered = cut(rows.select("conv_id", "turn", "role", F.when(~F.col("dropped"), F.col("text")).alias("text"), own.alias("fault"), mark.alias("mark"), F.monotonically_increasing_id().alias("seq")), "turns")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"), F.col("seq"))
    again = numbered.where("fault IS NULL OR fault = 'truncated'").groupBy(F.col("conv_id").alias("__conv"), F.col("mark").alias("__mark")).agg(F.count("*").alias("__n"), F.min(place).alias("__first")).where("__n > 1")
    repeats = cut(again.select("__conv", "__mark", F.col("__first.seq").alias("__first")), "repeats")
    repeated = F.coalesce(F.col("fault"), F.lit("none")).isin("none", "truncated") & F.col("__first").isNotNull() & (F.col("seq") != F.col("__first"))
    out = numbered.join(repeats, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("mark") == F.col("__mark")), "left")
    return out.select("conv_id", "turn", "role", "text", F.when(repeated, "duplicate").otherwise(F.col("fault")).alias("fault"), "seq")


ORDER = ["conv_id", "turn", "role", "text", "seq"]


def parsed(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``rows`` as :func:`faults` returns them."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "turn", "role", "text", "fault")
    found = cut(keyed.mapInArrow(_first_pass(long), f"conv_id {conv}, part int, report struct<{_struct(REPORT)}, repaired_sha256: string>, span struct<{_struct(OPEN)}>"), "spans")
    crossing = found.where("span IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "span")
    whole = cut(crossing.mapInArrow(_second_pass, f"conv_id {conv}, {REPORT}"), "reports")
    shas = in_order(rows, whole, _digests, [("repaired_sha256", pa.string())], "repaired_sha256 string").withColumnRenamed("conv_id", "__conv")
    crossed = whole.join(shas, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return found.where("report IS NOT NULL").select("conv_id", "report.*").unionByName(crossed)


def _struct(ddl: str) -> str:
    return ddl.replace(" long", ": long").replace(" string", ": string").replace(" array", ": array")


def as_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` as :func:`damage` returns them, but without damage."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), F.lit(False).alias("dropped"))


def report(rows: DataFrame, long: int = LONG) -> DataFrame:
    """What :func:`parsed` returns for ``rows`` of :func:`as_rows` or :func:`damage`."""
    return parsed(faults(rows), long)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, inserted ones with empty text."""
    marked = faults(rows)
    return in_order(marked, parsed(marked), _turns, [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())], "place long, edit string, role string, text string")


def _oracle() -> str:
    """Left-to-right dynamic programming over the rows, with the states, edits and insertions as tables."""
    inserts = [(p, p, 0, "", "") for p in STATES]
    for p, q, cost, roles in [(0, 2, 2, "u"), (0, 3, 4, "ua"), (1, 2, 2, "u"), (1, 3, 4, "ua"), (2, 3, 2, "a"), (3, 2, 2, "u")]:
        inserts.append((p, q, cost, "I" * len(roles), "".join(ROLES[i] + ":\n" for i in roles)))
    edits = [(p, q, "K", 0, i, None) for (p, i), q in NEXT.items()] + [(p, NEXT[p, i], "R", 2, None, ROLES[i]) for p, i in GIVEN.items()] + [(p, p, "D", 3, None, None) for p in STATES]
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    step = "lambda a, z: xor(a >> 1, 3988292384 * (a & 1))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (SELECT *, {crc} % 20 AS d FROM src),
damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role, text, copy) AS r FROM damaged),
marked AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS i, conv_id, turn, role, text, left(role, 1) AS ini,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, {space}), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY g ORDER BY i) || ini AS pair FROM marked),
counts AS (SELECT g, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY g),
inserts(p, q, c, a, o) AS (VALUES {values(inserts)}),
edits(p, q, e, c, ini, given) AS (VALUES {values(edits)}),
best AS (
  SELECT g, 0::BIGINT AS i, q, {{'c': c::BIGINT, 'a': a, 'o': o}} AS b FROM counts, inserts WHERE p = 0
  UNION ALL
  SELECT best.g, best.i + 1, n.q, min({{'c': b.c + x.c + n.c + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 1 ELSE 0 END, 'a': b.a || e || n.a,
    'o': b.o || CASE e WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE given || ':' || text || chr(10) END || n.o}})
  FROM best JOIN marked w ON w.g = best.g AND w.i = best.i + 1
    JOIN edits x ON x.p = best.q AND (x.e <> 'K' OR x.ini = w.ini) AND (x.e = 'D' OR fault IS NULL OR fault = 'truncated')
    JOIN inserts n ON n.p = x.q
  GROUP BY best.g, best.i, n.q),
least AS (SELECT c.*, min(b) AS b FROM counts c JOIN best USING (g) WHERE best.i = c.n AND q IN (0, 3) GROUP BY ALL)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.o, length(b.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE = _oracle()
