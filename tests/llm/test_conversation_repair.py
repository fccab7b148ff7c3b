"""Repair of conversations against a search over all edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from voxtable.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def all_repairs(rows, most=3):
    """The cheapest of all edits with at most ``most`` insertions in each gap, by trying them all."""
    best = None
    gaps = [[x for n in range(most + 1) for x in itertools.product("ua", repeat=n)] for _ in range(len(rows) + 1)]
    choices = []
    for role, text, fault in rows:
        bad = fault in ("blank", "duplicate")
        more = fault == "truncated"
        choices.append([("D", 3, None, None)] + ([] if bad else [("K", more, role, text), ("R", 2 + more, "user", text), ("R", 2 + more, "assistant", text)]))
    for edits in itertools.product(*choices):
        for inserted in itertools.product(*gaps):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(inserted[k])
                out += [({"u": "user", "a": "assistant"}[i], "") for i in inserted[k]]
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k][2] is not None:
                        out.append((edits[k][2], edits[k][3]))
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def marks(rows):
    """Faults of rows in order, by their definition."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(cr.SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def reports(rows, exact):
    """What report() should give for rows (conv, turn, role, text) without damage; ``exact`` repairs one conversation."""
    out = {}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ", t))
    for c, own in convs.items():
        own.sort(key=lambda r: r[:4])
        turns = {r[4] for r in own if r[4] is not None}
        faults = marks([r[2:4] for r in own])
        initials = [r[2][:1] for r in own]
        cost, audit, text = exact([(r[2], r[3], f) for r, f in zip(own, faults)])
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in text).encode()).hexdigest()
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha)
    return out


def stepwise(rows):
    """Left to right over the states, for conversations too long to try all edits."""
    best = {0: (0, "", ())}
    def closed(best):
        for p, i in [(0, "u"), (1, "u"), (3, "u"), (2, "a"), (3, "u")]:
            if p in best:
                q = cr.NEXT[p, i]
                new = (best[p][0] + 2, best[p][1] + "I", best[p][2] + ((cr.ROLES[i], ""),))
                best[q] = min(best.get(q, new), new)
        return best
    best = closed(best)
    for role, text, fault in rows:
        new = {}
        for p, (c, a, o) in best.items():
            moves = [(p, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (p, role[:1]) in cr.NEXT:
                    moves.append((cr.NEXT[p, role[:1]], more, "K", ((role, text),)))
                moves += [(q, 2 + more, "R", ((cr.ROLES[i], text),)) for (s, i), q in cr.NEXT.items() if s == p and i in cr.ROLES]
            for q, cost, e, x in moves:
                y = (c + cost, a + e, o + x)
                new[q] = min(new.get(q, y), y)
        best = closed(new)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_of_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "system", "tool", " ", ""]), r.choice(["a.", "b!", "open", "c?"]), r.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(r.randrange(0, 4))]
    spans = cr.Spans()
    for role, _, fault in rows:
        spans.add(cr.row_cell(role[:1] if role[:1] in "sua" else "", fault))
    cost, audit = cr.cheapest(spans.whole())
    want = all_repairs(rows, 2)
    assert (cost, audit) == want[:2] == stepwise(rows)[:2]
    assert [x[1:] for x in cr.rendered(iter([x[:2] for x in rows]), audit)] == want[2]


def test_splits_do_not_matter():
    r = random.Random(5)
    cells = [cr.row_cell(r.choice(["s", "u", "a", ""]), r.choice([None, "blank", "truncated"])) for _ in range(24)]
    def fold(a, b):
        if b - a == 1:
            return cells[a]
        m = r.randrange(a + 1, b)
        return cr.joined(fold(a, m), fold(m, b))
    assert len({str(fold(0, 24)) for _ in range(40)}) == 1


def conversations(seed, n):
    r = random.Random(seed)
    return [(c, t if r.random() > 0.03 else None, r.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]), r.choice(["Yes.", "No!", "Why?", "so", " ", "", None, f"text {r.random()}."]))
            for c in range(n) for t in r.sample(range(30), r.randrange(1, 12))]


def test_reports(spark):
    """Small conversations, a null one, one that holds a third of all rows, repeated rows; over several tasks."""
    rows = conversations(1, 60) + [(None, t, "user", f"{t}.") for t in range(5)]
    r = random.Random(3)
    rows += [(77, t // 2, r.choice(["user", "assistant", "system", "x"]), r.choice([f"{t}.", "again.", "open"])) for t in range(len(rows) // 2)] + rows[:6]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("own") for c in ("seq", "fault", "mark", "part", "audit", "dropped")})
    got = {x["conv_id"]: tuple(x) for x in cr.report(cr.as_rows(docs)).collect()}
    assert got == reports(rows, stepwise)
    turns = collections.defaultdict(list)
    for x in cr.repaired(cr.as_rows(docs)).orderBy("conv_id", "place").collect():
        turns[x["conv_id"]].append(f"{x['role']}:{x['text']}")
    assert all(hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == x[-1] for c, x in got.items())


def test_long_conversations_need_no_memory_of_their_texts(spark):
    rows = conversations(2, 20)
    got = {x["conv_id"]: tuple(x) for x in cr.report(cr.as_rows(spark.createDataFrame(rows, SCHEMA)), long=20).collect()}
    assert got == reports(rows, stepwise)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! three? ") for c in range(40) for t in [*range(6), None]] + [(None, 3, None, None), (50, None, "user", "x")]
    want, lost = collections.Counter(), collections.Counter()
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        (lost if d == 0 else want)[row] += 2 if d == 3 else 1
    got = cr.damage(spark.createDataFrame(rows, SCHEMA))
    assert collections.Counter(tuple(r)[:4] for r in got.where("not dropped").collect()) == want and got.where("dropped").count() == sum(lost.values()) > 0


def test_conversations_that_lose_all_rows(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    out = cr.report(cr.damage(spark.createDataFrame([(c, 0, "user", "a.") for c in gone], SCHEMA))).collect()
    assert sorted(tuple(r) for r in out) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
    assert cr.report(cr.damage(spark.createDataFrame([], SCHEMA))).count() == 0
