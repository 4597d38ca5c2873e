import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import conversations
from textloom.llm.conversations import damaged, repair_damaged, repaired, report, sql
from textloom.llm.runtime import read

SF = "/root/testdata/sf0.001"
SHAPE = re.compile("(s?(ua)+)?")
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    out, seen = [], set()
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def every_repair(rows, most=2):
    """All edits with at most ``most`` inserts in each gap: (cost, audit, roles and texts)."""
    gaps = [g for n in range(most + 1) for g in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        more = 3 if fault == 3 else 0
        own = [(4, "D", [])]
        if fault not in (1, 2):
            own += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    gap_choices = [(3 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gaps]
    parts = [gap_choices]
    for c in choices:
        parts += [c, gap_choices]
    best = None
    for way in itertools.product(*parts):
        told = [t for w in way for t in w[2]]
        if any(not r for r, _ in told) or not SHAPE.fullmatch("".join(r[0] for r, _ in told)):
            continue
        found = (sum(w[0] for w in way), "".join(w[1] for w in way), "\n".join(f"{r}:{t}" for r, t in told))
        best = min(best or found, found)
    return best


def shortest_repair(rows):
    """The same for long conversations: least (cost, audit) by row and state, with whole audits and texts."""
    fault = faults(rows)
    now = {"": (0, "", ())}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def with_inserts(table):
        out = dict(table)
        for _ in range(3):
            for q, (c, a, t) in list(out.items()):
                for r in ("user", "assistant"):
                    if (q in ("", "s", "a")) == (r == "user"):
                        put(out, r[0], (c + 3, a + "I", (*t, f"{r}:")))
        return out

    for (_, role, text), f in zip(rows, fault):
        after = {}
        for q, (c, a, t) in now.items():
            put(after, q, (c + 4, a + "D", t))
        if f not in (1, 2):
            for q, (c, a, t) in with_inserts(now).items():
                for r, own, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
                    if r and r[0] in legal:
                        put(after, r[0], (c + own + (3 if f == 3 else 0), a + letter, (*t, f"{r}:{text}")))
        now = after
    ends = [v for q, v in with_inserts(now).items() if q in ("", "a")]
    cost, audit, told = min(ends)
    return cost, audit, "\n".join(told)


def expected(rows, solve=shortest_repair):
    """The report of one conversation of (turn, role, text), by plain Python."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    fault = faults(rows)
    cost, audit, told = solve(rows)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def random_rows(rng, n, conv, nulls=True):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", *([None] if nulls else [])]
    texts = ["Yes.", "No!", "what", "ok. ", "", " \t\n", "Sure?\v", "été", "\xa0", *([None] if nulls else [])]
    return [(conv, rng.choice([None, rng.randrange(n), i]) if nulls else i, rng.choice(roles), rng.choice(texts)) for i in range(n)]


def fields(r):
    return tuple(r[f] for f in FIELDS)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_short_conversations_equal_every_repair():
    rng = random.Random(1)
    for _ in range(120):
        rows = [r[1:] for r in random_rows(rng, rng.randrange(0, 4), 0, nulls=False)]
        assert shortest_repair(rows) == every_repair(rows, 2), rows


@pytest.mark.parametrize("size", [4096, 3, 1])
def test_report_equals_plain_python(spark, monkeypatch, size):
    """Segments of any size give the same repair; nulls, ties and repeated rows included."""
    rng = random.Random(size)
    rows = [r for c in range(60) for r in random_rows(rng, rng.randrange(1, 14), c, nulls=c % 2 == 0)] + random_rows(rng, 40, None) + random_rows(rng, 300, 1000, nulls=False)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("SEG", F.lit(1)).repartition(5)
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", size)
    # workers import the module anew: the size travels with the function
    monkeypatch.setattr(conversations, "_segments", _sized(size))
    got = {r.conv_id: fields(r) for r in report(df).collect()}
    assert got == {c: expected(r) for c, r in by_conversation(rows).items()}


def _sized(size):
    def run(batches):
        from textloom.llm import conversations as module

        module.SEGMENT_ROWS = size
        yield from module._segments(batches)
        module.SEGMENT_ROWS = 4096

    return run


def test_edits_give_the_repaired_text(spark):
    rng = random.Random(9)
    rows = [r for c in range(30) for r in random_rows(rng, 9, c, nulls=False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.conv_id: r for r in report(df).collect()}
    for conv, got in by_conversation([(r.conv_id, r.seg, r.i, r.part, r.edit, r.role, r.text) for r in repaired(df).collect()]).items():
        got.sort(key=lambda r: r[:3])
        assert "".join(r[3] for r in got) == want[conv].audit
        kept = [r for r in got if r[3] != "D"]
        assert SHAPE.fullmatch("".join(r[4][0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r[4]}:{r[5]}" for r in kept).encode()).hexdigest() == want[conv].repaired_sha256


def test_query_equals_plain_python_and_sql(spark):
    conv = read(spark, SF, "conversations")
    got = {r.conv_id: fields(r) for r in repair_damaged(conv).collect()}
    rows = [tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()]
    want = {c: expected(r) for c, r in by_conversation(damage(rows)).items()}
    nothing = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = db.execute(f"SELECT conv_id, {', '.join(FIELDS)} FROM ({sql()})").fetchall()
    assert {r[0]: r[1:] for r in found} == got


def test_damage_and_sql_with_nulls(spark):
    rng = random.Random(4)
    rows = [r for c in (*range(25), None) for r in random_rows(rng, 7, c)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, map(tuple, damaged(df).collect()))) == sorted(map(str, damage(rows)))
    got = sorted(map(tuple, repair_damaged(df).select("conv_id", *FIELDS).collect()), key=str)
    db = duckdb.connect()
    table = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    db.register("conversations", table)
    assert sorted(db.execute(f"SELECT conv_id, {', '.join(FIELDS)} FROM ({sql()})").fetchall(), key=str) == got


def test_empty_and_wholly_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert report(empty).collect() == [] and repair_damaged(empty).collect() == [] and repaired(empty).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair_damaged(spark.createDataFrame([(conv, 0, "user", "Yes.")], SCHEMA)).collect()
    assert fields(row) == (0,) * 6 + ("", hashlib.sha256().hexdigest())


def test_extreme_turns(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    (row,) = report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.gaps == -2 and row.cost == 0 and row.audit == "KK"
