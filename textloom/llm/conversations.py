"""Faults of conversations, and their cheapest repair by a dynamic program over retained turns."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, keep, rows_of, tidy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A segment: successive turns of one conversation, at most so many rows and characters.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 22
#: White space in the sense of the faults, and the marks that end a sentence.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What the last retained turn was: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert at the end after each state.
CLOSING = [0, 2, 1, 0]
FAULTLESS, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
NEVER = 1 << 60
TURNS = "conv_id long, seg long, i int, turn long, role string, text string, fault int, summary array<long>"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, seg long, i int, part int, edit string, turn long, role string, text string"
#: Places in a segment's summary; costs and ranks by state before and after the segment follow.
ROWS, DATED, LEAST, MOST, DISTINCT, N_BLANK, N_DUPLICATE, N_TRUNCATED, ILLEGAL, FIRST, LAST, COSTS = range(12)


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults to be found, put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops and marks, 3 repeats it, 4 makes its role
    ``user``.  Nulls count as one space: in the key, as role and as text.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown[2].alias("role"), shown[3].alias("text"), (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def inserts(before: int, after: int) -> int | None:
    """Turns to insert between two retained ones for ``(s?(ua)+)?``: decided by their roles."""
    if after == SYSTEM:
        return 0 if before == START else None
    return int(before == after or (after == ASSISTANT and before in (START, SYSTEM)))


@lru_cache(maxsize=None)
def moves(initial: int, fault: int) -> tuple:
    """How a turn is retained: for each state after it, (state before, cost, letters).

    Costs are those above the turn's deletion, so that a deletion changes no running minimum.
    """
    out: list[list] = [[], [], [], []]
    if fault not in (IS_BLANK, IS_DUPLICATE):
        for after in (SYSTEM, USER, ASSISTANT):
            if after == SYSTEM != initial:
                continue
            for before in range(4):
                if (n := inserts(before, after)) is not None:
                    own = n * INSERT + (0 if after == initial else REROLE) + (TRUNCATED if fault == IS_TRUNCATED else 0)
                    out[after].append((before, own - DELETE, "I" * n + ("K" if after == initial else "R")))
    return tuple(map(tuple, out))


def step(minima: list[int], ranks: list[int], ways: tuple) -> tuple[list[int], list[int], list[tuple]]:
    """One turn more.

    ``minima[q]`` is the least cost of all retained subsequences whose last role is q,
    less the prefix sum of deletions up to their last turn: the gap to a later turn costs the difference of two
    prefix sums.  Ties go to the lesser audit; ``ranks`` has the order of the states' audits.
    Audits of so many turns end with the edit of a turn, so none begins another: what follows cannot change their order.
    """
    best = [min([(minima[q], ranks[q], "D", q)] + [(minima[p] + own, ranks[p], letters, p) for p, own, letters in ways[q]]) for q in range(4)]
    order = sorted(range(4), key=lambda q: best[q][1:3])
    place = [0] * 4
    for at, q in enumerate(order):
        place[q] = at
    return [min(b[0], NEVER) for b in best], place, best


class Segment:
    """Turns of one conversation in order: counts, and costs from each state before them to each after."""

    def __init__(self, starts: bool):
        self.entries = (START,) if starts else range(4)
        self.by_entry = {p: ([0 if q == p else NEVER for q in range(4)], list(range(4))) for p in self.entries}
        self.counts = [0] * 4
        self.rows = self.chars = self.dated = self.distinct = self.illegal = self.least = self.most = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: int, fault: int, chars: int) -> None:
        ways = moves(initial, fault)
        for p, (minima, ranks) in self.by_entry.items():
            self.by_entry[p] = step(minima, ranks, ways)[:2]
        if self.rows:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        self.chars += chars
        self.counts[fault] += 1
        if turn is not None:
            self.least = min(self.least, turn) if self.dated else turn
            self.distinct += not self.dated or turn != self.most
            self.most = turn
            self.dated += 1

    def summary(self) -> list[int]:
        costs, ranks = [NEVER] * 16, [0] * 16
        for p, (minima, order) in self.by_entry.items():
            for q in range(4):
                costs[4 * p + q] = NEVER if minima[q] >= NEVER // 2 else minima[q] + DELETE * self.rows
                ranks[4 * p + q] = order[q]
        return [self.rows, self.dated, self.least, self.most, self.distinct, *self.counts[1:], self.illegal, self.first, self.last, *costs, *ranks]


def _initial(role: str) -> int:
    return INITIALS.get(role[:1], START)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


@tidy()
def _segments(batches):
    """Number sorted turns by segment and place, find their faults, and close each segment with a summary row.

    A row of ``mark`` 0 tells that the row after it is the first of its role and text.
    """
    seg, i, now, open_, first = TaskContext.get().partitionId() << 33, 0, None, None, False
    started = False
    for batch in batches:
        out = []
        for conv, turn, role, text, mark, blank, cut in zip(*rows_of(batch, "conv_id", "turn", "role", "text", "mark", "blank", "truncated")):
            if mark == 0:
                first = True
                continue
            if open_ is not None and (conv != now or open_.rows >= SEGMENT_ROWS or open_.chars + len(text) > SEGMENT_CHARS):
                out.append((now, seg, i, None, None, None, None, open_.summary()))
                seg, i, open_ = seg + 1, 0, None
            if open_ is None:
                open_ = Segment(starts=started and conv != now)
                now, started = conv, True
            fault = IS_BLANK if blank else IS_DUPLICATE if not first else IS_TRUNCATED if cut else FAULTLESS
            open_.add(turn, _initial(role), fault, len(text))
            out.append((conv, seg, i, turn, role, text, fault, None))
            i, first = i + 1, False
        yield _batch(out, TURNS)
    if open_ is not None:
        yield _batch([(now, seg, i, None, None, None, None, open_.summary())], TURNS)


def _conversations(batches, *names):
    """Successive rows of the same conversation."""
    held, now = [], None
    for batch in batches:
        for row in zip(*rows_of(batch, "conv_id", *names)):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def chosen(summaries: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation, and the states before and after each segment on the way to it."""
    cost, rank, back = [0, NEVER, NEVER, NEVER], [0, 1, 2, 3], []
    for s in summaries:
        costs, ranks = s[COSTS : COSTS + 16], s[COSTS + 16 :]
        best = [min((min(cost[p] + costs[4 * p + q], NEVER), rank[p], p) for p in range(4)) for q in range(4)]
        order = sorted(range(4), key=lambda q: (best[q][1], ranks[4 * best[q][2] + q]))
        cost, rank = [b[0] for b in best], [order.index(q) for q in range(4)]
        back.append([b[2] for b in best])
    total, _, q = min((cost[q] + CLOSING[q] * INSERT, rank[q], q) for q in range(4))
    way = []
    for sources in reversed(back):
        way.append((sources[q], q))
        q = sources[q]
    return total, way[::-1]


@tidy()
def _plans(batches):
    """For each segment, before its turns: the states before and after it; at the last, what to insert and the conversation's figures."""
    for conv, rows in _conversations(batches, "seg", "summary"):
        summaries = [s for _, s in rows]
        total, way = chosen(summaries)
        dated = [s for s in summaries if s[DATED]]
        gaps = 0
        if dated:
            distinct = sum(s[DISTINCT] for s in dated) - sum(x[MOST] == y[LEAST] for x, y in zip(dated, dated[1:]))
            gaps = (dated[-1][MOST] - dated[0][LEAST] + 1 - distinct + (1 << 63)) % (1 << 64) - (1 << 63)
        illegal = sum(s[ILLEGAL] for s in summaries) + sum((x[LAST], y[FIRST]) not in LEGAL for x, y in zip(summaries, summaries[1:]))
        figures = [gaps, *(sum(s[k] for s in summaries) for k in (N_BLANK, N_DUPLICATE, N_TRUNCATED)), illegal, total]
        yield _batch([(conv, seg, -1, None, None, None, None, [*way[k], *(figures if k == len(rows) - 1 else ())]) for k, (seg, _) in enumerate(rows)], TURNS)


def edits(turns: list[tuple[str, int]], entry: int, end: int) -> list[tuple[str, int]]:
    """Letters and state after each turn (role, fault), from state ``entry`` to ``end``."""
    minima, ranks, taken = [0 if q == entry else NEVER for q in range(4)], list(range(4)), []
    for role, fault in turns:
        minima, ranks, best = step(minima, ranks, moves(_initial(role), fault))
        taken.append(best)
    out, q = [], end
    for best in reversed(taken):
        out.append((best[q][2], q))
        q = best[q][3]
    return out[::-1]


def _repaired(batches):
    """(conversation, segment, figures at its last segment, edits) by segment; an edit is (place, part, letter, turn, role, text)."""
    head, held = None, []

    def close():
        conv, seg, (entry, end, *figures) = head
        out, q = [], entry
        for (i, turn, role, text, fault), (letters, after) in zip(held, edits([(r[2], r[4]) for r in held], entry, end)):
            for part, letter in enumerate(letters):
                if letter == "I":
                    q = ASSISTANT if q == USER else USER
                    out.append((i, part, "I", None, ROLES[q], ""))
                else:
                    out.append((i, part, letter, turn, ROLES[after] if letter == "R" else role, text))
            q = after
        if figures:
            for part in range(CLOSING[q]):
                q = ASSISTANT if q == USER else USER
                out.append((len(held), part, "I", None, ROLES[q], ""))
        return conv, seg, figures, out

    for batch in batches:
        for conv, seg, i, turn, role, text, fault, plan in zip(*rows_of(batch, *(c.split()[0] for c in TURNS.split(", ")))):
            if i < 0:
                if head is not None:
                    yield close()
                head, held = (conv, seg, plan), []
            else:
                held.append((i, turn, role, text, fault))
    if head is not None:
        yield close()


@tidy()
def _report(batches):
    sha, audit, some, out = hashlib.sha256(), [], False, []
    for conv, _, figures, done in _repaired(batches):
        for _, _, letter, _, role, text in done:
            audit.append(letter)
            if letter != "D":
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if figures:
            out.append((conv, *figures, "".join(audit), sha.hexdigest()))
            sha, audit, some = hashlib.sha256(), [], False
        if len(out) >= 1000:
            yield _batch(out, REPORT)
            out = []
    yield _batch(out, REPORT)


@tidy()
def _edit_rows(batches):
    for conv, seg, _, done in _repaired(batches):
        yield _batch([(conv, seg, i, part, letter, turn, role, text) for i, part, letter, turn, role, text in done], EDITS)


def planned(rows: DataFrame) -> DataFrame:
    """The turns of all conversations in segments, and for each segment how it is repaired.

    Rows are ordered by conversation, turn (nulls first), role and text (its first 64 characters, then a digest).
    Range partitions hold successive turns, so a conversation of any length is spread
    over tasks.  The first row of each role and text comes from an aggregate over digests; it goes back
    to its row as a marker that sorts just before it, without a join.  A segment is
    summed up by 16 costs and ranks, from each state to each, which are then chained by conversation.
    """
    spark = rows.sparkSession
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"))
    head = F.concat_ws(":", of("conv_id"), F.length("role"), F.col("role"))
    rows = rows.select("*", F.substring("text", 1, 64).alias("start"), F.unhex(F.sha2(F.concat(head, F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    numbered = keep(rows, "numbered")  # the numbers of rows hold only if they are written once
    dated = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "row")
    first = numbered.groupBy("digest").agg(F.min(dated).alias("f"), *(F.min(c).alias(c) for c in ("conv_id", "role", "start")))
    marks = first.select("conv_id", "f.turn", "role", "start", "digest", "f.row", F.lit(0).alias("mark"))
    left = F.rtrim("text", F.lit(BLANK))
    turns = numbered.select("*", F.lit(1).alias("mark"), (left == "").alias("blank"), (~F.right(left, F.lit(1)).isin(*ENDS)).alias("truncated"))
    order = ["conv_id", "turn", "role", "start", "digest", "row"]
    placed = turns.unionByName(marks, allowMissingColumns=True).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "mark")
    table = keep(placed.mapInArrow(_segments, TURNS), "turns")
    forget(numbered)
    summaries = table.where("summary is not null").select("conv_id", "seg", "summary").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    plans = keep(summaries.mapInArrow(_plans, TURNS), "plans")
    return table.where("summary is null").unionByName(plans)


def repaired(rows: DataFrame) -> DataFrame:
    """The cheapest repair as edits in order (seg, i, part): K(ept), R(eroled), D(eleted), I(nserted), with the turn's new role.

    Dealt out by segment: no task holds a whole conversation.
    """
    return planned(rows).repartition("seg").sortWithinPartitions("seg", "i").mapInArrow(_edit_rows, EDITS)


def report(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation that has rows.

    Columns as in ``REPORT``.  A turn's first fault counts: blank, duplicate (role and text
    seen earlier), truncated.  Keeping a turn costs 0, another role 3, deletion 4 (the only
    choice for blank and duplicate turns), an inserted empty turn 3, an undeleted truncated turn 3
    more; role initials must become ``(s?(ua)+)?``.  ``audit`` has the edits' initials, of the cheapest the
    least; ``gaps`` counts turns between the least and the greatest that are missing (modulo 2**64).

    Nulls in role and text are one space (so such texts are blank); null turns come first; null conversations
    are one conversation; repeated rows are duplicates; an empty table gives no
    rows; other columns are ignored.  SHA-256 has one state, so here a conversation's turns
    stream through one task, a segment in memory at a time.
    """
    return planned(rows).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "i").mapInArrow(_report, REPORT)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged conversations; those without a row left have zeros and empty results."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = report(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(found, ids.conv_id.eqNullSafe(found._id), "left").select("conv_id", *(F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in found.columns[1:]))


def sql() -> str:
    """DuckDB SQL of ``repair_damaged``: one step of the recursion is one turn of every conversation."""
    white = " || ".join(f"chr({ord(c)})" for c in BLANK)
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    crc = f"xor(list_reduce(list_transform(range(0, strlen({key}) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr({key}, i, 1)) END), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    state = lambda cost, audit, told: f"{{'c': ({cost})::BIGINT, 'a': {audit}, 't': ({told})::VARCHAR[]}}"
    said = "[f.role || ':' || f.text]"

    def after(q: int) -> str:
        ways = [state(f"s{q}.c + {DELETE}", f"s{q}.a || 'D'", f"s{q}.t")]
        if q != START:
            for p in range(4):
                n = inserts(p, q)
                if n is None:
                    continue
                more = f"['{ROLES[USER if q == ASSISTANT else ASSISTANT]}:']" if n else "[]::VARCHAR[]"
                own = f"s{p}.c + {n * INSERT} + CASE WHEN f.fault IN ({IS_BLANK}, {IS_DUPLICATE}) THEN 1000000000 WHEN f.fault = {IS_TRUNCATED} THEN {TRUNCATED} ELSE 0 END"
                kept, other = f"s{p}.t || {more} || {said}", f"s{p}.t || {more} || ['{ROLES.get(q, '')}:' || f.text]"
                ways.append(state(f"{own} + CASE WHEN f.initial = {q} THEN 0 ELSE {REROLE if q in ROLES else 1000000000} END", f"s{p}.a || '{'I' * n}' || CASE WHEN f.initial = {q} THEN 'K' ELSE 'R' END", f"CASE WHEN f.initial = {q} THEN {kept} ELSE {other} END"))
        return f"list_sort([{', '.join(ways)}])[1]"

    closing = {SYSTEM: ["user:", "assistant:"], USER: ["assistant:"]}
    ends = ", ".join(state(f"s{q}.c + {CLOSING[q] * INSERT}", f"s{q}.a || '{'I' * CLOSING[q]}'", f"s{q}.t || {closing.get(q, [])}::VARCHAR[]") for q in range(4))
    legal = " OR ".join(f"(former = {x} AND initial = {y})" for x, y in sorted(LEGAL))
    return f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, {white}) AS shown
  FROM rows_
), faulty AS (
  SELECT *, CASE WHEN shown = '' THEN {IS_BLANK} WHEN seen > 1 THEN {IS_DUPLICATE} WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN {IS_TRUNCATED} ELSE 0 END AS fault,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial
  FROM numbered
), paired AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS former FROM faulty
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = {IS_BLANK})::BIGINT AS blank, count(*) FILTER (fault = {IS_DUPLICATE})::BIGINT AS duplicate,
    count(*) FILTER (fault = {IS_TRUNCATED})::BIGINT AS truncated, count(*) FILTER (former IS NOT NULL AND NOT ({legal}))::BIGINT AS illegal, max(n) AS turns
  FROM paired GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS n, {", ".join(state(0 if q == START else 1_000_000_000, "''", "[]") + f" AS s{q}" for q in range(4))} FROM figures
  UNION ALL
  SELECT f.conv_id, f.n, {", ".join(after(q) for q in range(4))} FROM steps JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.n = steps.n + 1
), done AS (
  SELECT figures.*, list_sort([{ends}])[1] AS best FROM steps JOIN figures ON figures.conv_id IS NOT DISTINCT FROM steps.conv_id AND figures.turns = steps.n
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
