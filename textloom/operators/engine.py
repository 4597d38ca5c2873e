"""Documents to matches to cleaned text, as columns of one projection: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import BETWEEN, MARK, PLACE, apart, begins, bound, empty, finds, gathered, growing, grown, has, java, overlap, places, spans
from ..plans.rules import DELETE_BLOCK, DELETE_LINE, FLAG, Rule, Settings, any_of, codes_of, in_class
from .comments import comment_spans, file_type

MATCH = (
    "struct<start:int,reg:int,seq:int,end:int,rule_id:string,category:string,severity:string,confidence:double,"
    "original:string,suggestion:string,kind:string,description:string>"
)
MATCHES = f"array<{MATCH}>"


def _of_rule(text: Column, reg: int, rule: Rule) -> Column:
    """The rule's spans as matches, numbered in the order in which they are emitted."""
    return _emitted(rule.spans(text), reg, rule)


def _emitted(found: Column, reg: int, rule: Rule) -> Column:
    return F.transform(found, _match(reg, rule)).cast(MATCHES)


def _match(reg: int, rule: Rule):
    """A span of the rule as a match."""
    varies = rule.id in ("trivial-comment",)
    described = varies or rule.id == "python-args-boilerplate"

    def match(s: Column, i: Column) -> Column:
        o = s["original"]
        suggestion = s["suggestion"] if rule.captures else rule.suggest(o) if rule.suggest else F.lit(rule.value)
        kind = rule.kind_of(o) if rule.kind_of else F.lit(rule.kind)
        return F.struct(
            s["start"].alias("start"), F.lit(reg).alias("reg"), i.alias("seq"), s["end"].alias("end"), F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"), (s["confidence"] if varies else F.lit(float(rule.confidence))).alias("confidence"), o.alias("original"),
            suggestion.alias("suggestion"), kind.alias("kind"), (s["description"] if described else rule.describe(o) if rule.describe else F.lit(rule.description)).alias("description"),
        )

    return match


def _symbols(rules: list[tuple[int, Rule, Column]]) -> str:
    """One class that finds the characters of all rules for single characters."""
    return any_of([rule.symbols[0] for _, rule, _ in rules])


def _of_symbols(found: Column, rules: list[tuple[int, Rule, Column]]) -> Column:
    """Matches of all rules for single characters: each hit is a match of those rules whose class has it, where the
    rule's condition holds."""

    def told(s: Column, i: Column) -> Column:
        return F.array(*(F.when(in_class(*rule.symbols)(s["original"]) & holds, _match(reg, rule)(s, i).cast(MATCH)) for reg, rule, holds in rules))

    return F.array_compact(F.flatten(F.transform(found, told)))


def _in_one_pass(text: Column, symbols: list[tuple[int, Rule, Column]], phrases: list[tuple[int, Rule, Column]]) -> Column:
    """Matches of all rules for single characters and phrases: the text is gone through once, and each rule takes
    its own of what was found.  A text that has a mark in it is gone through for each pattern."""
    patterns = [("", _symbols(symbols))] if symbols else []
    at = {}
    for reg, rule, _ in phrases:
        at[reg] = range(len(patterns), len(patterns) + len(rule.patterns))
        patterns += rule.patterns

    def dealt(found: Column) -> Column:
        out = []
        if symbols:
            hits = F.filter(found, lambda h: h["found"][0] != "")
            out.append(_of_symbols(F.transform(hits, lambda h: F.struct(h["at"].alias("start"), (h["at"] + 1).alias("end"), h["found"][0].alias("original"))), symbols))
        for reg, rule, holds in phrases:
            own = [apart(found, k) for k in at[reg]]
            out.append(F.when(holds, _emitted(F.concat(*own) if len(own) > 1 else own[0], reg, rule)).otherwise(empty(MATCHES)))
        return F.flatten(F.array(*out))

    alone = [F.when(holds, _of_rule(text, reg, rule)).otherwise(empty(MATCHES)) for reg, rule, holds in phrases]
    if symbols:
        alone.append(_of_symbols(spans(text, java("", _symbols(symbols))), symbols))
    codes = frozenset() if not symbols else codes_of([rule.symbols[0] for _, rule, _ in symbols])
    codes = codes if all(begins(*p) for p in patterns[bool(symbols) :]) else None
    one = F.element_at(F.transform(F.array(finds(text, patterns, codes)), lambda found: F.when(F.size(found) == 0, empty(MATCHES)).otherwise(dealt(found))), 1)
    return F.when(has(text, MARK, BETWEEN), F.flatten(F.array(*alone))).when(text.isNotNull(), one).otherwise(empty(MATCHES))


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` behind a generator of one row, so that filters and further uses of a column
    read its value: the optimizer would put the whole expression in place of each use."""
    rest = [c for c in df.columns if c not in columns]
    one = df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_once"))
    return one.select(*rest, *(F.col(f"_once.{c}").alias(c) for c in columns))


@dataclass(frozen=True)
class ByRow:
    """What may differ from row to row within one plan: which rules are active, the least confidence, the file type.

    Rules that are ``alone`` have a pass of their own in the rows where they are active; others may be looked
    for in all rows, whoever has them, as they share a pass.
    """

    active: Callable[[Rule], Column]
    least: Column
    file_type: Column
    alone: Callable[[Rule], bool] = lambda rule: False


def raw_matches(df: DataFrame, settings: Settings, by_row: ByRow | None = None) -> DataFrame:
    """``df`` (path, ext, content, ...) with file_type, comment_spans and the gated, expanded matches.

    Each rule's expression is evaluated only in rows where ``by_row`` has it active.
    """
    least = by_row.least if by_row else settings.min_confidence
    df = df.withColumn("file_type", by_row.file_type if by_row else file_type(F.col("ext"), settings.lang)).withColumn("comment_spans", comment_spans(F.col("content"), F.col("ext")))
    text, found, symbols, phrases = F.col("content"), [], [], []
    for reg, rule in settings.rules():
        if rule.confidence < settings.min_confidence and rule.id != "trivial-comment":
            continue  # the same for every match: pruned here
        holds = F.lit(True)
        if rule.code_only:
            holds = holds & (F.col("file_type") == "code")
        if rule.files:
            holds = holds & F.col("path").rlike(rule.files)
        if by_row:
            holds = holds & by_row.active(rule)
        alone = by_row is not None and by_row.alone(rule)
        if rule.symbols and not alone:
            symbols.append((reg, rule, holds))
        elif rule.joins and not alone:
            phrases.append((reg, rule, holds))
        else:
            found.append(F.when(holds, _of_rule(text, reg, rule)).otherwise(empty(MATCHES)))
    if symbols or phrases:
        found.append(_in_one_pass(text, symbols, phrases))
    matches = F.flatten(F.array(*found)) if found else empty(MATCHES)
    matches = F.coalesce(matches, empty(MATCHES))  # null content
    df = df.withColumn("matches", matches)
    keep = lambda m: (m["confidence"] >= least) & (
        (F.col("file_type") != "code") | (m["category"] != "prose") | F.exists("comment_spans", lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"]))
    )
    return once(df.withColumn("matches", F.transform(F.filter("matches", keep), _whole_lines(text))), "matches")


def _whole_lines(text: Column):
    """Widen deletions to whole lines, the newline after them included."""

    def widen(m: Column) -> Column:
        deletes = m["kind"].isin(DELETE_LINE, DELETE_BLOCK)
        before = F.substring(text, F.lit(1), m["start"])
        start = m["start"] - F.length(F.substring_index(before, "\n", -1))
        end = F.when(F.substring(text, m["end"], F.lit(1)) == "\n", m["end"] - 1).otherwise(m["end"])
        newline = F.call_function("locate", F.lit("\n"), text, end + 1)
        end = F.when(newline > 0, newline).otherwise(F.length(text))
        return m.withField("start", F.when(deletes, start).otherwise(m["start"])).withField("end", F.when(deletes, end).otherwise(m["end"]))

    return widen


def resolved(matches: Column) -> Column:
    """One match of every chain of overlapping ones: of least priority number, then of least start.

    A fold over the matches in (start, priority, emission) order, or just that order if none overlap; touching is no
    overlap.  It holds the numbers of matches: what a fold holds is copied at every step.
    """

    def chosen(ordered: Column) -> Column:
        numbers = F.transform(ordered, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["reg"].alias("reg"), i.alias("i")))
        state = F.struct(F.lit(0).alias("to"), F.lit(None).cast("int").alias("reg"), F.lit(None).cast("int").alias("best"), growing("array<int>").alias("out"))

        def add(acc: Column, m: Column) -> Column:
            same = acc["best"].isNotNull() & (m["start"] < acc["to"])
            stays = same & (acc["reg"] <= m["reg"])
            return F.struct(
                F.when(same, F.greatest(acc["to"], m["end"])).otherwise(m["end"]).alias("to"),
                F.when(stays, acc["reg"]).otherwise(m["reg"]).alias("reg"),
                F.when(stays, acc["best"]).otherwise(m["i"]).alias("best"),
                F.when(same | acc["best"].isNull(), acc["out"]).otherwise(grown(acc["out"], acc["best"])).alias("out"),
            )

        best = F.aggregate(numbers, state, add, lambda acc: gathered(grown(acc["out"], acc["best"])))
        return F.array_sort(F.transform(best, lambda i: F.get(ordered, i)))

    return bound(F.array_sort(matches), lambda ordered: F.when(overlap(ordered), chosen(ordered)).otherwise(ordered))


def applied(text: Column, matches: Column) -> Column:
    """The text with every fix made, blank lines collapsed if a line was deleted.

    The text is cut at the fixes from fixed-width code units, where a place is found without counting from
    the start.  Characters beyond ASCII stay as they are when blank lines collapse.
    """
    fixes = F.filter(matches, lambda m: m["kind"] != FLAG)

    def fixed(b: Column) -> Column:
        part = lambda start, end: F.decode(F.substring(b["units"], 4 * start + 1, 4 * (end - start)), "UTF-32")
        before = F.concat(F.array(F.lit(0)), F.transform(b["fixes"], lambda m: m["end"]))
        put = F.zip_with(b["fixes"], F.slice(before, 1, F.size(b["fixes"])), lambda m, at: F.concat(part(at, m["start"]), F.when(m["kind"] == "Replace", m["suggestion"]).otherwise("")))
        last = F.element_at(b["fixes"], -1)["end"]
        return F.concat(F.array_join(put, ""), F.decode(F.substring(b["units"], 4 * last + 1, F.octet_length(b["units"])), "UTF-32"))

    def tidied(spliced: Column) -> Column:
        deletes = F.exists(matches, lambda m: m["kind"].isin(DELETE_LINE, DELETE_BLOCK))
        tidy = F.regexp_replace(F.regexp_replace(spliced, r"\n(?:[ \t\r]*\n)+", "\n\n"), r"\n+\z", "\n")
        return F.when(deletes & F.contains(spliced, F.lit("\n\n\n")), tidy).otherwise(spliced)

    once_each = F.transform(F.array(F.struct(F.encode(text, "UTF-32").alias("units"), fixes.alias("fixes"))), fixed)
    return F.when(F.exists(matches, lambda m: m["kind"] != FLAG), F.element_at(F.transform(once_each, tidied), 1)).otherwise(text)


def process(df: DataFrame, settings: Settings, by_row: ByRow | None = None) -> DataFrame:
    """``df`` with file_type, resolved ``matches``, ``cleaned`` and ``density`` (matches in 1000 characters)."""
    df = once(raw_matches(df, settings, by_row).withColumn("matches", resolved(F.col("matches"))), "matches")
    n = F.length("content")
    density = F.when(n > 0, 1000.0 * F.size("matches") / n).otherwise(0.0)
    return df.withColumn("cleaned", applied(F.col("content"), F.col("matches"))).withColumn("density", F.coalesce(density, F.lit(0.0)))


def placed(*ends: str, need: tuple[str, ...] = PLACE) -> Column:
    """The matches in order, each with the places (what is needed of them) of its ``start`` and, if asked, ``end``."""

    def of(matches: Column) -> Column:
        out = F.transform(matches, lambda m: F.struct(m.alias("m")))
        for e in ends:
            at = places(F.col("content"), F.transform(matches, lambda m: m[e]), need)  # noqa: B023
            out = F.zip_with(out, at, lambda x, p: x.withField(e, p))  # noqa: B023
        return out

    return F.element_at(F.transform(F.array(F.array_sort("matches")), of), 1)


def match_rows(df: DataFrame, *keys: str) -> DataFrame:
    """A row per match, with line and column; the text leaves the plan here."""
    rows = once(df.withColumn("_p", placed("start", need=("line", "col"))), "_p").select(*keys, F.explode("_p").alias("p"))
    return rows.select(*keys, "p.m.*", F.col("p.start.line").alias("line"), F.col("p.start.col").alias("col"))


def diagnostics(df: DataFrame, *keys: str) -> DataFrame:
    """Editor diagnostics: 0-based positions in UTF-16 units, severity by kind and confidence."""
    rows = once(df.withColumn("_p", placed("start", "end", need=("line", "unit"))), "_p").select(*keys, F.explode("_p").alias("p")).select(*keys, "p.*")
    at = [(F.col(f"{e}.line") - 1).alias(f"{e}_line") for e in ("start", "end")] + [F.col(f"{e}.unit").alias(f"{e}_character") for e in ("start", "end")]
    severity = F.when(F.col("m.kind") == FLAG, "Warning").when(F.col("m.confidence") >= 0.85, "Error").otherwise("Warning")
    return rows.select(*keys, *at, severity.alias("severity"), F.col("m.rule_id").alias("rule_id"), F.col("m.description").alias("message"), F.col("m.kind").alias("kind"), F.col("m.suggestion").alias("new_text"))


def begun_by(df: DataFrame, line: int, character: int) -> DataFrame:
    """``df`` with those matches alone that may begin at or before a 0-based line and UTF-16 column.

    A line has no more characters than units, so none that does is left out.
    """
    text = F.col("content")
    above = F.length(F.substring_index(text, "\n", line)) + 1 if line else F.lit(0)
    return df.withColumn("matches", F.filter("matches", lambda m: m["start"] <= above + character))


def code_actions(found: DataFrame, start_line: int, start_character: int, end_line: int, end_character: int) -> DataFrame:
    """Edits of the diagnostics that touch a range (both ends count); flags have none."""
    before = F.struct("start_line", "start_character") <= F.struct(F.lit(end_line), F.lit(end_character))
    after = F.struct("end_line", "end_character") >= F.struct(F.lit(start_line), F.lit(start_character))
    return found.where((F.col("kind") != FLAG) & before & after)


def offset_at(text: Column, line: int, character: int) -> Column:
    """Byte offset of a 0-based line and UTF-16 column; the end of the line if it is shorter."""
    lines = F.split(text, "\n", -1)
    above = F.octet_length(F.array_join(F.slice(lines, 1, line), "\n")) + (1 if line else 0)
    this = F.get(lines, F.lit(line))
    part = F.decode(F.substring(F.encode(this, "UTF-16BE"), 1, 2 * character), "UTF-16BE")
    return F.when(F.size(lines) > line, above + F.octet_length(part)).otherwise(F.octet_length(text))


def apply_decisions(df: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """Keep the accepted matches of each document and apply them.

    ``decisions`` has the keys, ``start``, ``accept`` and ``edit``: an edit turns the
    match into a replacement.  Matches without a decision are not accepted.
    """
    d = decisions.where("accept").groupBy(*keys).agg(F.collect_list(F.struct("start", "edit")).alias("_d"))
    df = df.join(d, list(keys), "left")
    hit = lambda m: F.filter("_d", lambda x: x["start"] == m["start"])

    def edited(m: Column) -> Column:
        e = F.get(hit(m), F.lit(0))["edit"]
        return m.withField("kind", F.when(e.isNotNull(), "Replace").otherwise(m["kind"])).withField("suggestion", F.coalesce(e, m["suggestion"]))

    accepted = F.transform(F.filter("matches", lambda m: F.coalesce(F.size(hit(m)), F.lit(0)) > 0), edited)
    df = df.withColumn("matches", F.when(F.col("_d").isNull(), empty(MATCHES)).otherwise(accepted)).drop("_d")
    return df.withColumn("cleaned", applied(F.col("content"), F.col("matches")))
