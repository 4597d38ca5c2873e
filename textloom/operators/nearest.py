"""Rule files by folder: each document follows those of the folders above it, the nearest first."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import empty
from ..plans.rules import Rule, Settings
from ..sources.rule_files import RuleFileError, compiled, parse
from .comments import file_type
from .engine import ByRow, once, process

#: Rules of all files together, at most: each is an expression of the one plan.
MOST_RULES = 500


def folder_of(path: Column) -> Column:
    """What stands before the last separator; empty for a path without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def above(folder: Column) -> Column:
    """The folder and all folders above it, down from the root (the empty string)."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def read_rules(files: DataFrame) -> tuple[list[tuple[str, Rule]], list[tuple[str, str]]]:
    """(folder, rule) in order of name and (folder, disabled identifier) of a table of folder and content.

    The files come to the driver, as a plan is made of them; more than MOST_RULES lines that
    begin rules are refused before.  Errors of all files are reported together.
    """
    begun = files.select(F.coalesce(F.sum(F.size(F.regexp_extract_all("content", F.lit(r"(?m)^rule\s"), F.lit(0)))), F.lit(0))).first()[0]
    if begun > MOST_RULES:
        raise RuleFileError(f"{begun} rules are more than one plan takes ({MOST_RULES})")
    rules, disabled, wrong = [], [], []
    for row in sorted(files.select("folder", "content").collect()):
        found, off, errors = parse(row["content"] or "")
        wrong += [f"{row['folder'] or '.'}:{at}: {message}" for at, message in errors]
        rules += [(row["folder"], compiled(p)) for p in found]
        disabled += [(row["folder"], i) for i in off]
    if wrong:
        raise RuleFileError("\n".join(wrong))
    return sorted(rules, key=lambda r: (r[1].id, r[0])), disabled


def in_force(up: Column, rules: list[tuple[str, Rule]], disabled: list[tuple[str, str]]) -> tuple[Column, Column]:
    """For the folders of ``up``, from the root down: the rules (by place in ``rules``) in force there, and identifiers disabled.

    Of rules of one name that of the nearest folder counts; disabled identifiers add up.  The rule files
    are in the plan, so nothing is joined and no document is dealt out by its folder.
    """
    named, gone = {}, {}
    for k, (f, r) in enumerate(rules):
        named.setdefault(r.id, {})[f] = k
    for f, i in disabled:
        gone.setdefault(i, set()).add(f)
    among = lambda folders: lambda at: at.isin(*sorted(folders))
    place = lambda by: F.create_map(*(F.lit(x) for pair in by.items() for x in pair))
    active = [F.try_element_at(place(by), F.try_element_at(F.filter(up, among(by)), F.lit(-1))) for by in named.values()]
    off = [F.when(F.exists(up, among(folders)), F.lit(i)) for i, folders in gone.items()]
    return tuple(F.array_compact(F.array(*found)).cast(kind) if found else empty(kind) for found, kind in ((active, "array<int>"), (off, "array<string>")))


def by_folder(folders: DataFrame, rules: list[tuple[str, Rule]], disabled: list[tuple[str, str]]) -> DataFrame:
    """For each ``folder``: ``active`` and ``off``, what is ``in_force``."""
    active, off = in_force(F.col("_up"), rules, disabled)
    return once(folders.select("folder", above(F.col("folder")).alias("_up")), "_up").select("folder", active.alias("active"), off.alias("off"))


def process_nearest(docs: DataFrame, files: DataFrame, settings: Settings) -> DataFrame:
    """``process`` where each document (path, ext, content) also follows the rule files above it.

    ``files`` has ``folder`` and ``content``.  One plan for all documents: each tells the rules in force
    by its folder, and the expression of a rule of a file is evaluated only where it is in force: no
    document is gone through for the rules of other folders.  Documents with a null path follow no file.
    """
    rules, disabled = read_rules(files)
    places = {id(r): k for k, (_, r) in enumerate(rules)}
    docs = once(docs.withColumn("_up", above(folder_of(F.col("path")))), "_up")
    active_here, off = in_force(F.col("_up"), rules, disabled)
    docs = once(docs.withColumn("_active", active_here).withColumn("_off", off).drop("_up"), "_active", "_off")

    def active(rule: Rule) -> Column:
        on = ~F.array_contains("_off", rule.id)
        return on & F.array_contains("_active", places[id(rule)]) if id(rule) in places else on

    row = ByRow(active, F.lit(settings.min_confidence), file_type(F.col("ext"), settings.lang), lambda rule: id(rule) in places)
    return process(docs, replace(settings, file_rules=tuple(r for _, r in rules)), row).drop("_active", "_off")
