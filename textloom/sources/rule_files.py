"""The language of user-defined rules: parsing, checking and merging of rule files.

    disable RULE-ID
    rule NAME
      match: "literal" | 'literal' | regular expression | triple-quoted block
      fix: delete | delete-line | flag | replacement with $1 .. $9
      message: text
      confidence: 0 .. 1
      files: *.md, docs/**
      severity: warn | error

A pattern is a regular expression if it has one of | ( [ * + ? ^ $ . and then
respects case; else it is a literal and ignores case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from ..functions.extract import java
from ..plans.rules import DELETE_LINE, FLAG, REPLACE, Rule, quote
from .files import glob_pattern

NAME = ".textloom-rules"
FIELDS = ("match", "fix", "message", "confidence", "files", "severity")
_META = set("|([*+?^$.")
_QUOTES = '"""'


class RuleFileError(ValueError):
    """All errors of a file, one on each line."""


@dataclass
class Parsed:
    name: str
    pattern: str
    fix: str
    message: str | None = None
    confidence: float = 0.75
    files: tuple[str, ...] = ()
    severity: str = "warn"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(field: str) -> str | None:
    """The known field that is at most two edits away, the first of the closest."""
    near = min(FIELDS, key=lambda f: distance(field, f))
    return near if distance(field, near) <= 2 else None


def is_regex(pattern: str) -> bool:
    return bool(_META & set(pattern))


def unquoted(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def _blocks(text: str, errors: list[tuple[int, str]]):
    """(line, name, [(field, value, line)]) of rules, and (line, "", id) of disables."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        line, at = lines[i].strip(), i + 1
        i += 1
        if not line or line.startswith("#"):
            continue
        if line == "disable" or line.startswith("disable "):
            if not (target := line[7:].strip()):
                errors.append((at, "empty disable directive"))
            else:
                yield at, "", target
            continue
        if not (line == "rule" or line.startswith("rule ")):
            errors.append((at, f"unexpected: {line}"))
            continue
        if not (name := line[4:].strip()):
            errors.append((at, "rule has no name"))
            continue
        fields = []
        while i < len(lines):
            raw, inner = lines[i], lines[i].strip()
            if not inner or inner.startswith("#"):
                i += 1
                continue
            if raw[0] not in " \t":
                break
            key, colon, value = inner.partition(":")
            where, value = i + 1, value.strip()
            i += 1
            if not colon:
                errors.append((where, f"expected 'field: value', got: {inner}"))
                continue
            if value.startswith(_QUOTES) and _QUOTES not in value[3:]:
                while i < len(lines):
                    value += "\n" + lines[i].strip()
                    i += 1
                    if _QUOTES in lines[i - 1]:
                        break
                else:
                    errors.append((where, "unclosed multiline match"))
            fields.append((key.strip(), value, where))
        yield at, name, fields


def pattern_error(pattern: str) -> str | None:
    """Why the dialect that runs the rules refuses ``pattern``; None if it takes it.

    With a session its own regular expressions decide; without one Python's, which are
    close, but for named groups.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java("", pattern))
        except IllegalArgumentException as bad:
            return str(bad).splitlines()[0]
        return None
    try:
        re.compile(pattern)
    except re.error as bad:
        return str(bad)
    return "named groups are written (?<name>...)" if "(?P" in pattern else None


def may_be_empty(pattern: str) -> bool:
    """Whether some match can have no characters, as far as Python can read the pattern; such
    matches have no span to report."""
    try:
        return re._parser.parse(pattern).getwidth()[0] == 0
    except re.error:
        return False


def parse(text: str) -> tuple[list[Parsed], list[str], list[tuple[int, str]]]:
    """Rules, disabled identifiers, and every error as (line, message)."""
    rules, disabled, errors = [], [], []
    for at, name, fields in _blocks(text, errors):
        if not name:
            disabled.append(fields)
            continue
        rule, before = Parsed(name, "", ""), len(errors)
        seen = set()
        for key, value, where in fields:
            seen.add(key)
            if key == "match":
                body = value[3:].rpartition(_QUOTES)[0] if value.startswith(_QUOTES) else None
                rule.pattern = "".join(x.strip() for x in body.splitlines()) if body is not None else unquoted(value)
            elif key == "fix":
                rule.fix = value
            elif key == "message":
                rule.message = unquoted(value)
            elif key == "confidence":
                try:
                    rule.confidence = float(value)
                except ValueError:
                    rule.confidence = -1
                if not 0 <= rule.confidence <= 1:
                    errors.append((where, f"confidence must be a number from 0 to 1, got: {value}"))
            elif key == "files":
                rule.files = tuple(unquoted(g) for g in value.split(",") if g.strip())
            elif key == "severity":
                if value not in ("warn", "error"):
                    errors.append((where, f"severity must be warn or error, got: {value}"))
                rule.severity = value
            else:
                near = suggestion(key)
                errors.append((where, f"unknown field '{key}'" + (f", did you mean '{near}'?" if near else "")))
        errors += [(at, f"rule '{name}' has no {k}") for k in ("match", "fix") if k not in seen]
        if rule.pattern and is_regex(rule.pattern):
            if bad := pattern_error(rule.pattern):
                errors.append((at, f"rule '{rule.name}' has an invalid pattern: {bad}"))
            elif may_be_empty(rule.pattern):
                errors.append((at, f"rule '{rule.name}' has an invalid pattern: it can match the empty string"))
        if len(errors) == before:
            rules.append(rule)
    return rules, disabled, sorted(errors)


def validate(text: str) -> list[tuple[int, str]]:
    """What is wrong with a file; also flags a replacement that is not in quotes."""
    errors = parse(text)[2]
    for _, name, fields in _blocks(text, []):
        for key, value, where in fields if name else ():
            if key == "fix" and value not in ("delete", "delete-line", "flag") and value[:1] not in ("'", '"'):
                errors.append((where, f"replacement must be in quotes: {value}"))
    return sorted(errors)


def _validated(batches):
    import pyarrow as pa

    for batch in batches:
        found = [(p, at, message) for p, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for at, message in validate(text or "")]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "line", "message"])


def validated(files: DataFrame) -> DataFrame:
    """path, line, message of everything that is wrong with a table of rule files (path, content): a row
    each, none for a file without errors or without content.  Tasks have no session, so patterns are
    checked by Python's regular expressions (``pattern_error``): close to those that run the rules, not the same."""
    return files.select("path", "content").mapInArrow(_validated, "path string, line int, message string")


def compiled(rule: Parsed, enforce_files: bool = True) -> Rule:
    """The rule as column expressions.  Its pattern must not match the empty string."""
    regex = is_regex(rule.pattern)
    pattern = ("", rule.pattern) if regex else ("i", quote(rule.pattern))
    if not rule.pattern:
        raise RuleFileError(f"rule '{rule.name}' matches the empty string")
    kind = {"delete-line": DELETE_LINE, "flag": FLAG}.get(rule.fix, REPLACE)
    value = unquoted(rule.fix) if rule.fix not in ("delete", "delete-line", "flag") else ""
    files = "|".join(glob_pattern(g) for g in rule.files) if rule.files and enforce_files else None
    out = Rule(rule.name, "custom", rule.confidence, kind, rule.message or f"Custom rule '{rule.name}' matched", (pattern,), value, severity=rule.severity, files=files)
    groups = _groups(rule.pattern) if regex else 0
    used = tuple(i for i in range(9, 0, -1) if f"${i}" in value and i <= groups)
    return replace(out, captures=used) if kind == REPLACE and used else out


def _groups(pattern: str) -> int:
    """Capturing groups of a pattern: opening brackets outside classes that are not special."""
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", plain))


def discover_rule_files(start: str) -> list[Path]:
    """Rule files from the root down to ``start``."""
    here = Path(start).resolve()
    return [f for d in reversed((here, *here.parents)) if (f := d / NAME).is_file()]


def merged(files: list[Path], enforce_files: bool = True) -> tuple[list[Rule], list[str]]:
    """Rules of all files by name, the deeper file's for equal names; disables add up."""
    return merged_texts([(str(f), f.read_text()) for f in files], enforce_files)


def merged_texts(files: list[tuple[str, str]], enforce_files: bool = True) -> tuple[list[Rule], list[str]]:
    """``merged`` of (path, text), outer files first; raises with all errors of all files."""
    rules, disabled, errors = {}, [], []
    for f, text in files:
        found, off, bad = parse(text)
        errors += [f"{f}: line {n}: {m}" for n, m in bad]
        rules |= {r.name: r for r in found}
        disabled += off
    if errors:
        raise RuleFileError("\n".join(errors))
    return [compiled(rules[n], enforce_files) for n in sorted(rules)], disabled


def rules_from(text: str, enforce_files: bool = True) -> tuple[tuple[Rule, ...], tuple[str, ...]]:
    """Rules and disables of one file's text; raises with all its errors."""
    found, off, bad = parse(text)
    if bad:
        raise RuleFileError("\n".join(f"line {n}: {m}" for n, m in bad))
    by = {r.name: r for r in found}
    return tuple(compiled(by[n], enforce_files) for n in sorted(by)), tuple(off)


