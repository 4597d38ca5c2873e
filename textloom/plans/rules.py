"""The built-in rules, in priority order, and their selection by profile."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.extract import grouped, guarded, java, joins, spans
from ..operators import comments

REPLACE, DELETE_LINE, DELETE_BLOCK, FLAG = "Replace", "DeleteLine", "DeleteBlock", "FlagOnly"


#: One character or a class, perhaps without some of its characters.
_SINGLE = re.compile(r"(?P<plain>[^\\\[\](){}.*+?^$|])|(?:\(\?!\[(?P<allowed>(?:\\.|[^\\\]])*)\]\))?\[(?P<symbols>[^\\\[\]^&]+)\]", re.S)


@dataclass(frozen=True)
class Rule:
    """``find`` gives spans: structs of start, end, original and, if they vary, confidence and description."""

    id: str
    category: str
    confidence: float
    kind: str
    description: str
    patterns: tuple[tuple[str, str], ...] = ()
    value: str = ""
    code_only: bool = False
    find: Callable[[Column], Column] | None = None
    suggest: Callable[[Column], Column] | None = None
    kind_of: Callable[[Column], Column] | None = None
    describe: Callable[[Column], Column] | None = None
    severity: str = "warn"
    files: str | None = None
    explain: tuple[str, str, float, str, str] | None = None
    captures: tuple[int, ...] = ()
    #: Literals of which every match has one.
    needs: tuple[str, ...] = ()

    @property
    def symbols(self) -> tuple[str, str] | None:
        """For rules that find single characters: their class, and what of it is allowed."""
        if self.find or self.captures or len(self.patterns) != 1 or self.patterns[0][0]:
            return None
        found = _SINGLE.fullmatch(self.patterns[0][1])
        return (found["plain"] or found["symbols"], found["allowed"] or "") if found else None

    @property
    def joins(self) -> bool:
        """Whether its patterns are looked for in one pass with those of other rules."""
        return not (self.find or self.captures or self.needs) and all(joins(*p) for p in self.patterns)

    def spans(self, text: Column) -> Column:
        if self.find:
            return self.find(text)
        if self.captures:
            return self._filled(text)
        found = [spans(text, guarded(*p), needs=self.needs) for p in self.patterns]
        return found[0] if len(found) == 1 else F.concat(*found)


    def _filled(self, text: Column) -> Column:
        """Spans with ``suggestion``: ``value`` with the groups $9 .. $1 of each match, as the pattern finds
        them in the whole text; a group that took no part leaves nothing."""

        def filled(s: Column) -> Column:
            value = F.lit(self.value)
            for k, i in enumerate(self.captures):
                value = F.replace(value, F.lit(f"${i}"), s["groups"][k])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["original"].alias("original"), value.alias("suggestion"))

        return F.transform(grouped(text, java(*self.patterns[0]), self.captures), filled)


# Symbols, phrases, synonyms and patterns of the rules.
EMOJI = "\U0001f000-\U0001faff\u2600-\u27bf\u2300-\u23ff\u2460-\u24ff\u25a0-\u25ff"
DECORATIVE = "★✓✔→◆▸•●○◯■□▪▫▲▼◀▶♦♣♠♥※†‡§¶"
SYNONYMS = {
    "utilize": "use", "facilitate": "help", "leverage": "use", "implement": "build", "commence": "start", "endeavor": "try",
    "terminate": "end", "obtain": "get", "regarding": "about", "additional": "more", "individuals": "people", "methodology": "method",
}
FLAGGED = ("seamlessly", "robust", "straightforward", "scalable", "cutting-edge", "state-of-the-art", "comprehensive", "streamline", "synergy", "paradigm", "holistic", "proactive")
OPENERS = (("im", r"(?:^|\n)\s*(?:Certainly|Absolutely|Of course|Great question|Sure|Definitely)!?\s*"), ("im", r"(?:^|\n)\s*(?:I'?d be happy to|Happy to help)[.,!]?\s*"))
CLOSERS = (("im", r"\b(?:I hope this helps|Feel free to ask|Let me know if you have questions|Don't hesitate to reach out|Hope that clarifies things)[.,!]?\s*"),)
HEDGES = (("im", r"\b(?:it is worth noting that|it is important to remember that|it is important to note that|keep in mind that|note that|please note that|it should be noted that)\s*"),)
TRANSITIONS = (("im", r"(?:^|\n)\s*(?:In conclusion|To summarize|To recap|At the end of the day|In summary|All in all|Ultimately)[,\s]+"),)
RUST_DOC = (("im", r"^[ \t]*///[ \t]*(This (?:function|method|struct|enum|trait|impl|module) [a-zA-Z0-9_\s,]+\.|Returns? (?:the|a|an) [a-zA-Z0-9_\s]+\.)[ \t]*$"),)
RUST_MODULE = (("im", r"^[ \t]*//![ \t]*(This module (?:contains|provides|implements|defines|handles) .+\.|The [a-zA-Z0-9_]+ module\.)"),)
PY_ARGS = ("ms", r'"""[\s\S]*?Args:\s*\n(?:[ \t]+\w+(?:\s*:\s*(?:The|A|An)\s+(?:input|output|data|result|value|parameter|argument|return)[^.\n]*\.?)\s*\n)+[\s\S]*?"""')
PY_RETURNS = ("ms", r'"""[\s\S]*?Returns:\s*\n[ \t]+(?:The|A|An)\s+(?:output|result|data|value|processed\s+data|return\s+value)[^.\n]*\.?[\s\S]*?"""')
PY_EMPTY = ("m", r'^([ \t]*(?:Args|Returns|Raises|Yields|Notes|References|Examples|Attributes):\s*\n)(?:[ \t]*(?:Args|Returns|Raises|Yields|Notes|References|Examples|Attributes):|[ \t]*""")')
JS_PARAM = (("im", r"^[ \t]*\*[ \t]*@param[ \t]+[a-zA-Z0-9_]+[ \t]+(?:The|A|An)[ \t]+(?:data|input|output|result)\.?"),)
JS_LOG = (("im", r"""^[ \t]*console\.log\(['"](here|test|debug|\w+ing)['"]\);?[ \t]*$"""),)
GO_DOC = (("im", r"^[ \t]*//[ \t]+[A-Z][a-zA-Z0-9_]*[ \t]+(?:returns|handles|processes|is|creates|initializes)[ \t]+(?:the|a|an)[ \t]+[A-Z][a-zA-Z0-9_]*\.?"),)
SQL_DOC = ("im", r"^[ \t]*--[ \t]*Selects? (?:all|the) [a-zA-Z0-9_]+[ \t]*\n[ \t]*SELECT \* FROM [a-zA-Z0-9_]+")

_WORDS = (("i", r"\b(" + "|".join([*SYNONYMS, *FLAGGED]) + r")\b"),)

# What rules say of a match, and the explanations that some have: what is found, the fix, confidence, before, after.
DESCRIPTIONS = {
    'em-dash': 'Em dash (U+2014) is rarely typed by humans and is a strong LLM signal.',
    'en-dash': 'En dash (U+2013) is a common LLM typographic artifact.',
    'curly-quotes': 'Curly quotes are common LLM typographic artifacts.',
    'ellipsis': 'Ellipsis character (U+2026) is a common LLM typographic artifact.',
    'nbsp': 'Non-breaking space (U+00A0) is often generated by LLMs unnecessarily.',
    'zero-width': 'Zero-width character is an invisible typographic artifact.',
    'soft-hyphen': 'Soft hyphen (U+00AD) is an invisible typographic artifact.',
    'emoji': 'Emoji character unlikely to be intentionally typed',
    'decorative-unicode': 'Decorative Unicode symbol is a common LLM artifact',
    'filler-openers': 'Filler opener. State the point directly.',
    'sycophantic-closers': 'Sycophantic closer. Delete the phrase.',
    'hedges': 'Hedge phrase. Delete it.',
    'transition-padding': 'Transitional padding. Delete the phrase.',
    'hollow-intensifiers': 'Hollow intensifier. Rephrase to be more direct.',
    'trivial-comment': 'Trivial comment restates code.',
    'docstring-filler': 'Filler docstring restates the function signature without adding information',
    'rust-verbose-doc': 'GPT-style Rust doc comment restates the obvious. Remove or replace with actual semantic information.',
    'rust-trivial-mod-doc': 'Module doc comment restates the module name. Add real documentation.',
    'python-empty-docstring-section': 'Empty NumPy docstring section header with no content. Remove it.',
    'jsts-boilerplate': 'JSDoc boilerplate with no real information. Remove it.',
    'jsts-console-log': 'Leftover debug console.log(). Remove it.',
    'go-verbose-doc': 'Go comment restates function name trivially. Add real docs or remove.',
    'sql-verbose-doc': 'Trivial SQL comment restates SELECT *. Remove it.',
    'custom-phrases': 'Custom phrase match from config',
}
EXPLANATIONS = {
    'em-dash': ('Em dash character (U+2014 —) — almost never typed by humans', 'Replace with " - " (space-hyphen-space)', 1.0, 'word — word', 'word  -  word'),
    'en-dash': ('En dash character (U+2013 \u2013)', 'Replace with " - "', 1.0, 'pages 10\u201320', 'pages 10 - 20'),
    'curly-quotes': ('Curly/smart quotes: \u201c\u201d (double) and \u2018\u2019 (single)', 'Replace with straight quotes " or \'', 1.0, '“hello”', '"hello"'),
    'ellipsis': ('Ellipsis character U+2026 (…)', 'Replace with three dots "..."', 1.0, 'and so on…', 'and so on...'),
    'nbsp': ('Non-breaking space (U+00A0)', 'Replace with regular space', 1.0, 'word\xa0word', 'word word'),
    'zero-width': ('Zero-width characters: U+200B, U+200C, U+200D, U+FEFF', 'Delete — removes the invisible character', 1.0, 'word\u200bword', 'wordword'),
    'soft-hyphen': ('Soft hyphen (U+00AD) — invisible optional hyphen', 'Delete — removes the character', 1.0, 'soft\xadhyphen', 'softhyphen'),
    'filler-openers': ('Phrases at sentence start: "Certainly!", "Absolutely!", "Of course!", "I\'d be happy to"', 'Replace(delete) — removes the filler phrase', 0.95, 'Certainly! Here is the solution.', 'Here is the solution.'),
    'rust-verbose-doc': ('Rust `///` doc comments starting with "This function/method/struct…" or "Returns the/a…"', 'DeleteLine — removes the entire doc comment line', 0.8, '/// This function processes the input data.', '(line deleted)'),
    'rust-trivial-mod-doc': ('Inner doc comments (`//!`) that say "This module contains/provides…"', 'DeleteLine', 0.75, '//! This module contains the authentication logic.', '(line deleted)'),
    'python-args-boilerplate': ('NumPy/Google-style Python docstrings where Args/Returns sections contain only generic descriptions like "The input data", "The output result"', 'FlagOnly — highlighted in report and interactive mode, never auto-deleted', 0.75, 'Args:\n    data: The input data.\nReturns:\n    The output data.', '(flagged for review)'),
    'python-empty-docstring-section': ('NumPy-style docstring section headers (Args:, Returns:, etc.) that have no content below them', 'DeleteLine', 0.9, 'Args:\nReturns:\n    int', 'Returns:\n    int'),
}


#: Words as they mostly are written, with the synonym as it is written then; the flagged ones have none.
_WRITTEN = {f(w): (s, f(s)) for w, s in SYNONYMS.items() for f in (str.lower, str.upper, str.capitalize)}
_FLAGGED = [f(w) for w in FLAGGED for f in (str.lower, str.upper, str.capitalize)]


def _of_written(word: Column, which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for w, s in _WRITTEN.items() for x in (w, s[which])]), word)


def _synonym(word: Column) -> Column:
    other = F.element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), F.lower(word))
    return F.when(word.isin(list(_WRITTEN)), _of_written(word, 0)).when(~word.isin(_FLAGGED), other)


def _cased(word: Column) -> Column:
    s = _synonym(word)
    first = F.substring(word, 1, 1)
    other = F.when(s.isNull(), "").when(word == F.upper(word), F.upper(s)).when((first == F.upper(first)) & (first != F.lower(first)), F.initcap(s)).otherwise(s)
    return F.when(word.isin(list(_WRITTEN)), _of_written(word, 1)).when(word.isin(_FLAGGED), "").otherwise(other)


def _trimmed(s: Column) -> Column:
    """Cut a match at its first newline; show it without white space around."""
    from ..functions.extract import stripped

    line = F.substring_index(s["original"], "\n", 1)
    return F.struct(s["start"].alias("start"), (s["start"] + F.length(line)).alias("end"), stripped(line).alias("original"))


def _first_80(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.substring(s["original"], 1, 80), F.lit("…")).alias("original"))


def _args(text: Column) -> Column:
    a, r = (spans(text, java(*p), needs=('"""',)) for p in (PY_ARGS, PY_RETURNS))
    inside = F.filter(r, lambda m: ~F.exists(a, lambda x: (x["start"] <= m["start"]) & (x["end"] >= m["end"])))
    tag = lambda what: lambda s: F.struct(*[_first_80(s)[c].alias(c) for c in ("start", "end", "original")], F.lit(f"Python docstring {what}").alias("description"))
    return F.concat(F.transform(a, tag("Args section contains only generic boilerplate with no real semantic information.")), F.transform(inside, tag("Returns section contains only generic boilerplate.")))


def _empty_sections(text: Column) -> Column:
    from ..functions.extract import stripped

    return F.transform(spans(text, java(*PY_EMPTY), 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), stripped(s["original"]).alias("original")))


def _sql_docs(text: Column) -> Column:
    return F.transform(spans(text, java(*SQL_DOC), needs=("--",)), _trimmed)


def in_class(symbols: str, allowed: str = "") -> Callable[[Column], Column]:
    """Whether a character is in a class of characters and ranges, and not among the allowed ones (perhaps quoted)."""
    ranges = re.findall(r"(.)-(.)|(.)", symbols, re.S)
    single = [c for _, _, c in ranges if c]
    kept = [c for c in re.findall(r"\\\\(.)|(.)", allowed, re.S) for c in c if c]

    def test(c: Column) -> Column:
        out = c.isin(*single) if single else F.lit(False)
        for low, high, one in ranges:
            if not one:
                out = out | c.between(low, high)
        return out & ~c.isin(*kept) if kept else out

    return test


#: Gaps that ``any_of`` leaves out at first sight.
HULLS = 3


def any_of(classes: list[str]) -> str:
    """One class of all characters of ``classes``.

    Most characters of a text are in none.  They are told by a few ranges that hold all the others,
    between the widest gaps, before any class is looked at.
    """
    ends = sorted((ord(low or one), ord(high or one)) for c in classes for low, high, one in re.findall("(.)-(.)|(.)", c, re.S))
    joined = [list(ends[0])]
    for low, high in ends[1:]:
        if low > joined[-1][1]:
            joined.append([low, high])
        else:
            joined[-1][1] = max(joined[-1][1], high)
    widest = sorted(range(1, len(joined)), key=lambda k: joined[k - 1][1] - joined[k][0])[:HULLS]
    edges = [0, *sorted(widest), len(joined)]
    hulls = "".join(f"\\x{{{joined[a][0]:x}}}-\\x{{{joined[b - 1][1]:x}}}" for a, b in zip(edges, edges[1:]))
    return f"[{hulls}&&[{''.join(f'[{c}]' for c in dict.fromkeys(classes))}]]"


def codes_of(classes: list[str]) -> frozenset[int]:
    """The characters up to U+00FF that are in one of ``classes``."""
    ends = [(ord(low or one), ord(high or one)) for c in classes for low, high, one in re.findall("(.)-(.)|(.)", c, re.S)]
    return frozenset(k for low, high in ends for k in range(low, min(high, 255) + 1))


def _without(symbols: str, allowed: tuple[str, ...]) -> str:
    """A class of ``symbols`` but the first character of each allowed entry."""
    first = "".join(dict.fromkeys(a[0] for a in allowed if a))
    quoted = "".join("\\" + c if c in "\\]^-[&" else c for c in first)
    return f"(?![{quoted}])[{symbols}]" if first else f"[{symbols}]"


def builtin(allow_symbols: tuple[str, ...] = (), phrases: tuple[str, ...] = ()) -> list[Rule]:
    rules = [
        Rule("em-dash", "typographic", 1.0, REPLACE, DESCRIPTIONS["em-dash"], (("", "\u2014"),), " - ", explain=EXPLANATIONS["em-dash"]),
        Rule("en-dash", "typographic", 1.0, REPLACE, DESCRIPTIONS["en-dash"], (("", "\u2013"),), " - ", explain=EXPLANATIONS["en-dash"]),
        Rule("curly-quotes", "typographic", 1.0, REPLACE, DESCRIPTIONS["curly-quotes"], (("", "[\u201c\u201d\u2018\u2019]"),), suggest=lambda o: F.when(o.isin("\u201c", "\u201d"), '"').otherwise("'"), explain=EXPLANATIONS["curly-quotes"]),
        Rule("ellipsis", "typographic", 1.0, REPLACE, DESCRIPTIONS["ellipsis"], (("", "\u2026"),), "...", explain=EXPLANATIONS["ellipsis"]),
        Rule("nbsp", "typographic", 1.0, REPLACE, DESCRIPTIONS["nbsp"], (("", "\u00a0"),), " ", explain=EXPLANATIONS["nbsp"]),
        Rule("zero-width", "typographic", 1.0, REPLACE, DESCRIPTIONS["zero-width"], (("", "[\u200b\u200c\u200d\ufeff]"),), explain=EXPLANATIONS["zero-width"]),
        Rule("soft-hyphen", "typographic", 1.0, REPLACE, DESCRIPTIONS["soft-hyphen"], (("", "\u00ad"),), explain=EXPLANATIONS["soft-hyphen"]),
        Rule("emoji", "symbol", 1.0, REPLACE, DESCRIPTIONS["emoji"], (("", _without(EMOJI, allow_symbols)),)),
        Rule("decorative-unicode", "symbol", 1.0, REPLACE, DESCRIPTIONS["decorative-unicode"], (("", _without(DECORATIVE, allow_symbols)),)),
        Rule("filler-openers", "prose", 0.95, REPLACE, DESCRIPTIONS["filler-openers"], OPENERS, explain=EXPLANATIONS["filler-openers"]),
        Rule("sycophantic-closers", "prose", 0.90, REPLACE, DESCRIPTIONS["sycophantic-closers"], CLOSERS),
        Rule("hedges", "prose", 0.85, REPLACE, DESCRIPTIONS["hedges"], HEDGES),
        Rule("transition-padding", "prose", 0.80, REPLACE, DESCRIPTIONS["transition-padding"], TRANSITIONS),
        Rule(
            "hollow-intensifiers", "prose", 0.70, REPLACE, DESCRIPTIONS["hollow-intensifiers"], _WORDS, suggest=_cased,
            kind_of=lambda o: F.when(_synonym(o).isNull(), FLAG).otherwise(REPLACE),
            describe=lambda o: F.when(_synonym(o).isNull(), DESCRIPTIONS["hollow-intensifiers"]).otherwise(F.concat(F.lit("Hollow intensifier. Use '"), _synonym(o), F.lit("' instead."))),
        ),
        Rule("trivial-comment", "code", 0.85, DELETE_LINE, DESCRIPTIONS["trivial-comment"], code_only=True, find=comments.trivial),
        Rule("docstring-filler", "code", 0.80, DELETE_BLOCK, DESCRIPTIONS["docstring-filler"], code_only=True, find=comments.filler_docstrings),
        Rule("rust-verbose-doc", "pack", 0.80, DELETE_LINE, DESCRIPTIONS["rust-verbose-doc"], RUST_DOC, code_only=True, needs=("///",), explain=EXPLANATIONS["rust-verbose-doc"]),
        Rule("rust-trivial-mod-doc", "pack", 0.75, DELETE_LINE, DESCRIPTIONS["rust-trivial-mod-doc"], RUST_MODULE, code_only=True, needs=("//!",), explain=EXPLANATIONS["rust-trivial-mod-doc"]),
        Rule("python-args-boilerplate", "pack", 0.75, FLAG, "", code_only=True, find=_args, explain=EXPLANATIONS["python-args-boilerplate"]),
        Rule("python-empty-docstring-section", "pack", 0.90, DELETE_LINE, DESCRIPTIONS["python-empty-docstring-section"], code_only=True, find=_empty_sections, explain=EXPLANATIONS["python-empty-docstring-section"]),
        Rule("jsts-boilerplate", "pack", 0.85, DELETE_LINE, DESCRIPTIONS["jsts-boilerplate"], JS_PARAM, code_only=True, needs=("@",)),
        Rule("jsts-console-log", "pack", 0.90, DELETE_LINE, DESCRIPTIONS["jsts-console-log"], JS_LOG, code_only=True, needs=("('", '("')),
        Rule("go-verbose-doc", "pack", 0.85, DELETE_LINE, DESCRIPTIONS["go-verbose-doc"], GO_DOC, code_only=True, needs=("//",)),
        Rule("sql-verbose-doc", "pack", 0.90, DELETE_LINE, DESCRIPTIONS["sql-verbose-doc"], code_only=True, find=_sql_docs),
    ]
    if phrases:
        body = "|".join(rf"\b{quote(p)}\b" for p in phrases)
        rules.append(Rule("custom-phrases", "custom", 0.75, REPLACE, DESCRIPTIONS["custom-phrases"], (("i", body),)))
    return rules


def quote(text: str) -> str:
    """``text`` as a pattern that both regex dialects read literally."""
    return "".join("\\" + c if c in "\\.+*?()|[]{}^$-&~#" else c for c in text)


_CLEAN = ("typographic", "symbol", "custom")
PROFILES = {
    "conservative": frozenset(_CLEAN),
    "prose": frozenset((*_CLEAN, "prose")),
    "code": frozenset((*_CLEAN, "code")),
    "aggressive": frozenset((*_CLEAN, "prose", "code")),
    **{f"{p}-pack": frozenset((*_CLEAN, "code", "pack")) for p in ("rust", "python", "jsts", "go", "sql")},
}


@dataclass(frozen=True)
class Settings:
    profile: str = "conservative"
    extra_profiles: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    fix: tuple[str, ...] = ()
    min_confidence: float = 0.6
    lang: str | None = None
    threshold: float | None = None
    allow_symbols: tuple[str, ...] = ()
    custom_phrases: tuple[str, ...] = ()
    file_rules: tuple[Rule, ...] = ()
    disabled: tuple[str, ...] = ()

    def rules(self) -> list[tuple[int, Rule]]:
        """The active rules with their priority: masked by profile, then file rules, then skip and fix."""
        for p in (self.profile, *self.extra_profiles):
            if p not in PROFILES:
                raise ValueError(f"unknown profile {p}")
        mask = frozenset().union(*(PROFILES[p] for p in (self.profile, *self.extra_profiles)))
        rules = [r for r in builtin(self.allow_symbols, self.custom_phrases) if r.category in mask]
        rules += self.file_rules
        rules = [r for r in rules if r.id not in {*self.skip, *self.disabled} and (not self.fix or r.id in self.fix)]
        return list(enumerate(rules))

    def only(self, *ids: str) -> "Settings":
        return replace(self, fix=ids)
