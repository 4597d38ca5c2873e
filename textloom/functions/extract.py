"""Match spans as columns: every match of a pattern with its code-point offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,original:string>>"


def java(flags: str, body: str) -> str:
    """Unicode classes and case, and only the newline ends a line."""
    return f"(?{flags}dU){body}"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


#: Elements of a part of a growing list.
PART = 64


def growing(kind: str) -> Column:
    """An empty list of type ``kind`` for folds that add to its end: full parts, and the last part.

    Adding to an array copies it; here that is a part at most, or the list of parts.
    """
    return F.struct(empty(f"array<{kind}>").alias("full"), empty(kind).alias("last"))


def grown(g: Column, x: Column) -> Column:
    closes = F.size(g["last"]) >= PART - 1
    last = F.array_append(g["last"], x)
    return F.struct(F.when(closes, F.array_append(g["full"], last)).otherwise(g["full"]).alias("full"), F.when(closes, F.slice(g["last"], 1, 0)).otherwise(last).alias("last"))


def gathered(g: Column) -> Column:
    return F.flatten(F.array_append(g["full"], g["last"]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(numbers: Column, add=lambda a, n: a + n, none: int = 0) -> Column:
    """For a list of integers the sums (or what ``add`` and ``none`` make) of those before each.

    Spark copies what a fold holds at every step, texts included, so a fold that gathers a long list costs the square
    of its length.  Here the list is cut in parts, and a fold holds the sums of a part at most, or those of the parts.
    """

    def sums(x: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), empty("array<int>").alias("out"))
        return F.aggregate(x, start, lambda acc, n: F.struct(add(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda x: F.aggregate(x, F.lit(none), lambda a, n: add(a, n)))
        return F.flatten(F.zip_with(parts, sums(totals, F.lit(none)), sums))

    cut = bound(numbers, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda i: F.slice(x, PART * i + 1, F.lit(PART))))
    return bound(cut, of)


def overlap(found: Column) -> Column:
    """Whether among structs in order of ``start`` one begins before the end of the one before."""
    return F.exists(F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)


#: Among these are all that Java takes for an ASCII letter where case does not matter, beside its two cases.
_FOLDS = "\\u0100-\\uffff"
_WORD_LIST = re.compile(r"\\b\((?:\?:)?([^()|\\]+(?:\|[^()|\\]+)*)\)")
_PHRASES = re.compile(r"\\b[A-Za-z][^()|\\]*\\b(?:\|\\b[A-Za-z][^()|\\]*\\b)*")
#: First characters of a match that ``guarded`` looks at.
GUARD = 3


def _firsts(flags: str, body: str) -> list[str]:
    """The first letters of the words that a pattern chooses from; none if it is of another kind."""
    words = []
    if "x" not in flags and (found := _WORD_LIST.match(body)) and "|" not in body[found.end() :]:
        words = found[1].split("|")
    elif "x" not in flags and _PHRASES.fullmatch(body):
        words = body.replace(r"\b", "").split("|")
    firsts = [re.match(r"(?:[A-Za-z][A-Za-z ]*)?(?![*?{+])", w)[0][:GUARD] for w in words]
    return firsts if all(firsts) else []


def _letter(*letters: tuple[str, str]) -> str:
    """A class of letters, each with flags: if case does not matter, with all that Java takes for it."""
    cased = {x for c, flags in letters for x in ((c.upper(), c.lower()) if "i" in flags else c)}
    return "[" + "".join(sorted(cased)) + (_FOLDS if any("i" in flags for _, flags in letters) else "") + "]"


def guarded(flags: str, body: str) -> str:
    """``java(flags, body)``; before words to choose from it looks at the first letters alone.

    Most places of a text are told by that, before a word's edge is looked for and any word is tried.
    """
    firsts = _firsts(flags, body)
    if not firsts:
        return java(flags, body)
    classes = "".join(_letter(*((f[k], flags) for f in firsts)) for k in range(min(map(len, firsts))))
    return java(flags, f"(?=(?-iuU:{classes}))(?:{body})")


#: A character that no text should have; those that do are gone through twice.
MARK = "\uffff"


def has(text: Column, *marks: str) -> Column:
    """Whether one of the last characters below U+10000 is in the text: their first two bytes are looked for once."""
    return F.contains(text.cast("binary"), F.lit(bytearray(b"\xef\xbf"))) & _any(text, marks)


def spans(text: Column, pattern: str, group: int = 0, needs: tuple[str, ...] = ()) -> Column:
    """All matches of ``pattern``, which must not match the empty string.

    The text is gone through once: each match is put between marks, and the lengths of what lies between
    them are added up.  With ``group`` the span is that of the group, which must begin
    where the match does.  A text without any of ``needs``, one of which every match has, is not searched.
    """
    searched = F.lit(True) if not needs else _any(text, needs)
    if group:
        return F.when(searched & text.rlike(pattern), _spans_twice(text, pattern, group)).otherwise(empty(SPAN))
    def cut(parts: Column) -> Column:
        both = F.zip_with(parts, running(F.transform(parts, F.length)), lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("original")))
        return F.filter(both, lambda s, i: i % 2 == 1)

    shown = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    # marks of the text's own matter only if something is found
    told = lambda m: F.when(has(text, MARK), _spans_twice(text, pattern, 0)).otherwise(bound(F.split(m, MARK, -1), cut))
    found = bound(shown, lambda m: F.when(F.octet_length(m) > F.octet_length(text), told(m)).otherwise(empty(SPAN)))
    return F.when(text.isNotNull() & searched, found).otherwise(empty(SPAN))


GROUPED = "array<struct<start:int,end:int,original:string,groups:array<string>>>"


def grouped(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """``spans`` with ``groups``: what each of the numbered groups took of the match, empty if it took no part.

    The text is gone through once: a match and its groups are put between marks.
    """
    shown = F.regexp_replace(text, F.lit(pattern), F.lit(MARK + BETWEEN.join(f"${i}" for i in (0, *groups)) + MARK))

    def cut(parts: Column) -> Column:
        split = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.split(p, BETWEEN, -1)).otherwise(F.array(p)))
        return bound(split, put)

    def put(found: Column) -> Column:
        at = running(F.transform(found, lambda p: F.length(p[0])))
        both = F.zip_with(found, at, lambda p, a: F.struct(a.alias("start"), (a + F.length(p[0])).alias("end"), p[0].alias("original"), F.slice(p, 2, len(groups)).alias("groups")))
        return F.filter(both, lambda s, i: i % 2 == 1)

    def each() -> Column:
        """For texts that have marks of their own: the text is gone through for each group."""
        out = F.transform(spans(text, pattern), lambda s: s.withField("groups", empty("array<string>")))
        for i in groups:
            out = F.zip_with(out, F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda s, g: s.withField("groups", F.array_append(s["groups"], g)))
        return F.filter(out, lambda s: s["start"].isNotNull())

    told = lambda m: F.when(has(text, MARK, BETWEEN), each()).otherwise(bound(F.split(m, MARK, -1), cut))
    found = bound(shown, lambda m: F.when(F.octet_length(m) > F.octet_length(text), told(m)).otherwise(empty(GROUPED)))
    return F.when(text.isNotNull(), found).otherwise(empty(GROUPED))


def _any(text: Column, literals: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        found = found | F.contains(text, F.lit(x))
    return found


def _spans_twice(text: Column, pattern: str, group: int) -> Column:
    """Spans from two built-in functions: the matches, and the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    if group:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        steps = F.zip_with(steps, part, lambda s, p: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), p.alias("part")))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())
    shown = (lambda s: s["part"]) if group else (lambda s: s["hit"])
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), growing(SPAN).alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["hit"])).alias("at"),
            grown(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(shown(s))).alias("end"), shown(s).alias("original"))).alias("out"),
        ),
        lambda acc: gathered(acc["out"]),
    )


#: Between what the patterns of ``finds`` match at one place.
BETWEEN = "\ufffe"
FIND = "array<struct<at:int,found:array<string>>>"
#: What keeps a pattern from standing beside others in one: references to groups, names of groups, quotes, the last match.
_ALONE = re.compile(r"\\[1-9GQk]|\(\?<[A-Za-z]")


def joins(flags: str, body: str) -> bool:
    """Whether a pattern may be one of those of ``finds``."""
    return "x" not in flags and not _ALONE.search(body)


#: What holds where a match begins: no letter before a word, a line's edge.
_WORD, _LINE = "(?<![A-Za-z])", r"(?mdU:^|(?=\n))"
_LETTERS = frozenset(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def begins(flags: str, body: str) -> str:
    """What holds where a match of the pattern begins: no letter before a word, a line's edge."""
    if _firsts(flags, body):
        return _WORD
    return _LINE if "m" in flags and body.startswith(r"(?:^|\n)") and "|" not in re.sub(r"\([^()]*\)", "", body) else ""


def _first_letters(patterns: list[tuple[str, str]]) -> str:
    """What tells that one of the patterns' words may begin: their first letters, by place and then by word."""
    firsts = [(f, flags) for flags, body in patterns for f in _firsts(flags, body)]
    near = "".join(_letter(*((f[k], flags) for f, flags in firsts)) for k in range(min(len(f) for f, _ in firsts)))
    by_first = {}
    for f, flags in firsts:
        by_first.setdefault(_letter((f[0], flags)), {})["".join(_letter((c, flags)) for c in f[1:])] = None
    words = "|".join(first + ("" if "" in rest else f"(?:{'|'.join(rest)})") for first, rest in by_first.items())
    return f"(?=(?-imsuU:{near}))(?=(?-imsuU:{words}))"


def skipping(patterns: list[tuple[str, str]], codes: frozenset[int]) -> str | None:
    """What lies before the next place where one of ``patterns`` may match, as a pattern that never goes back.

    ``codes`` are the characters up to U+00FF that a match of those that begin neither a word nor a line has first.
    A run of letters, and of other characters that begin nothing, is gone through in one step: a word is
    looked for at its first letter alone, and a line at its edge.
    """
    if codes & (_LETTERS | {10}):
        return None
    by_begin = {}
    for p in patterns:
        by_begin.setdefault(begins(*p), []).append(p)
    one_of = lambda ps: f"(?:{'|'.join(f'(?:{guarded(*p)})' for p in ps)})"
    lines = one_of(by_begin[_LINE]) if _LINE in by_begin else ""
    words = _first_letters(by_begin[_WORD]) + one_of(by_begin[_WORD]) if _WORD in by_begin else ""
    places = ([one_of(by_begin[""])] if "" in by_begin else []) + [_LINE + lines] * bool(lines) + [words] * bool(words)
    no_line, no_word = f"(?!(?md:^){lines})" if lines else "", f"(?!{words})" if words else ""
    of = lambda codes: "[" + "".join(f"\\x{c:02x}" for c in sorted(codes)) + "]"
    letters, plain = of(_LETTERS), of(frozenset(range(256)) - _LETTERS - codes - {10})
    steps = (f"(?={letters}){no_word}{no_line}(?>{letters}+)(?>{plain}*)", f"(?={plain}){no_line}(?>{plain}+)", f"(?!{'|'.join(places)})(?s:.)")
    return f"(?:{'|'.join(steps)})*+"


def finds(text: Column, patterns: list[tuple[str, str]], codes: frozenset[int] | None = None) -> Column:
    """All places where any of ``patterns`` matches, in one pass: ``found`` has for each pattern what it matches
    there, empty if nothing.  Matches of a pattern may overlap (see ``apart``).

    For texts without ``MARK`` and ``BETWEEN``.  At each place where a pattern matches, what they match there
    is put into the text between marks; a text that stays as long as it is has none.  With ``codes`` (see ``skipping``)
    the text between is gone through by words; without, each character is looked at.
    """
    groups = "".join(f"(?=(?<p{i}>{guarded(*p)})?)" for i, p in enumerate(patterns))
    put = MARK + BETWEEN.join(f"${{p{i}}}" for i in range(len(patterns))) + MARK
    between = skipping(patterns, codes) if codes is not None else None
    if between:
        every, put = rf"\G(?<before>{between}){groups}(?<at>(?s:.))", f"${{before}}{put}${{at}}"
    else:
        by_begin = {}
        for p in patterns:
            by_begin.setdefault(begins(*p), []).append(f"(?:{guarded(*p)})")
        every = "(?=" + "|".join(f"{b}(?:{'|'.join(ps)})" for b, ps in by_begin.items()) + ")" + groups
    marked = F.regexp_replace(text, F.lit(every), F.lit(put))

    def cut(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p, i: F.when(i % 2 == 1, 0).otherwise(F.length(p)))
        hits = F.filter(F.zip_with(parts, running(lengths), lambda p, at: F.struct(at.alias("at"), p.alias("part"))), lambda s, i: i % 2 == 1)
        return F.transform(hits, lambda s: F.struct(s["at"].alias("at"), F.split(s["part"], BETWEEN, -1).alias("found")))

    return bound(marked, lambda m: F.when(F.octet_length(m) > F.octet_length(text), bound(F.split(m, MARK, -1), cut)).otherwise(empty(FIND)))


def apart(found: Column, k: int) -> Column:
    """The matches of the pattern ``k`` of ``finds`` that do not overlap, from the left: its ``spans``."""
    hits = F.transform(
        F.filter(found, lambda h: h["found"][k] != ""),
        lambda h: F.struct(h["at"].alias("start"), (h["at"] + F.length(h["found"][k])).alias("end"), h["found"][k].alias("original")),
    )

    def kept(all_of: Column) -> Column:
        return F.aggregate(
            all_of,
            F.struct(F.lit(0).alias("to"), growing(SPAN).alias("out")),
            lambda acc, s: F.when(s["start"] < acc["to"], acc).otherwise(F.struct(s["end"].alias("to"), grown(acc["out"], s).alias("out"))),
            lambda acc: gathered(acc["out"]),
        )

    return bound(hits, lambda x: F.when(overlap(x), kept(x)).otherwise(x))


PLACE = ("byte", "line", "col", "unit")


def places(text: Column, offsets: Column, need: tuple[str, ...] = PLACE) -> Column:
    """For ascending code-point offsets those asked of: byte offset, line and column (from 1), and 0-based UTF-16 column.

    The text is cut at the offsets, and what the parts have is added up: linear in the text.  Characters are
    cut from fixed-width code units, where a place is found without counting from the start.
    """
    need = tuple(n for n in PLACE if n in need)

    def wide(x: Column) -> Column:
        """UTF-16 units: as many as characters if all are ASCII."""
        return F.when(F.octet_length(x) == F.length(x), F.length(x)).otherwise((F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int"))

    def measured(at: Column, part: Column) -> Column:
        last = F.substring_index(part, "\n", -1)
        ends = lambda of: F.when(F.contains(part, F.lit("\n")), of(last)).otherwise(0)
        lines = F.when(F.contains(part, F.lit("\n")), F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).otherwise(0)
        shown = {"byte": {"byte": F.octet_length(part)}, "line": {}, "col": {"tail": ends(F.length)}, "unit": {"unit": wide(part), "tail_unit": ends(wide)}}
        return F.struct(at.cast("int").alias("at"), lines.alias("lines"), *(c.alias(k) for n in need for k, c in shown[n].items()))

    def placed(b: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), b["at"]), 1, F.size(b["at"]))
        parts = F.zip_with(before, b["at"], lambda a, z: F.struct(z.alias("at"), F.decode(F.substring(b["units"], 4 * a + 1, 4 * (z - a)), "UTF-32").alias("part")))
        return bound(F.transform(parts, lambda p: measured(p["at"], p["part"])), summed)

    def summed(m: Column) -> Column:
        units = running(F.transform(m, lambda x: x["unit"])) if "unit" in need else F.transform(m, lambda x: F.lit(0))
        begun = F.zip_with(m, units, lambda x, u: F.struct(x.alias("x"), (u + x["unit"] if "unit" in need else u).alias("unit")))
        return bound(begun, ended)

    def ended(m: Column) -> Column:
        sums = lambda of: running(F.transform(m, of))
        begin = lambda of: F.transform(m, lambda y: F.when(y["x"]["lines"] > 0, of(y)).otherwise(0))
        most = lambda x: bound(x, lambda v: F.zip_with(running(v, F.greatest), v, lambda a, b: F.greatest(a, b)))
        before = {
            "byte": lambda: sums(lambda y: y["x"]["byte"]), "line": lambda: sums(lambda y: y["x"]["lines"]),
            "col": lambda: most(begin(lambda y: y["x"]["at"] - y["x"]["tail"])), "unit": lambda: most(begin(lambda y: y["unit"] - y["x"]["tail_unit"])),
        }
        all_of = F.transform(m, lambda y: F.struct(y.alias("m")))
        for n in need:
            all_of = F.zip_with(all_of, before[n](), lambda z, v: z.withField(n, v))  # noqa: B023
        told = {
            "byte": lambda z: z["byte"] + z["m"]["x"]["byte"], "line": lambda z: 1 + z["line"] + z["m"]["x"]["lines"],
            "col": lambda z: 1 + z["m"]["x"]["at"] - z["col"], "unit": lambda z: z["m"]["unit"] - z["unit"],
        }
        return F.transform(all_of, lambda z: F.struct(*(told[n](z).alias(n) for n in need)))

    nothing = empty(f"array<struct<{','.join(f'{n}:int' for n in need)}>>")
    made = bound(F.struct(F.encode(text, "UTF-32").alias("units"), offsets.alias("at")), lambda b: F.when(F.size(b["at"]) > 0, placed(b)).otherwise(nothing))
    return F.when(text.isNotNull() & offsets.isNotNull(), made)


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")
