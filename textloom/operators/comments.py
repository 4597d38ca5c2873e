"""File types, comment spans, and the two rules that compare comments with code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.extract import SPAN, bound, empty, gathered, growing, grown, java, running, spans, stripped

# Extensions, comment syntax and stop words.
CODE = "rs py js ts jsx tsx java c cpp h hpp go php rb sh bash zsh toml yaml yml json sql kt swift cs scala".split()
PROSE = "md markdown txt rst adoc tex".split()
C_STYLE = "rs js ts java c cpp go php swift kt cs scala".split()
HASH_STYLE = "py rb sh bash zsh toml yaml yml".split()
STOP_WORDS = (
    "initialize set get create return loop iterate check make add update increment decrement append print call define declare assign store compute calculate "
    "the a an to for of in on at by is it this that with from and or not if then else new into as up"
).split()
QUOTED = r'"""(.*?)"""|' + r"'''(.*?)'''"
COMMENT_PATTERNS = (
    (C_STYLE, (("s", r"/\*.*?\*/"), ("m", r"//.*$"))),
    (HASH_STYLE, (("m", r"#.*$"),)),
    (["py"], (("s", QUOTED),)),
    (["sql", "lua"], (("m", r"--.*$"),)),
    (["tex"], (("m", r"%.*$"),)),
)
GENERIC = java("im", r"^\s*(This (?:function|method|class|struct) [a-zA-Z0-9_\s]+)\s*$|^\s*(Parameters:\s*input\.?\s*Returns:\s*output\.?)\s*$")
TRIPLE, SLASHES, STARS = java("s", QUOTED), java("sm", r"^(?:[ \t]*///.*(?:\n|$))+"), java("sm", r"^[ \t]*/\*\*.*?\*/")
_SEPARATORS = r"(?U)[\s!-/:-@\[-`{-~]+"
_FOUND = "array<struct<start:int,end:int,original:string,confidence:double,description:string>>"


def file_type(ext: Column, lang: str | None = None) -> Column:
    if lang in CODE or lang in PROSE:
        return F.lit("code" if lang in CODE else "prose")
    return F.when(ext.isin(CODE), "code").otherwise("prose")


def comment_spans(text: Column, ext: Column) -> Column:
    """Merged spans of comments (touching ones too); none for extensions without a syntax."""
    parts = [F.when(ext.isin(exts), F.concat(*[spans(text, java(*p)) for p in patterns])).otherwise(empty(SPAN)) for exts, patterns in COMMENT_PATTERNS]
    plain = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def add(acc: Column, s: Column) -> Column:
        touches = F.coalesce(s["start"] <= acc["end"], F.lit(False))
        return F.struct(
            F.when(touches, acc["start"]).otherwise(s["start"]).alias("start"),
            F.when(touches, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(touches | acc["end"].isNull(), acc["out"]).otherwise(grown(acc["out"], _open(acc))).alias("out"),
        )

    nothing = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), growing(plain).alias("out"))
    return F.aggregate(ordered, nothing, add, lambda acc: F.when(acc["end"].isNull(), empty(plain)).otherwise(gathered(grown(acc["out"], _open(acc)))))


def _open(acc: Column) -> Column:
    return F.struct(acc["start"].alias("start"), acc["end"].alias("end"))


def _is_comment(line: Column) -> Column:
    return line.rlike(r"(?U)\A\s*(?://|#|--|%)")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATORS), lambda t: t != "")


def trivial(text: Column) -> Column:
    """Comment lines of which four in five words stand in the adjacent code line.

    The numbers of the nearest code lines above and below are added up over the lines; texts of lines are looked up by
    them.  Offsets are true ones for any line ends.
    """
    blank, comment, code, none = 0, 1, 2, -(1 << 30)

    def told(raw: Column) -> Column:
        line = F.when(F.endswith(raw, F.lit("\r")), F.regexp_replace(raw, r"\r\z", "")).otherwise(raw)
        kind = lambda x: F.when(_is_comment(x), comment).when(x.rlike(r"(?U)\S"), code).otherwise(blank)
        return bound(line, lambda x: F.struct(F.length(raw).alias("n"), x.alias("line"), kind(x).alias("kind")))

    def near(whole: Column) -> Column:
        lines = whole["lines"]
        numbers = lambda sign: F.transform(lines, lambda x, i: F.when(x["kind"] == code, sign * i).otherwise(none))
        above, below = running(numbers(1), F.greatest, none), F.reverse(running(F.reverse(numbers(-1)), F.greatest, none))
        which = F.zip_with(above, below, lambda a, b: F.when(b > none, -b).when(a > none, a))
        starts = F.zip_with(running(F.transform(lines, lambda x: x["n"] + 1)), which, lambda at, k: F.struct(at.alias("at"), k.alias("code")))
        asked = F.filter(
            F.zip_with(lines, starts, lambda x, s: F.struct(s["at"].alias("start"), x["n"].alias("n"), x["line"].alias("line"), x["kind"].alias("kind"), s["code"].alias("code"))),
            lambda x: (x["kind"] == comment) & x["code"].isNotNull() & ~x["line"].rlike(r"(?U)\A\s*//[/!]"),
        )
        end = lambda x: F.least(x["start"] + x["n"] + 1, whole["length"])
        return F.transform(asked, lambda x: x.withField("code", F.get(lines, x["code"])["line"]).withField("end", end(x)))

    asked = bound(F.struct(F.transform(F.split(text, "\n", -1), told).alias("lines"), F.length(text).alias("length")), near)

    def judged(x: Column) -> Column:
        body = F.regexp_replace(x["line"], r"(?U)\A\s*(?://|#|--|%)", "")
        words = F.filter(bound(body, lambda b: F.when(F.octet_length(b) == F.length(b), _tokens(F.lower(b))).otherwise(F.transform(_tokens(b), F.lower))), lambda t: ~t.isin(STOP_WORDS))
        code = F.transform(F.filter(F.split(x["code"], _SEPARATORS + r"|(?<=\p{Lower})(?=\p{Upper})"), lambda t: t != ""), F.lower)
        once = F.array(F.struct(words.alias("words"), code.alias("code")))  # once for a line, not for each word
        shared = lambda b: F.struct(F.size(b["words"]).alias("n"), F.size(F.filter(b["words"], lambda t: F.array_contains(b["code"], t))).alias("c"))
        return F.element_at(F.transform(once, lambda b: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["line"].alias("original"), shared(b).alias("shared"),
        )), 1)

    hits = F.filter(F.transform(asked, judged), lambda x: 5 * x["shared"]["c"] >= 4 * x["shared"]["n"])
    out = F.transform(
        hits,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["original"].alias("original"), F.when(x["shared"]["c"] == x["shared"]["n"], 0.85).otherwise(0.70).alias("confidence"),
            F.when(x["shared"]["n"] == 0, "Trivial comment (stop words only).").otherwise("Trivial comment restates code.").alias("description"),
        ),
    )
    return F.when(text.rlike(r"(?mdU)^\s*(?://|#|--|%)"), out).otherwise(empty(_FOUND))


def filler_docstrings(text: Column) -> Column:
    """Docstrings and documentation comments that only restate the signature."""
    inner = (
        (TRIPLE, ('"""', "'''"), lambda o: stripped(F.regexp_replace(F.regexp_replace(o, "\\A[\"']+", ""), "[\"']+\\z", ""))),
        (SLASHES, ("///",), lambda o: stripped(F.replace(o, F.lit("///"), F.lit("")))),
        (STARS, ("/**",), lambda o: stripped(F.regexp_replace(o, r"/\*\*|\*/|\*", ""))),
    )
    return F.concat(*[_generic(spans(text, p, needs=needs), of) for p, needs, of in inner])


def _generic(found: Column, inner) -> Column:
    return F.filter(found, lambda s: inner(s["original"]).rlike(GENERIC))
