"""What the text queries do once, and what they go past."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions.extract import finds, skipping
from textloom.operators.comments import trivial
from textloom.plans import queries, streams
from textloom.plans.rules import CLOSERS, HEDGES, OPENERS, TRANSITIONS, _WORDS, codes_of

SYMBOLS = ["\u2014\u00a7", "\U0001f680-\U0001f6ff", "\u00a0\u00ad"]
PATTERNS = [("", "[\u2014\u00a7\U0001f680-\U0001f6ff\u00a0\u00ad]"), *OPENERS, *CLOSERS, *HEDGES, *TRANSITIONS, *_WORDS, ("i", "\\bof the\\b|\\bthe by\\b"), ("", "\\bin a\\b")]


def test_words_are_gone_past_in_one_step(spark):
    """Text between places is gone through by words, and the same is found as when each character is looked at."""
    r = random.Random(3)
    some = ["utilize", "Robust", "ſynergy", "İmplement", "ımplement", "Keep in mind that", "Certainly!", "Certainly!\n", "All in all, ", "keep in mind that", "please note that", "note that the", "I hope this helps!"]
    some += ["of the", "of the by", "in a", "In a", "\u212aeep in mind that", " ", "\n", "\r\n", "\n ", "\t", "\u0085", "\u00a0", "\u00ad", "\u00a7", "\u2014", "\U0001f680", "\u00e9", "\u00df", "\u4e2d", "x", "xutilize", "1", "_", "."]
    texts = [("",), ("in a " + "ab cé " * 60_000 + "utilize",), ("é中" * 60_000,)]
    texts += [("".join(r.choice(some) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(40))),) for _ in range(400)]
    df = spark.createDataFrame(texts, "t string")
    codes = codes_of(SYMBOLS)
    assert codes == {0xA0, 0xA7, 0xAD} and skipping(PATTERNS, codes) and skipping(PATTERNS, frozenset({ord("a")})) is None
    rows = df.select(finds(F.col("t"), PATTERNS).alias("a"), finds(F.col("t"), PATTERNS, codes).alias("b")).collect()
    assert all(x.a == x.b for x in rows) and sum(len(x.a) for x in rows) > 1000
    for few in (PATTERNS[:1], PATTERNS[1:3], PATTERNS[3:5]):  # symbols, lines, words alone
        rows = df.select(finds(F.col("t"), few).alias("a"), finds(F.col("t"), few, codes if few[0] == PATTERNS[0] else frozenset()).alias("b")).collect()
        assert all(x.a == x.b for x in rows) and any(x.a for x in rows)


def test_comments_do_not_measure_the_text_again(spark):
    """The text's length is taken once, not for each comment; the last line has no newline to take with it."""
    df = spark.createDataFrame([("# The user list\nuserList = x1\n# X1 list",), ("# Ä user\nä = user\n",)], "t string").select(trivial(F.col("t")).alias("f"))
    assert [[(s.start, s.end) for s in x.f] for x in df.collect()] == [[(0, 16), (30, 39)], [(0, 9)]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"least\([^()]*(\([^()]*\)[^()]*)*, (char_)?length\(t#", plan)


def test_modified_documents_match_once(spark, monkeypatch):
    """The later versions are written from cleaned text that is there already."""
    plans, write = [], streams.write_files

    def seen(df, folder):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, folder)

    monkeypatch.setattr(streams, "write_files", seen)
    rows = queries.queries()["modified_documents"](spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 3 and not any("Great question" in p for p in plans)
    last = {(x.path, x.version): x.content for x in rows}
    assert any(v == 3 for _, v in last) and all(c.endswith("\nI hope this helps") for (p, v), c in last.items() if (p, v + 1) not in last)


def test_accepted_matches_match_once(spark):
    """Decisions and what they are applied to come of one matching."""
    df = queries.queries()["accepted_matches"](spark, "/root/testdata/sf0.001")
    assert "Great question" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.agg(F.sum("accepted")).first()[0] > 0
