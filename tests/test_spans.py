import random

from pyspark.sql import functions as F

from textloom.functions.extract import MARK, SPAN, _spans_twice, empty, guarded, java, places, spans
from textloom.operators import engine, report
from textloom.operators.comments import trivial
from textloom.plans.rules import CLOSERS, HEDGES, SYNONYMS, Settings, _WORDS, _cased, _synonym, builtin


def test_one_pass_equals_two(spark):
    """Guarded patterns in one pass find what plain ones find in two, letters that only fold to ASCII and marks included."""
    r = random.Random(1)
    some = ["utilize", "UTILIZE", "Robust", "ſynergy", "ſtreamline", "İmplement", "ımplement", "Keep in mind that", "Keep in mind that", "note that", "I hope this helps!", "of the", "the by", " ", "\n", ", ", "é", "\U0001f680", MARK, "utilized", "x"]
    texts = [(None,), ("",)] + [("".join(r.choice(some) + r.choice(["", " ", " "]) for _ in range(r.randrange(30))),) for _ in range(200)]
    df = spark.createDataFrame(texts, "t string")
    patterns = [_WORDS[0], CLOSERS[0], HEDGES[0], builtin(phrases=("of the", "the by"))[-1].patterns[0], ("i", r"\b(?:k?eep|in)\b|x"), ("", "\\bof the\\b")]
    for p in patterns:
        plain = F.when(F.col("t").isNotNull(), _spans_twice(F.col("t"), java(*p), 0)).otherwise(empty(SPAN))
        rows = df.select(spans(F.col("t"), guarded(*p)).alias("a"), plain.alias("b")).collect()
        assert all(x.a == x.b for x in rows) and any(x.a for x in rows)
    assert [guarded(*p) == java(*p) for p in patterns] == [False, False, False, False, True, False]


def test_written_synonyms(spark):
    words = ["utilize", "UTILIZE", "Utilize", "uTILIZE", "robust", "ROBUST", "Robust", "ROBust", "ſtate-of-the-art", "İmplement", "other"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", _synonym(F.col("w")).alias("s"), _cased(F.col("w")).alias("c")).collect()
    assert [(x.s, x.c) for x in got[:7]] == [("use", "use"), ("use", "USE"), ("use", "Use"), ("use", "use"), (None, ""), (None, ""), (None, "")]
    assert [(x.s, x.c) for x in got[7:]] == [(None, "")] * 4
    assert set(SYNONYMS) >= {"utilize"}


def test_words_shared_with_the_code_below(spark):
    plan = spark.createDataFrame([("# set userList x\nuserList = x1\n",)], "t string").select(trivial(F.col("t")).alias("f"))
    assert [(x.start, x.end, x.confidence) for x in plan.first().f] == []
    found = spark.createDataFrame([("# The user list\nuserList = x1\n",)], "t string").select(trivial(F.col("t")).alias("f")).first().f
    assert [(x.start, x.end, x.confidence) for x in found] == [(0, 16, 0.85)]


def test_cleaned_text_is_made_once(spark):
    """The filter of changed texts reads the cleaned text; it does not make it a second time."""
    docs = engine.process(spark.createDataFrame([("a.md", "md", "a — b")], "path string, ext string, content string"), Settings("conservative"))
    plan = report.unified_diff(docs)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "cleaned" in x]
    assert filters and not any("array_join" in x for x in filters)


def test_patterns_in_one_pass(spark):
    """Patterns looked for together find what each finds alone, overlapping ones included."""
    from textloom.functions.extract import apart, finds, joins
    from textloom.plans.rules import OPENERS, TRANSITIONS

    r = random.Random(2)
    some = ["utilize", "Robust", "\u017fynergy", "Certainly!", "all in all, ", "In summary, ", "keep in mind that", "please note that", "note that the", "that the that", "I hope this helps!", "of the", " ", "\n", "\n ", "\u2014", "\U0001f680", "\u00e9", "x", "aaa"]
    texts = [("",)] + [("".join(r.choice(some) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(40))),) for _ in range(150)]
    df = spark.createDataFrame(texts, "t string")
    patterns = [("", "[\u2014\U0001f680]"), *OPENERS, *CLOSERS, *HEDGES, *TRANSITIONS, *_WORDS, ("i", "\\bof the\\b"), ("", "that the"), ("", "aa"), ("i", "that (?:the )?that")]
    assert all(joins(*p) for p in patterns) and not joins("", r"(a)\1") and not joins("x", "a b") and not joins("", "(?<n>a)")
    rows = df.select("t", F.array(*(apart(finds(F.col("t"), patterns), k) for k in range(len(patterns)))).alias("a"), F.array(*(_spans_twice(F.col("t"), java(*p), 0) for p in patterns)).alias("b")).collect()
    for x in rows:
        assert x.a == x.b, x.t


def test_running_sums(spark):
    from textloom.functions.extract import running

    r = random.Random(3)
    lists = [([r.randrange(-5, 9) for _ in range(n)],) for n in (1, 2, 63, 64, 65, 128, 129, 5000)]
    df = spark.createDataFrame(lists, "x array<int>")
    for x in df.select("x", running(F.col("x")).alias("s"), running(F.col("x"), F.greatest, -99).alias("m")).collect():
        assert x.s == [sum(x.x[:i]) for i in range(len(x.x))] if len(x.x) < 200 else x.s[-1] == sum(x.x[:-1])
        assert x.m[:200] == [max([-99, *x.x[:i]]) for i in range(len(x.x[:200]))]


def test_many_fixes_in_one_text(spark):
    """The time of a text does not grow with the square of its fixes."""
    import time

    took = []
    for n in (1_000, 1_000, 8_000):
        df = spark.createDataFrame([("a.md", "md", "a\u2014b\U0001f680\n" * n)], "path string, ext string, content string")
        began = time.time()
        row = engine.process(df, Settings("conservative")).select("cleaned", F.size("matches").alias("n")).first()
        took.append(time.time() - began)
        assert row.n == 2 * n and row.cleaned == "a - b\n" * n
    assert took[2] < 24 * max(took[1], 0.3)


def test_places_that_are_needed(spark):
    """Any part of a place is as in the whole one, and no other is made."""
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "é", "\U0001f680", "\n", "\r\n"]) for _ in range(r.randrange(1, 200))) for _ in range(40)]
    rows = [(t, sorted(r.sample(range(len(t) + 1), r.randint(0, min(len(t), 90))))) for t in [*texts, "plain\nascii " * 20]]
    df = spark.createDataFrame(rows, "t string, at array<int>")
    needs = [("line", "col"), ("unit", "line"), ("byte",), ("col",)]
    for x in df.select("t", "at", places(F.col("t"), F.col("at")).alias("all"), *(places(F.col("t"), F.col("at"), n).alias("_".join(n)) for n in needs)).collect():
        want = [(len(b.encode()), 1 + b.count("\n"), 1 + len(last), len(last.encode("utf-16-le")) // 2) for k in x["at"] for b in [x.t[:k]] for last in [b.rsplit("\n", 1)[-1]]]
        assert [tuple(p) for p in x["all"]] == want
        for n in needs:
            assert [p.asDict() for p in x["_".join(n)]] == [{k: p[k] for k in n} for p in x["all"]]


def test_code_actions_place_near_matches_only(spark):
    """Matches that begin beyond the range go before they are placed; the actions are the same."""
    texts = ["\U0001f680 of the — a\nof the x…\n" + "of the — y " * 30, "x" * 60 + " of the", "a — b\nc — d\n— e", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").selectExpr("doc_id", "'a.md' AS path", "'md' AS ext", "content")
    done = engine.process(df, Settings("prose", custom_phrases=("of the",))).select("doc_id", "content", "matches").cache()
    for at in ((0, 0, 0, 8), (0, 4, 1, 6), (1, 0, 1, 3), (2, 0, 2, 40)):
        near = engine.begun_by(done, *at[2:])
        rows = [sorted(map(tuple, engine.code_actions(engine.diagnostics(x, "doc_id"), *at).collect())) for x in (done, near)]
        assert rows[0] == rows[1] and rows[0]
    assert max(x.n for x in engine.begun_by(done, 0, 8).select(F.size("matches").alias("n")).collect()) < 5
    done.unpersist()
