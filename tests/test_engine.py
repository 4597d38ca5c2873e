import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import engine, report
from textloom.operators.engine import process
from textloom.plans.rules import Settings
from textloom.sources.config import settings
from textloom.sources.files import discover, glob_pattern, write_cleaned
from textloom.sources.rule_files import RuleFileError, distance, is_regex, parse, rules_from, suggestion, unquoted, validate

DOC = "path string, ext string, content string"
LETTER = "Certainly! Here is the document — \nit is worth noting that we should utilize\na new approach. I hope this helps!\n"


def run(spark, rows, settings):
    docs = spark.createDataFrame([(f"f{i}.{e}", e, c) for i, (e, c) in enumerate(rows)], DOC)
    got = {r.path: r for r in process(docs, settings).collect()}
    return [got[f"f{i}.{e}"] for i, (e, _) in enumerate(rows)]


def ids(row):
    return [(m.rule_id, m.start, m.end) for m in row.matches]


def test_prose(spark):
    a, b, c, d, e = run(spark, [("md", LETTER), ("md", "end.\n\nSurely so"), ("md", "Plain text.\n"), ("md", None), ("rs", 'let s = "utilize"; // we utilize it\n')], Settings("prose"))
    assert [x for x, _, _ in ids(a)] == ["filler-openers", "em-dash", "hedges", "hollow-intensifiers", "sycophantic-closers"]
    assert a.cleaned == "Here is the document  -  \nwe should use\na new approach. "
    assert ids(b) == [("filler-openers", 4, 10)] and b.cleaned == "end.ly so"
    assert ids(c) == [] and c.cleaned == "Plain text.\n" and c.density == 0
    assert ids(d) == [] and d.cleaned is None and d.density == 0
    assert ids(e) == [("hollow-intensifiers", 25, 32)]


def test_code(spark):
    rust = "fn a() {}\n/// This function does it\n// Initialize the user list\nlet userList = initialize_users();\n"
    rows = [("py", "# Initialize\nx = 1\n"), ("py", "x = 1\n\n# Initialize\n\ny = 2\n"), ("py", "x = 1\n# Initialize\n"), ("py", "# only a comment\n"), ("rs", rust), ("py", "a = 1\r\n# Set a\r\nb = a\r\n"), ("py", "é = 1\n\n\n# Set é\n\n\nf(é)\n")]
    got = run(spark, rows, Settings("code"))
    assert [r.cleaned for r in got[:4]] == ["x = 1\n", "x = 1\n\ny = 2\n", "x = 1\n", "# only a comment\n"]
    assert len(got[4].matches) == 1 and got[4].matches[0].rule_id == "trivial-comment"  # one winner of an overlapping chain
    assert got[5].cleaned == "a = 1\r\nb = a\r\n"
    assert got[6].cleaned == "é = 1\n\nf(é)\n"


def test_skip_fix_and_rendering(spark):
    text = "Hello — world…"
    assert run(spark, [("md", text)], Settings(skip=("em-dash", "ellipsis")))[0].cleaned == text
    docs = process(spark.createDataFrame([("a.md", "md", text), ("b.md", "md", "😀é —\n“x”")], DOC), Settings(fix=("em-dash", "curly-quotes")))
    assert sorted(r.line for r in report.human(docs).collect())[0] == "a.md:1:7 [em-dash] — ->  - "
    found = {(r.path, r.start_line, r.start_character, r.severity) for r in engine.diagnostics(docs, "path").collect()}
    assert found == {("a.md", 0, 6, "Error"), ("b.md", 0, 4, "Error"), ("b.md", 1, 0, "Error"), ("b.md", 1, 2, "Error")}
    made = {r.path: json.loads(r.report) for r in report.json_files(docs).collect()}
    assert made["a.md"]["score"]["total_matches"] == 1 and made["a.md"]["matches"][0]["kind"] == {"type": "Replace", "value": " - "}
    assert "+Hello  -  world" in {r.path: r.diff for r in report.unified_diff(docs).collect()}["a.md"]
    assert docs.select(engine.offset_at(F.col("content"), 1, 2).alias("x")).where("path = 'b.md'").first()["x"] == 15


def test_settings():
    with pytest.raises(ValueError):
        Settings("none").rules()
    assert "rust-verbose-doc" in {r.id for _, r in Settings("go-pack").rules()} and "rust-verbose-doc" not in {r.id for _, r in Settings("aggressive").rules()}


def test_rule_language():
    bad = 'rule a\n  sevrity: warn\n  match: "x"\n  fix: delete\nrule b\n  match: "["\n  fix: delete\nrule c\n  match: "y"\n'
    messages = [m for _, m in parse(bad)[2]]
    assert any("did you mean 'severity'" in m for m in messages) and any("no fix" in m for m in messages) and any("invalid pattern" in m for m in messages)
    assert [distance(*p) for p in (("severity", "sevrity"), ("fix", "fiz"), ("xyz", "abc"))] == [1, 1, 3]
    assert [suggestion(x) for x in ("mesage", "matcg", "xyzzzz")] == ["message", "match", None]
    assert [is_regex(x) for x in ("simple phrase", "word.*thing", "[abc]")] == [False, True, True]
    assert {unquoted(x) for x in ('"hello"', "'hello'", "hello", "  hello ")} == {"hello"}
    assert validate('rule a\n  match: "x"\n  fix: bare\n')[0][1].startswith("replacement must be in quotes")
    with pytest.raises(RuleFileError):
        rules_from(bad)


def test_rules_of_files(spark):
    rules, off = rules_from('rule swap\n  match: """\n  (\\w+)-\n  (\\w+)\n  """\n  fix: "$2 $1"\nrule lit\n  match: "Foo"\n  fix: delete-line\n  files: *.md\ndisable em-dash\n')
    s = Settings(file_rules=rules, disabled=off)
    a, b = run(spark, [("md", "left-right —\nx foo y\nend\n"), ("txt", "x foo y\n")], s)
    assert a.cleaned == "right left —\nend\n" and b.cleaned == "x foo y\n"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x — y")
    (tmp_path / "b.bin").write_bytes(b"x\0y")
    (tmp_path / "sub" / "c.py").write_bytes(b"a\xffb")
    got = {r.path.rsplit("/", 1)[1]: (r.ext, r.content) for r in discover(spark, str(tmp_path), True).collect()}
    assert got == {"a.md": ("md", "x — y"), "c.py": ("py", "a�b")}
    assert discover(spark, str(tmp_path), True, ("**/sub/*",)).count() == 1
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path / "none"))
    write_cleaned(process(discover(spark, str(tmp_path / "a.md")), Settings()), str(tmp_path / "out"))
    assert [r.cleaned for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x  -  y"]
    import re

    assert re.match(glob_pattern("*.{md,txt}"), "/x/a.md") and not re.match(glob_pattern("src/**/*.py"), "/lib/a.py")


def test_entry_imports_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    try:
        names = entry.queries()
    except ModuleNotFoundError:
        names = {}
    assert "resolved_prose" in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_explicit_zeros_of_a_configuration():
    assert settings({}, min_confidence=0.0).min_confidence == 0.0
    assert settings({"min_confidence": 0.0}).min_confidence == 0.0
    assert settings({}).min_confidence == 0.6 and settings({"min_confidence": 0.7}, min_confidence=0.0).min_confidence == 0.0
    assert settings({"threshold": 0.0}, threshold=None).threshold == 0.0


def test_patterns_of_the_running_dialect(spark):
    said = lambda p: " ".join(m for _, m in parse(f"rule a\n  match: '{p}'\n  fix: delete\n")[2])
    assert "invalid pattern" in said("(?P<n>x)") and said("(?<n>x)") == ""
    assert "empty string" in said("\\b|x") and "empty string" in said("x*")


def test_captures_are_those_of_the_whole_text(spark):
    rules, _ = rules_from("rule swap\n  match: '(?<=a)(b)(c)?(?=d|e)'\n  fix: \"$2$1!\"\n")
    a, b = run(spark, [("md", "abcd abe xbcd"), ("md", "abcx")], Settings(file_rules=rules))
    assert a.cleaned == "acb!d ab!e xbcd" and b.cleaned == "abcx"


def test_rule_files_merge_from_the_root_down(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".textloom-rules").write_text("rule one\n  match: 'x'\n  fix: delete\nrule two\n  match: 'y'\n  fix: flag\ndisable em-dash\n")
    (deep / ".textloom-rules").write_text("rule one\n  match: 'zz'\n  fix: 'q'\ndisable ellipsis\n")
    s = settings({}, start=str(deep))
    assert [(r.id, r.value, r.patterns[0][1]) for r in s.file_rules] == [("one", "q", "zz"), ("two", "", "y")]
    assert s.disabled == ("em-dash", "ellipsis")


def test_places_and_many_matches(spark):
    text = "é—\n😀 — —x\n" * 150
    got = run(spark, [("md", text)], Settings())[0]
    docs = process(spark.createDataFrame([("p", "md", text)], DOC), Settings())
    rows = sorted((r.start, r.line, r.col) for r in engine.match_rows(docs, "path").collect())
    want = [(i, 1 + text.count("\n", 0, i), i - text.rfind("\n", 0, i)) for i, c in enumerate(text) if c in "—😀"]
    assert rows == want and len(got.matches) == len(want) == 600
    unit = sorted((r.start_line, r.start_character) for r in engine.diagnostics(docs, "path").collect())
    assert unit == sorted((line - 1, len(text[i - col + 1 : i].encode("utf-16-le")) // 2) for i, line, col in want)
    report_of = json.loads(report.json_document(docs).first()["report"])
    assert report_of["summary"] == {"files_scanned": 1, "files_with_matches": 1, "total_matches": 600} and len(report_of["files"][0]["matches"]) == 600


def test_symbol_rules_in_one_pass(spark):
    """One class for all rules of single characters gives what each rule's own pattern does."""
    import random

    from textloom.functions.extract import java, spans
    from textloom.operators.engine import raw_matches
    from textloom.plans.rules import Settings, any_of, builtin
    from textloom.sources.rule_files import rules_from

    rng = random.Random(8)
    marks = "—–“”‘’… ​‌‍﻿­\U0001f680✓→•★※†‡§¶☀➿⌀⓿①■\U0001faff\U0001f000éß¥·‒‧ab -]&\n"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(80))) for _ in range(120)] + [None, ""]
    found, _ = rules_from('rule own\n  match: "[a-]"\n  fix: "x"\nrule amp\n  match: "[a&&b]"\n  fix: "x"\nrule not\n  match: "[^a]"\n  fix: flag\n')
    df = spark.createDataFrame([(i, "a.md", "md", t) for i, t in enumerate(texts)], "doc_id long, path string, ext string, content string").repartition(3)
    for settings in (Settings("conservative"), Settings("conservative", allow_symbols=("✓", "→x", "]")), Settings("conservative", file_rules=found)):
        got = {(r.doc_id, r.m.rule_id, r.m.start, r.m.end, r.m.original) for r in raw_matches(df, settings).select("doc_id", F.explode("matches").alias("m")).collect()}
        want = set()
        for _, rule in settings.rules():
            pattern = java(*rule.patterns[0])
            want |= {(r.doc_id, rule.id, r.s.start, r.s.end, r.s.original) for r in df.select("doc_id", F.explode(spans(F.col("content"), pattern)).alias("s")).collect()}
        assert got == want and len(got) > 500
    assert [r.id for r in builtin() if r.symbols] == ["em-dash", "en-dash", "curly-quotes", "ellipsis", "nbsp", "zero-width", "soft-hyphen", "emoji", "decorative-unicode"]
    assert any_of(["a-c", "b-d", "x"]) == "[\\x{61}-\\x{64}\\x{78}-\\x{78}&&[[a-c][b-d][x]]]"
