import pytest
from pyspark.sql import functions as F

from textloom.functions.extract import grouped, java
from textloom.operators import nearest
from textloom.operators.nearest import above, by_folder, folder_of, process_nearest, read_rules
from textloom.plans.rules import Settings
from textloom.sources.rule_files import RuleFileError

FILES = [
    ("", 'rule a\n  match: "one"\n  fix: "1"\nrule b\n  match: "two"\n  fix: "2"\ndisable em-dash\n'),
    ("x", 'rule a\n  match: "one"\n  fix: "I"\nrule c\n  match: "one two"\n  fix: "III"\n'),
    ("x/y", "disable c\ndisable b\n"), ("z", None),
]


def table(spark, files=FILES):
    return spark.createDataFrame(files, "folder string, content string")


def test_folders(spark):
    rows = spark.createDataFrame([("a.md",), ("x/a.md",), ("x/y/z/a.md",), (None,)], "path string").select(folder_of(F.col("path")).alias("f")).select("f", above(F.col("f")).alias("up"))
    assert [tuple(r) for r in rows.collect()] == [("", [""]), ("x", ["", "x"]), ("x/y/z", ["", "x", "x/y", "x/y/z"]), (None, None)]


def test_nearest_counts_and_disables_add_up(spark):
    rules, disabled = read_rules(table(spark))
    assert [(f, r.id) for f, r in rules] == [("", "a"), ("x", "a"), ("", "b"), ("x", "c")]
    got = {r.folder: (sorted(r.active), sorted(r.off or [])) for r in by_folder(spark.createDataFrame([("",), ("x",), ("x/y/q",), ("xy",)], "folder string"), rules, disabled).collect()}
    assert got == {"": ([0, 2], ["em-dash"]), "x": ([1, 2, 3], ["em-dash"]), "x/y/q": ([1, 2, 3], ["b", "c", "em-dash"]), "xy": ([0, 2], ["em-dash"])}


def test_each_document_follows_its_files(spark):
    docs = [("a.md", "one two — …"), ("x/a.md", "one two two"), ("x/y/a.md", "one two"), ("z/a.md", None), (None, "one — two"), ("x/y/a.md", "one two")]
    df = spark.createDataFrame([(p, "md", t, 1) for p, t in docs], "path string, ext string, content string, active int")
    done = process_nearest(df, table(spark), Settings("conservative"))
    assert done.columns[:4] == ["path", "ext", "content", "active"]
    got = sorted(((r.path or "", r.cleaned) for r in done.collect()), key=str)
    assert got == [("", "one  -  two"), ("a.md", "1 2 — ..."), ("x/a.md", "I two 2"), ("x/y/a.md", "I two"), ("x/y/a.md", "I two"), ("z/a.md", None)]
    none = process_nearest(df, table(spark, []), Settings("conservative"))
    assert sorted(r.cleaned or "" for r in none.collect()) == ["", "one  -  two", "one two", "one two", "one two  -  ...", "one two two"]
    assert process_nearest(df.limit(0), table(spark), Settings("conservative")).count() == 0


def test_errors_and_bound(spark, monkeypatch):
    with pytest.raises(RuleFileError, match=r"(?s)\.:.*\nx:"):
        read_rules(table(spark, [("x", "rule q\n  match: \"[\"\n  fix: delete\n"), ("", "rule r\n  sevrity: warn\n")]))
    monkeypatch.setattr(nearest, "MOST_RULES", 2)
    with pytest.raises(RuleFileError, match="4 rules"):
        read_rules(table(spark))


def test_rules_of_other_folders_cost_a_document_nothing(spark):
    """No document is dealt out by its folder, and none is gone through for a rule that is not in force there."""
    files = [("", 'rule a\n  match: "one"\n  fix: "1"\n'), ("other", 'rule a\n  match: "[a-z]+"\n  fix: delete\nrule letter\n  match: "[a-z]"\n  fix: delete\n')]
    df = spark.createDataFrame([("x/a.md", "md", "one two —"), ("other/a.md", "md", "one two —")], "path string, ext string, content string")
    done = process_nearest(df, table(spark, files), Settings("conservative"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert "[[a-z]]" not in plan and "(?<p1>" not in plan  # symbols have a pass, each rule of a file its own
    assert sorted((r.path, r.cleaned) for r in done.collect()) == [("other/a.md", "   - "), ("x/a.md", "1 two  - ")]


def test_groups_in_one_pass(spark):
    """Also in texts that have the marks in them, and where a group takes no part."""
    pattern = java("", "(o)(x)?n(e)")
    df = spark.createDataFrame([("one — oxne",), ("\uffff one\ufffe oxne",), ("none",), ("two",), ("",), (None,), ("one" * 200,)], "t string")
    rows = [r.f for r in df.select(grouped(F.col("t"), pattern, (3, 2, 1)).alias("f")).collect()]
    got = [[(s.start, s.end, s.original, s.groups) for s in f] for f in rows]
    one = lambda at: (at, at + 3, "one", ["e", "", "o"])
    oxne = lambda at: (at, at + 4, "oxne", ["e", "x", "o"])
    assert got == [[one(0), oxne(6)], [one(2), oxne(7)], [one(1)], [], [], [], [one(3 * k) for k in range(200)]]
