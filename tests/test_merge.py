import pytest
from pyspark.sql import functions as F

from textloom.operators.comments import comment_spans
from textloom.plans.inject import view
from textloom.plans.queries import INNER, OUTER
from textloom.sources.rule_files import RuleFileError, merged_texts, validate, validated


def test_inner_rules_win_and_disables_add_up(spark):
    rules, disabled = merged_texts([("outer", OUTER), ("inner", INNER)])
    assert [(r.id, r.severity) for r in rules] == [("order", merged_texts([("o", OUTER)])[0][0].severity), ("phrase", "error")]
    assert disabled == ["ellipsis", "em-dash"] and rules[1].patterns[0][1] == "(?x) is \\sworth"
    assert {r.id: r.patterns for r in merged_texts([("inner", INNER), ("outer", OUTER)])[0]}["phrase"] != rules[1].patterns


def test_errors_of_all_files_are_told(spark):
    with pytest.raises(RuleFileError) as told:
        merged_texts([("one", "rule a\n  sevrity: warn\n  match: \"x\"\n  fix: delete\n"), ("two", "disable\n")])
    assert "one: line 2" in str(told.value) and "two: line 1" in str(told.value)


def test_code_view_holds_whole_texts(spark, tmp_path):
    long = "\n".join(f"line {i} of it" for i in range(3000))
    rows = [(i, t) for i, t in enumerate([long, "", None, "one", "two\nlines", long, "x", "y"])] + [(8, None), (9, long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = view(spark, str(tmp_path), "code")
    got = {r.doc_id: r for r in df.select("doc_id", "content", comment_spans(df["content"], df["ext"]).alias("s")).collect()}
    assert got[0].content.endswith("// line 2999 of it\n") and got[9].content.endswith("# line 2999 of it\n")
    assert got[2].content is None and got[8].content is None and got[5].content.endswith(long + "\n")
    spans = [(s.start, s.end) for s in got[9].s]
    assert len(spans) > 3000 and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_a_table_of_rule_files_is_checked(spark):
    files = [("a", 'rule a\n  match: "x"\n  fix: delete\n'), ("b", 'rule b\n  match: "["\n  sevrity: warn\n  fix: y\n'), ("c", None), ("d", ""), ("b", "disable\n")]
    got = sorted((r.path, r.line, r.message.partition("pattern: ")[0]) for r in validated(spark.createDataFrame(files, "path string, content string").withColumn("line", F.lit(9))).collect())
    assert got == sorted((p, at, m.partition("pattern: ")[0]) for p, text in files if text for at, m in validate(text)) and len(got) == 4
    assert validated(spark.createDataFrame([], "path string, content string")).count() == 0
