import difflib

from pyspark.sql import functions as F

from textloom.operators.engine import process
from textloom.plans.inject import view
from textloom.plans.queries import watch_stream
from textloom.plans.rules import Settings
from textloom.streaming.watch import debounced

TEXTS = ["Plain words of a text.", "We utilize the tools. It is worth noting that the end is near.", "", None, "One line\nand another — of the same", "Certainly! The cat sat on the mat."]


def unified(path, old, new):
    lines = difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}", n=3)
    return "".join(x if x.endswith("\n") else x + "\n" for x in lines)


def test_every_document_is_a_change(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = [(r.path, 1, r.content) for r in view(spark, str(tmp_path), "prose").collect()]
    changes = first + [(p, 2, None if c is None else c + "\nI hope this helps") for p, _, c in first]
    scanned = process(spark.createDataFrame([(p, "md", q, c) for p, q, c in changes], "path string, ext string, seq long, content string"), Settings("prose"))
    seen = {(r.path, r.seq): (len(r.matches), r.cleaned) for r in scanned.collect()}
    last, want = {}, []
    for path, seq, content in changes:  # replayed one by one, in order
        n, cleaned = seen[path, seq]
        old = last.get(path)
        want.append((path, seq, n, len(unified(path, old, cleaned)) if n and old is not None and old != cleaned else 0))
        last[path] = content
    got = [tuple(r) for r in watch_stream(spark, str(tmp_path)).collect()]
    assert len(got) == 80 and sorted(got) == sorted(want)
    assert any(n for _, _, n, _ in want) and any(d for _, _, _, d in want)


def test_changes_in_quick_succession_count_as_one(spark):
    rows = [("a", "2024-01-01 00:00:00.000", 1, "x"), ("a", "2024-01-01 00:00:00.400", 2, "y"), ("a", "2024-01-01 00:00:00.800", 3, None), ("a", "2024-01-01 00:00:01.400", 4, "w"),
            ("b", "2024-01-01 00:00:00.400", 5, "p"), ("b", "2024-01-01 00:00:00.400", 6, "q"), ("b", None, 7, "r"), (None, "2024-01-01 00:00:00.000", 8, "s")]
    changes = spark.createDataFrame(rows, "path string, ts string, seq long, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {tuple(r) for r in debounced(changes).collect()}
    assert got == {("a", 3, None), ("a", 4, "w"), ("b", 6, "q"), (None, 8, "s")}
    assert debounced(changes.limit(0)).count() == 0
