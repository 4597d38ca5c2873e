"""Scores, counts, rankings, coverage, sentences and rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import gathered, growing, grown, places, stripped
from ..plans.rules import Settings
from .engine import once, placed


def rule_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    """path, categories: ``category:n`` sorted and joined, for files with matches."""
    n = df.select("path", F.explode("matches.category").alias("category")).groupBy("path", "category").agg(F.count("*").alias("n"))
    part = F.concat_ws(":", "category", F.col("n").cast("string"))
    return n.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("categories"))


def worst_rule(df: DataFrame) -> DataFrame:
    """The most frequent rule; ties go to the first by name."""
    return rule_counts(df).orderBy(F.desc("n"), "rule_id").limit(1)


_SUMMARY = (
    ("files_scanned", lambda: F.count("*")),
    ("files_with_matches", lambda: F.count_if(F.size("matches") > 0)),
    ("total_matches", lambda: F.coalesce(F.sum(F.size("matches")), F.lit(0))),
)


def summary(df: DataFrame) -> DataFrame:
    return df.agg(*(c().alias(k) for k, c in _SUMMARY))


def max_density(df: DataFrame, threshold: float) -> DataFrame:
    """The greatest density of files with matches, and whether it is above ``threshold``."""
    top = df.where(F.size("matches") > 0).agg(F.coalesce(F.max("density"), F.lit(0.0)).alias("d"))
    return top.select(F.round("d", 6).alias("max_density"), (F.col("d") > threshold).alias("exceeds"))


def file_ranking(df: DataFrame) -> DataFrame:
    return df.where(F.size("matches") > 0).select("path", F.size("matches").cast("long").alias("total_matches"), F.round("density", 6).alias("density")).orderBy(F.desc("density"), "path")


def coverage(df: DataFrame, settings: Settings) -> DataFrame:
    """Active rules that never fired."""
    active = df.sparkSession.createDataFrame([(r.id,) for _, r in settings.rules()], "rule_id string")
    return active.join(rule_counts(df), "rule_id", "left_anti")


SENTENCES = "array<struct<text:string,byte:int,line:int,first:int>>"


def sentences(text: Column, bytes_of: Column) -> Column:
    """array<struct<text, byte, line, first>>: cut after . ! ? before white space or the end.

    ``first`` is the number of ascending byte offsets ``bytes_of`` before the sentence; the
    last element is the end of the text.
    """
    parts = F.split(text, r"(?U)(?<=[.!?])(?=\s)", -1)
    folded = F.aggregate(
        F.concat(parts, F.array(F.lit(""))),
        F.struct(F.lit(0).alias("byte"), F.lit(1).alias("line"), growing(SENTENCES).alias("out")),
        lambda acc, p: F.struct(
            (acc["byte"] + F.octet_length(p)).alias("byte"),
            (acc["line"] + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).alias("line"),
            grown(acc["out"], F.struct(stripped(p).alias("text"), acc["byte"].alias("byte"), acc["line"].alias("line"), F.lit(0).alias("first"))).alias("out"),
        ),
        lambda acc: gathered(acc["out"]),
    )
    # both lists ascend: in the order of bytes, a start comes after the offsets before it
    marks = F.array_sort(F.concat(F.transform(bytes_of, lambda b: F.struct(b.alias("byte"), F.lit(1).alias("hit"))), F.transform(folded, lambda s: F.struct(s["byte"].alias("byte"), F.lit(0).alias("hit")))))
    first = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("n"), growing("array<int>").alias("out")),
        lambda acc, m: F.struct((acc["n"] + m["hit"]).alias("n"), F.when(m["hit"] == 1, acc["out"]).otherwise(grown(acc["out"], acc["n"])).alias("out")),
        lambda acc: gathered(acc["out"]),
    )
    return F.zip_with(folded, first, lambda s, n: s.withField("first", n))


def sentence_scores(df: DataFrame, *keys: str) -> DataFrame:
    """A row for every sentence with hits: text (at most 100 bytes), line, hits, density, matched_words.

    A match belongs to a sentence if it starts in it or within four bytes after it, so
    it may count twice.  Sentences and matches are met in one pass: each sentence looks
    at the matches from its start to that of the fifth after it, of which four bytes
    reach no further.
    """
    text = F.col("content")
    bytes_of = F.transform(places(text, F.transform("matches", lambda m: m["start"]), ("byte",)), lambda p: p["byte"])
    rows = once(df.where(F.size("matches") > 0).select(*keys, text, "matches", bytes_of.alias("_b")), "_b")
    rows = once(rows.withColumn("_s", sentences(text, F.col("_b"))), "_s")
    # array<struct<byte, word>> once for each text; a sentence takes its own part
    hit = F.zip_with("_b", "matches", lambda b, m: F.struct(b.alias("byte"), m["original"].alias("word")))
    rows = once(rows.withColumn("_h", hit), "_h")

    def scored(s: Column, i: Column) -> Column:
        upto = F.coalesce(F.get("_s", i + 5)["first"], F.size("_h"))
        near = F.slice("_h", s["first"] + 1, upto - s["first"])
        return s.withField("hits", F.filter(near, lambda h: h["byte"] < s["byte"] + F.octet_length(s["text"]) + 4))

    rows = rows.withColumn("_s", F.filter(F.transform("_s", scored), lambda s: (F.size(s["hits"]) > 0) & (s["text"] != "")))
    rows = once(rows, "_s").select(*keys, F.explode("_s").alias("s")).select(*keys, "s.text", "s.line", F.transform("s.hits", lambda h: stripped(h["word"])).alias("_w"))
    words = F.size(F.split(F.col("text"), r"(?U)\s+"))
    hits = F.size("_w")
    cut = F.when(F.octet_length("text") > 100, F.concat(F.make_valid_utf8(F.substring(F.encode("text", "UTF-8"), 1, 97).cast("string")), F.lit("…"))).otherwise(F.col("text"))
    matched = F.filter("_w", lambda w: (w != "") & (F.octet_length(w) < 60))
    return rows.select(*keys, F.regexp_replace(cut, "\ufffd+…$", "…").alias("text"), F.col("line"), hits.alias("hits"), (hits / words).alias("density"), matched.alias("matched_words"))


def top_sentences(df: DataFrame, n: int = 5) -> DataFrame:
    return sentence_scores(df, "path").orderBy(F.desc("density"), "path", "line", "text").limit(n)


def human(df: DataFrame) -> DataFrame:
    """A line of report for every match."""
    rows = once(df.withColumn("_p", placed("start", need=("line", "col"))), "_p").select("path", F.explode("_p").alias("p")).select("path", "p.*")
    shown = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit("↵"))
    return rows.select("path", F.col("m.start").alias("start"), F.format_string("%s:%d:%d [%s] %s -> %s", F.col("path"), F.col("start.line"), F.col("start.col"), F.col("m.rule_id"), shown("m.original"), shown("m.suggestion")).alias("line"))


def _json_of_file() -> Column:
    shown = F.transform(
        "_p",
        lambda p: F.struct(
            p["m"]["rule_id"].alias("rule_id"), p["m"]["category"].alias("category"), p["m"]["severity"].alias("severity"), p["m"]["confidence"].alias("confidence"),
            p["start"]["line"].alias("line"), p["start"]["col"].alias("col"), p["m"]["original"].alias("original"), p["m"]["suggestion"].alias("suggestion"),
            F.struct(p["m"]["kind"].alias("type"), F.when(p["m"]["kind"] == "Replace", p["m"]["suggestion"]).alias("value")).alias("kind"), p["m"]["description"].alias("description"),
        ),
    )
    score = F.struct(F.round("density", 6).alias("density"), F.size("matches").alias("total_matches"))
    return F.struct("path", score.alias("score"), shown.alias("matches"))


def json_files(df: DataFrame) -> DataFrame:
    """path, report: one JSON object for each file with matches."""
    return df.where(F.size("matches") > 0).withColumn("_p", placed("start", need=("line", "col"))).select("path", F.to_json(_json_of_file()).alias("report"))


def json_document(df: DataFrame) -> DataFrame:
    """report: one JSON object with the ``files`` in order of path and the ``summary``.

    One row holds all files with matches: for a report to be read, not for a corpus,
    where ``json_files`` gives a row for each.
    """
    n = F.size("matches")
    kept = F.when(n > 0, F.struct("path", F.to_json(_json_of_file()).alias("report")))
    all_of = df.withColumn("_p", placed("start", need=("line", "col"))).agg(F.array_sort(F.collect_list(kept)).alias("f"), *(c().alias(k) for k, c in _SUMMARY))
    body = F.concat(F.lit('{"files":['), F.array_join(F.transform("f", lambda x: x["report"]), ","), F.lit('],"summary":'), F.to_json(F.struct(*(k for k, _ in _SUMMARY))), F.lit("}"))
    return all_of.select(body.alias("report"))


def catalog(spark, settings: Settings) -> DataFrame:
    """The active rules and what they explain about themselves."""
    rows = []
    for reg, r in settings.rules():
        e = r.explain or (f"Pattern matched by rule '{r.id}'", "See rule definition", 0.0, "(no example)", "(no example)")
        rows.append((reg, r.id, r.category, *e))
    return spark.createDataFrame(rows, "priority int, rule_id string, category string, pattern_summary string, fix_behavior string, confidence double, example_input string, example_output string")


def catalog_with_hits(df: DataFrame, settings: Settings) -> DataFrame:
    """``catalog`` with the number of resolved matches of each rule in ``df``."""
    counts = rule_counts(df).withColumnRenamed("n", "hits")
    return catalog(df.sparkSession, settings).join(counts, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def _diffs(batches):
    import difflib

    import pandas as pd

    for pdf in batches:
        out = []
        for path, a, b in zip(pdf["path"], pdf["content"], pdf["cleaned"]):
            lines = difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{path}", f"b/{path}", n=3)
            out.append("".join(x if x.endswith("\n") else x + "\n" for x in lines))
        yield pd.DataFrame({"path": pdf["path"], "diff": out})


def unified_diff(df: DataFrame) -> DataFrame:
    """path, diff for changed files; line differences are beyond SQL, so Arrow batches go to Python."""
    return once(df.select("path", "content", "cleaned"), "cleaned").where("content <> cleaned").mapInPandas(_diffs, "path string, diff string")
