"""The registered query of rule files by folder, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine
from ..operators.nearest import process_nearest
from ..sources.rule_files import compiled, parse
from . import oracle as o
from .inject import view
from .rules import Settings

#: Folder and rule file: each message names its folder, so that it tells which file's rule it is.
FILES = [
    ("", 'rule order\n  match: "(of|in) (the|a) "\n  fix: "$2 $1 "\n  message: "order of all"\nrule phrase\n  match: "that the"\n  fix: "which the"\n  message: "phrase of all"\ndisable ellipsis\n'),
    ("docs/en", 'rule phrase\n  match: "and the"\n  fix: delete\n  message: "phrase of en"\ndisable em-dash\n'),
    ("docs/en/src3", 'rule order\n  match: "the (of|in)"\n  fix: flag\n  severity: error\n  message: "order of src3"\nrule more\n  match: "shall we"\n  fix: flag\n  message: "more of src3"\n'),
    ("docs/de", 'rule phrase\n  match: "der die"\n  fix: "die der"\n  message: "phrase of de"\ndisable order\n'),
    ("docs/e", 'rule order\n  match: "[a-z]+"\n  fix: delete\n  message: "of no document"\n'),
]
CONSERVATIVE = Settings("conservative")


def nearest_rules(spark, sf_dir) -> DataFrame:
    """Documents in folders by language and source, each under the rules of the files above it."""
    files = spark.createDataFrame(FILES, "folder string, content string")
    return engine.match_rows(process_nearest(view(spark, sf_dir, "tree"), files, CONSERVATIVE), "doc_id", "path").select(
        "doc_id", "path", "rule_id", "description", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "line", "col", "original", "suggestion", "kind", "severity"
    )


def sql() -> str:
    rules = sorted(((folder, compiled(p)) for folder, text in FILES for p in parse(text)[0]), key=lambda r: (r[1].id, r[0]))
    named = ", ".join(f"({o.lit(f)}, {o.lit(r.id)}, {o.lit(r.description)})" for f, r in rules)
    off = ", ".join(f"({o.lit(f)}, {o.lit(i)})" for f, text in FILES for i in parse(text)[1])
    out = o.ctes("tree", Settings("conservative", file_rules=tuple(r for _, r in rules)), "resolved").replace("WITH v AS", "WITH RECURSIVE v AS", 1)
    above = r"CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
    out = out.replace("chained AS (", f"""up AS (SELECT doc_id, {above.format('path')} AS place FROM v WHERE path IS NOT NULL UNION ALL SELECT doc_id, {above.format('place')} FROM up WHERE place <> ''),
    force AS (SELECT doc_id, what FROM up JOIN (VALUES {named}) f(folder, name, what) ON folder = place QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY length(place) DESC) = 1),
    gone AS (SELECT DISTINCT doc_id, name FROM up JOIN (VALUES {off}) f(folder, name) ON folder = place),
    chained AS (""", 1).replace("FROM m WINDOW", """FROM (SELECT * FROM m WHERE (category <> 'custom' OR EXISTS (SELECT 1 FROM force WHERE force.doc_id = m.doc_id AND what = description))
      AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = m.doc_id AND name = rule_id)) WINDOW""", 1)
    return f"{out} SELECT doc_id, path, rule_id, description, s::INTEGER AS span_start, e::INTEGER AS span_end, {o.LINE} AS line, {o.COL} AS col, original, suggestion, kind, severity FROM resolved"
