"""The registered queries over the injected views, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine, report
from ..operators.comments import comment_spans, file_type
from ..sources.files import decoded, without, write_cleaned
from ..sources.rule_files import merged_texts, rules_from, validated
from . import oracle as o
from . import streams, tree
from .inject import view
from .rules import Settings, builtin

ALL_PROSE = Settings("prose", custom_phrases=("of the", "the by"))
ALL_CODE = Settings("aggressive", extra_profiles=("rust-pack",))
SHOWN = ("doc_id", "path", "rule_id", "category", "severity", "confidence", "line", "col", "original", "suggestion", "kind", "description")
RULES = '''
# user-defined rules
rule literal-phrase
  match: "that the"
  fix: "which the"
  confidence: 0.8
rule swap-words
  match: "(of|in) (the|a) "
  fix: "$2 $1 "
  message: "order"
rule drop-line
  match: "Surely"
  fix: delete-line
  severity: error
rule only-seven
  match: "shall we"
  fix: flag
rule markdown-only
  match: "In summary"
  fix: delete
  files: *.md
disable ellipsis
'''
_FOUND, _OFF = rules_from(RULES)
DSL = Settings("conservative", file_rules=_FOUND, disabled=_OFF)
OUTER = '''
rule order
  match: "(of|in) (the|a) "
  fix: "$2 $1 "
rule phrase
  match: "that the"
  fix: "which the"
disable ellipsis
'''
INNER = '''
rule phrase
  match: """(?x) is \\s
    worth """
  fix: "it is good"
  severity: error
disable em-dash
'''
EXCLUDES = ("**/*3.md", "docs/1?.md")


def matches(spark, sf_dir, name: str, settings: Settings, resolve: bool = True) -> DataFrame:
    df = view(spark, sf_dir, name)
    df = engine.process(df, settings) if resolve else engine.raw_matches(df, settings)
    return engine.match_rows(df, "doc_id", "path").select(*SHOWN, F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def processed(spark, sf_dir, name: str, settings: Settings) -> DataFrame:
    return engine.process(view(spark, sf_dir, name), settings)


def _both(spark, sf_dir) -> DataFrame:
    return processed(spark, sf_dir, "prose", ALL_PROSE)


def density(spark, sf_dir):
    return _both(spark, sf_dir).select("doc_id", F.size("matches").cast("long").alias("total_matches"), F.round("density", 6).alias("density"))


def cleaned_text(spark, sf_dir, name, settings):
    return processed(spark, sf_dir, name, settings).select("doc_id", "cleaned")


def file_types(spark, sf_dir):
    df = view(spark, sf_dir, "code").select("doc_id", "ext", file_type(F.col("ext")).alias("file_type"), file_type(F.col("ext"), "py").alias("forced"), file_type(F.col("ext"), "cobol").alias("fallback"))
    return df


def comments(spark, sf_dir):
    df = view(spark, sf_dir, "code").select("doc_id", F.explode(comment_spans(F.col("content"), F.col("ext"))).alias("s"))
    return df.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def coverage(spark, sf_dir):
    return report.coverage(processed(spark, sf_dir, "prose", ALL_CODE), ALL_CODE)


def sentence_scores(spark, sf_dir):
    s = report.sentence_scores(_both(spark, sf_dir), "doc_id")
    return s.select("doc_id", "text", F.col("line").cast("int").alias("line"), F.col("hits").cast("long").alias("hits"), F.round("density", 6).alias("density"), F.array_join("matched_words", "|").alias("matched_words"))


def top5_sentences(spark, sf_dir):
    return report.top_sentences(_both(spark, sf_dir)).select("path", "text", F.col("hits").cast("long").alias("hits"), F.round("density", 6).alias("density"))


def profile_matrix(spark, sf_dir):
    """The rules of each profile in order, and how many matches each has in the prose view before overlaps are resolved."""
    from .rules import PROFILES

    rows = spark.createDataFrame([(p, i, r.id) for p in PROFILES for i, r in Settings(p).rules()], "profile string, priority int, rule_id string")
    found = engine.raw_matches(view(spark, sf_dir, "prose"), ALL_CODE).select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return rows.join(found, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rules_catalog(spark, sf_dir):
    """What each rule says of itself, and how often it is found in the code view."""
    return report.catalog_with_hits(processed(spark, sf_dir, "code", ALL_CODE), ALL_CODE)


def diagnostics(spark, sf_dir):
    return engine.diagnostics(processed(spark, sf_dir, "prose", ALL_PROSE), "doc_id").drop("message")


def code_actions(spark, sf_dir):
    df = engine.begun_by(processed(spark, sf_dir, "prose", ALL_PROSE), 0, 40)
    return engine.code_actions(engine.diagnostics(df, "doc_id"), 0, 0, 0, 40).drop("message")


def human_report(spark, sf_dir):
    return report.human(_both(spark, sf_dir)).select("path", "line")


def json_report(spark, sf_dir):
    return report.json_files(processed(spark, sf_dir, "code", ALL_CODE))


def unified_diff(spark, sf_dir):
    return report.unified_diff(processed(spark, sf_dir, "code", ALL_CODE))


def accepted_matches(spark, sf_dir):
    """Those that begin at an even character; matched once, for the decisions and for what they are applied to."""
    found, path = processed(spark, sf_dir, "prose", ALL_PROSE).select("doc_id", "content", "matches"), f"{_fresh(spark, 'accepted')}/found"
    found.write.option("compression", "zstd").parquet(path)
    df = spark.read.schema(found.schema).parquet(path)
    d = df.select("doc_id", F.explode("matches").alias("m")).select("doc_id", F.col("m.start").alias("start"), (F.col("m.start") % 2 == 0).alias("accept"), F.when(F.col("m.rule_id") == "hedges", "NB: ").alias("edit"))
    return engine.apply_decisions(df, d, "doc_id").select("doc_id", F.size("matches").cast("long").alias("accepted"), "cleaned")


#: Rule files made of documents, by doc_id modulo their number: a phrase of the text, and perhaps errors.
RULE_FILES = (
    """concat('rule a', chr(10), '  match: "', phrase, '"', chr(10), '  fix: delete', chr(10))""",
    """concat('rule b', chr(10), '  sevrity: warn', chr(10), '  match: "', phrase, '"', chr(10), '  fix: delete', chr(10), 'disable', chr(10))""",
    """concat('# ', phrase, chr(10), 'rule c', chr(10), '  match: "', phrase, '"', chr(10), '  confidence: 3', chr(10))""",
    """concat('rule d', chr(10), '  match: "', phrase, ' ["', chr(10), '  fix: ', phrase, 'x', chr(10), 'rule e', chr(10), '  fix: flag', chr(10))""",
)
#: The phrase: the first word of the text if it has only letters from a to z.
PHRASE = "coalesce(nullif(regexp_extract(text, '^[A-Za-z]+', 0), ''), 'word')"


def rule_file_errors(spark, sf_dir):
    """The checker over a rule file for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("rules/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.expr(PHRASE).alias("phrase"))
    content = F.expr("CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(RULE_FILES)) + " END")
    return validated(docs.select("path", content.alias("content")))


def merged_rules(spark, sf_dir):
    """Rules of an outer and an inner file: the inner one's for equal names, disables of both."""
    rules, disabled = merged_texts([("outer", OUTER), ("inner", INNER)])
    return matches(spark, sf_dir, "prose", Settings("conservative", file_rules=tuple(rules), disabled=tuple(disabled)))


def file_texts(spark, sf_dir):
    """Documents as files of bytes, some binary, some with invalid bytes: excluded, passed over, decoded."""
    tail = F.when(F.col("doc_id") % 7 == 0, F.lit(bytearray(b"\0"))).when(F.col("doc_id") % 5 == 0, F.lit(bytearray(b"\xff."))).otherwise(F.lit(bytearray()))
    raw = view(spark, sf_dir, "prose").select("path", F.concat(F.encode("content", "UTF-8"), tail).alias("content"))
    return decoded(without(raw, EXCLUDES))


def changed_texts(spark, sf_dir):
    """What is written for the files whose text changed."""
    path = f"{_fresh(spark, 'cleaned')}/out"
    write_cleaned(_both(spark, sf_dir), path)
    return spark.read.parquet(path)


def debounced_changes(spark, sf_dir):
    """Events as changes of their user's file: the last of each run."""
    from ..streaming.watch import debounced

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return debounced(events.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("content")), "6 hours")


def _fresh(spark, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def watch_stream(spark, sf_dir):
    """The watch operator over an append log of changes, read as a stream once."""
    from ..streaming.watch import watch

    log = view(spark, sf_dir, "prose").select("path", F.lit(1).cast("long").alias("seq"), "content")
    log = log.unionByName(log.select("path", F.lit(2).cast("long").alias("seq"), F.concat("content", F.lit("\nI hope this helps")).alias("content")))
    at = _fresh(spark, "watch")
    log.write.parquet(f"{at}/log")
    streams.finished(watch(spark.readStream.schema(log.schema).parquet(f"{at}/log"), Settings("prose")), at)
    return spark.read.parquet(f"{at}/out").select("path", "seq", "n_matches", F.length("diff").alias("diff_chars"))


def queries() -> dict:
    out = {}
    for r in builtin():
        view_name, s = ("code", ALL_CODE) if r.code_only else ("prose", ALL_PROSE)
        out[f"rule_{r.id.replace('-', '_')}"] = partial(matches, name=view_name, settings=s.only(r.id), resolve=False)
    out |= {
        "custom_phrases": partial(matches, name="prose", settings=ALL_PROSE.only("custom-phrases"), resolve=False),
        "dsl_rules": partial(matches, name="prose", settings=DSL),
        "dsl_cleaned": partial(cleaned_text, name="prose", settings=DSL),
        "allow_symbols": partial(matches, name="prose", settings=Settings("conservative", allow_symbols=("✓", "→x"))),
        "prose_in_code": partial(matches, name="code", settings=Settings("prose")),
        "resolved_prose": partial(matches, name="prose", settings=ALL_PROSE),
        "resolved_code": partial(matches, name="code", settings=ALL_CODE),
        "skip_fix": partial(matches, name="prose", settings=replace(ALL_PROSE, skip=("em-dash",), fix=("em-dash", "hedges", "emoji"))),
        "min_confidence": partial(matches, name="prose", settings=replace(ALL_PROSE, min_confidence=0.85)),
        "forced_language": partial(matches, name="code", settings=replace(ALL_CODE, lang="md")),
        "cleaned_prose": partial(cleaned_text, name="prose", settings=ALL_PROSE),
        "cleaned_code": partial(cleaned_text, name="code", settings=ALL_CODE),
        "density": density,
        "file_types": file_types,
        "comment_spans": comments,
        "rule_counts": lambda s, d: report.rule_counts(_both(s, d)),
        "category_counts": lambda s, d: report.category_counts(_both(s, d)),
        "worst_rule": lambda s, d: report.worst_rule(_both(s, d)),
        "summary": lambda s, d: report.summary(_both(s, d)),
        "max_density": lambda s, d: report.max_density(_both(s, d), 5.0),
        "file_ranking": lambda s, d: report.file_ranking(_both(s, d)),
        "coverage": coverage, "sentence_scores": sentence_scores, "top5_sentences": top5_sentences, "profile_matrix": profile_matrix, "rules_catalog": rules_catalog,
        "diagnostics": diagnostics, "code_actions": code_actions, "human_report": human_report, "json_report": json_report, "unified_diff": unified_diff,
        "accepted_matches": accepted_matches, "rule_file_errors": rule_file_errors, "watch_stream": watch_stream,
        "merged_rules": merged_rules, "file_texts": file_texts, "changed_texts": changed_texts, "debounced_changes": debounced_changes,
        "modified_documents": lambda s, d: streams.modified_documents(s, d, _fresh, ALL_PROSE),
        "quiet_watch": lambda s, d: streams.quiet_watch(s, d, _fresh),
        "nearest_rules": tree.nearest_rules,
        "document_sessions": lambda s, d: streams.sessions(s, d, _fresh),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for r in builtin():
        view_name, s = ("code", ALL_CODE) if r.code_only else ("prose", ALL_PROSE)
        out[f"rule_{r.id.replace('-', '_')}"] = o.match_sql(view_name, s.only(r.id), "m")
    top = o.ctes("prose", ALL_PROSE, "resolved")
    ids = o.names(r.id for _, r in ALL_CODE.rules())
    starts = f"""{top},
    parts AS (SELECT doc_id, path, i, raw, ends, unnest(range(1, len(raw) + 1)) AS i2 FROM (SELECT doc_id, path, 0 AS i, regexp_split_to_array(content, '[.!?][\\s\\x{{00A0}}]') AS raw, regexp_extract_all(content, '[.!?][\\s\\x{{00A0}}]') AS ends FROM v)),
    cut AS (SELECT doc_id, path, i2 AS i, CASE WHEN i2 > 1 THEN substring(ends[i2 - 1], 2) ELSE '' END || raw[i2] || CASE WHEN i2 <= len(ends) THEN left(ends[i2], 1) ELSE '' END AS p FROM parts),
    sent AS (SELECT doc_id, path, i, {o.stripped('p')} AS t, coalesce(sum(strlen(p)) OVER w, 0)::BIGINT AS b, 1 + coalesce(sum(length(p) - length(replace(p, chr(10), ''))) OVER w, 0)::BIGINT AS line FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    starts_at AS (SELECT doc_id, s, {o.stripped('original')} AS word, strlen(substring(content, 1, s)) AS b FROM resolved),
    scores AS (SELECT sent.doc_id, path, i, t, line, count(*) AS hits, count(*) / greatest(len(list_filter(regexp_split_to_array(t, '[\\s\\x{{00A0}}]+'), lambda x: x <> '')), 1)::DOUBLE AS d,
      string_agg(word, '|' ORDER BY s) FILTER (WHERE word <> '' AND strlen(word) < 60) AS words FROM sent JOIN starts_at a ON a.doc_id = sent.doc_id AND a.b >= sent.b AND a.b < sent.b + strlen(t) + 4 WHERE t <> '' GROUP BY sent.doc_id, path, i, t, line)"""
    out |= {
        "custom_phrases": o.match_sql("prose", ALL_PROSE.only("custom-phrases"), "m"),
        "dsl_rules": o.match_sql("prose", DSL),
        "dsl_cleaned": o.ctes("prose", DSL, "cleaned") + " SELECT doc_id, cleaned FROM cleaned",
        "prose_in_code": o.match_sql("code", Settings("prose")),
        "resolved_prose": o.match_sql("prose", ALL_PROSE),
        "resolved_code": o.match_sql("code", ALL_CODE),
        "skip_fix": o.match_sql("prose", replace(ALL_PROSE, skip=("em-dash",), fix=("em-dash", "hedges", "emoji"))),
        "min_confidence": o.match_sql("prose", replace(ALL_PROSE, min_confidence=0.85)),
        "cleaned_prose": o.ctes("prose", ALL_PROSE, "cleaned") + " SELECT doc_id, cleaned FROM cleaned",
        "cleaned_code": o.ctes("code", ALL_CODE, "cleaned") + " SELECT doc_id, cleaned FROM cleaned",
        "density": top + " SELECT doc_id, n::BIGINT AS total_matches, round(density, 6) AS density FROM scored",
        "file_types": f"SELECT doc_id, ext, CASE WHEN ext IN ({o.names(o.c.CODE)}) THEN 'code' ELSE 'prose' END AS file_type, 'code' AS forced, CASE WHEN ext IN ({o.names(o.c.CODE)}) THEN 'code' ELSE 'prose' END AS fallback FROM ({o.duckdb_sql('code')})",
        "comment_spans": o.ctes("code", ALL_CODE, "spans") + " SELECT doc_id, s::INTEGER AS span_start, e::INTEGER AS span_end FROM spans",
        "rule_counts": top + " SELECT rule_id, count(*) AS n FROM resolved GROUP BY rule_id",
        "category_counts": top + " SELECT path, string_agg(category || ':' || n, ', ' ORDER BY category || ':' || n) AS categories FROM (SELECT path, category, count(*) AS n FROM resolved GROUP BY path, category) GROUP BY path",
        "worst_rule": top + " SELECT rule_id, count(*) AS n FROM resolved GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 1",
        "summary": top + " SELECT count(*) AS files_scanned, count_if(n > 0)::BIGINT AS files_with_matches, sum(n)::BIGINT AS total_matches FROM scored",
        "max_density": top + " SELECT round(coalesce(max(density), 0.0), 6) AS max_density, coalesce(max(density), 0.0) > 5.0 AS exceeds FROM scored WHERE n > 0",
        "file_ranking": top + " SELECT path, n::BIGINT AS total_matches, round(density, 6) AS density FROM scored WHERE n > 0",
        "coverage": o.ctes("prose", ALL_CODE, "resolved") + f" SELECT rule_id FROM (SELECT unnest([{ids}]) AS rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM resolved)",
        "human_report": top + f" SELECT path, path || ':' || {o.LINE} || ':' || {o.COL} || ' [' || rule_id || '] ' || replace(original, chr(10), '↵') || ' -> ' || replace(suggestion, chr(10), '↵') AS line FROM resolved",
        "profile_matrix": f"SELECT p.*, coalesce(n, 0) AS n FROM ({o.PROFILE_SQL}) p LEFT JOIN ({o.ctes('prose', ALL_CODE, 'm')} SELECT rule_id, count(*) AS n FROM m GROUP BY rule_id) USING (rule_id)",
        "allow_symbols": o.match_sql("prose", Settings("conservative", allow_symbols=("✓", "→x"))),
        "forced_language": o.match_sql("code", replace(ALL_CODE, lang="md")),
        "diagnostics": o.diagnostics_sql("prose", ALL_PROSE) + " SELECT * FROM diagnostic",
        "code_actions": o.diagnostics_sql("prose", ALL_PROSE) + " SELECT * FROM diagnostic WHERE kind <> 'FlagOnly' AND start_line = 0 AND start_character <= 40",
        "accepted_matches": o.accepted_sql("prose", ALL_PROSE),
        # one file with what should come of the two
        "merged_rules": o.match_sql("prose", Settings("conservative", disabled=("ellipsis", "em-dash"), file_rules=rules_from(
            'rule order\n  match: "(of|in) (the|a) "\n  fix: "$2 $1 "\nrule phrase\n  match: "is[ ]worth"\n  severity: error\n  fix: "it is good"\n')[0])),
        "file_texts": f"""SELECT path, 'md' AS ext, content || CASE WHEN doc_id % 5 = 0 THEN '\ufffd.' ELSE '' END AS content FROM ({o.duckdb_sql('prose')})
          WHERE doc_id % 7 <> 0 AND path NOT LIKE '%3.md' AND path NOT LIKE 'docs/1_.md' AND content IS NOT NULL""",
        "changed_texts": o.ctes("prose", ALL_PROSE, "cleaned") + " SELECT path, cleaned FROM cleaned WHERE content <> cleaned",
        "debounced_changes": """WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
          g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
          SELECT 'u/' || user_id AS path, event_id AS seq, event_type AS content FROM g QUALIFY row_number() OVER (PARTITION BY user_id, g ORDER BY ts DESC, event_id DESC) = 1""",
    }
    rows = []
    for reg, r in ALL_CODE.rules():
        e = r.explain or (f"Pattern matched by rule '{r.id}'", "See rule definition", 0.0, "(no example)", "(no example)")
        rows.append(f"({reg}, {o.names([r.id, r.category, *e[:2]])}, {e[2]}::DOUBLE, {o.names(e[3:])})")
    out["rules_catalog"] = o.ctes("code", ALL_CODE, "resolved") + f""" SELECT c.*, coalesce(hits, 0) AS hits FROM (VALUES {', '.join(rows)}) c(priority, rule_id, category, pattern_summary, fix_behavior, confidence, example_input, example_output)
      LEFT JOIN (SELECT rule_id, count(*) AS hits FROM resolved GROUP BY rule_id) USING (rule_id)"""
    out["rule_file_errors"] = f"""WITH f AS (SELECT doc_id, 'rules/' || doc_id AS path, {PHRASE} AS phrase FROM documents)
      SELECT path, line, message FROM f JOIN (VALUES (1, 2, 'unknown field ''sevrity'', did you mean ''severity''?'), (1, 5, 'empty disable directive'),
        (2, 2, 'rule ''c'' has no fix'), (2, 4, 'confidence must be a number from 0 to 1, got: 3'), (3, 4, 'rule ''e'' has no match')) e(kind, line, message) ON doc_id % 4 = kind
      UNION ALL SELECT path, 3, 'replacement must be in quotes: ' || phrase || 'x' FROM f WHERE doc_id % 4 = 3
      UNION ALL SELECT path, 1, 'rule ''d'' has an invalid pattern: unterminated character set at position ' || (length(phrase) + 1) FROM f WHERE doc_id % 4 = 3"""
    out |= {"modified_documents": streams.modified_sql(ALL_PROSE), "quiet_watch": streams.quiet_sql(), "document_sessions": streams.sessions_sql(), "nearest_rules": tree.sql()}
    short = "CASE WHEN strlen(t) > 100 THEN left(t, list_max(list_filter(range(0, 98), lambda k: strlen(left(t, k)) <= 97))) || '…' ELSE t END"
    out["sentence_scores"] = starts + f" SELECT doc_id, {short} AS text, line::INTEGER AS line, hits, round(d, 6) AS density, coalesce(words, '') AS matched_words FROM scores"
    out["top5_sentences"] = starts + f" SELECT path, {short} AS text, hits, round(d, 6) AS density FROM scores ORDER BY d DESC, path, line, text LIMIT 5"
    return out
