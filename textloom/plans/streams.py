"""The registered queries that run streams over the sample tables, and their DuckDB SQL."""

from __future__ import annotations

import time

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.modified import QUIET_MS, modified_files
from ..streaming.run import finished
from ..streaming.sessions import EVENT, LEAST, document_sessions
from ..streaming.watch import watch_quiet
from . import oracle as o
from .inject import view
from .rules import PROFILES, Settings

#: Time without a change after which a run of changes counts as one, and how far changes are out of order.
PAUSE, DELAY = "6 hours", "1 day"
#: How many times changes arrive, and how many of them a file holds: tasks write and read an arrival's files side by side.
ARRIVALS, FILE_ROWS = 4, 100_000
#: Folders over which the files of ``modified_documents`` are dealt: tasks list those that they read, not all files.
FOLDERS = 1024


def _write(batches, folder: str):
    fs, root = pa.fs.FileSystem.from_uri(folder)
    made = set()
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for path, content in zip(paths, batch.column("content").to_pylist()):
            if (above := path.rpartition("/")[0]) not in made:
                fs.create_dir(f"{root}/{above}", recursive=True)
                made.add(above)
            with fs.open_output_stream(f"{root}/{path}") as f:
                f.write(content.encode())
        yield pa.RecordBatch.from_arrays([pa.array([len(paths)])], names=["n"])


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row's ``content`` to its ``path`` below ``folder``, over what is there; the number of files."""
    found = df.where("path is not null and content is not null").select("path", "content")
    return found.mapInArrow(lambda batches: _write(batches, folder), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def modified_documents(spark, sf_dir, fresh, settings) -> DataFrame:
    """Three versions of all documents as files: as they are, those that cleaning changes, all with a line more.

    After each the stream takes what was modified; a row for every version of every file.  A file lies in one of
    FOLDERS folders by its path, which is what stands behind the last ``in``.
    """
    from ..operators.engine import once, process

    at = fresh(spark, "modified")
    docs = view(spark, sf_dir, "prose")
    done = once(process(docs, settings).select("path", "content", "cleaned"), "cleaned").select("path", "cleaned", (F.col("content") != F.col("cleaned")).alias("changed"))
    done.write.option("compression", "zstd").parquet(f"{at}/cleaned")  # matched once, for both later versions
    done = spark.read.schema(done.schema).parquet(f"{at}/cleaned")
    for version in (docs.select("path", "content"), done.where("changed").select("path", F.col("cleaned").alias("content")), done.select("path", F.concat("cleaned", F.lit("\nI hope this helps")).alias("content"))):
        dealt = F.concat(F.crc32(F.col("path").cast("binary")) % FOLDERS, F.lit("/in/"), "path")
        write_files(version.select(dealt.alias("path"), "content"), f"{at}/in")
        time.sleep(1.2 * QUIET_MS / 1000)
        finished(modified_files(spark, f"{at}/in", recursive=True), at)
    rows = spark.read.parquet(f"{at}/out").withColumn("path", F.substring_index("path", "/in/", -1))
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("seq")).alias("version"), "ext", "content")


def changes(spark, sf_dir) -> DataFrame:
    """Events as changes of their user's file, with 0 to 3 dashes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where("ts is not null").select(
        F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.concat("event_type", F.expr("repeat(' —', cast(event_id % 4 as int))")).alias("content"),
    )


def quiet_watch(spark, sf_dir, fresh) -> DataFrame:
    """Debounced watch of all events as one stream, once arriving in order and once up to half a day out of order."""
    log = changes(spark, sf_dir)
    low, high, n = log.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).first()
    if low is None:
        low, high = 0, 0
    last = spark.createDataFrame([("the end.md", high + 30 * 86400, 0, "")], "path string, s long, seq long, content string").select("path", F.timestamp_seconds("s").alias("ts"), "seq", "content")
    files, out = 1 + n // (ARRIVALS * FILE_ROWS), None
    for arrival, delayed in (("in order", F.lit(0)), ("out of order", F.col("seq") * 7919 % 43200)):
        at = fresh(spark, "quiet")
        piece = (F.unix_seconds("ts") + delayed - low) * ARRIVALS / (high - low + 43200)
        for k in range(ARRIVALS):  # some files after the others, as they would arrive
            log.where(F.floor(piece) == k).repartition(files).write.mode("append").parquet(f"{at}/log")
        last.coalesce(1).write.mode("append").parquet(f"{at}/log")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/log")
        finished(watch_quiet(stream, Settings("prose"), PAUSE, DELAY), at)
        got = spark.read.parquet(f"{at}/out").select(F.lit(arrival).alias("arrival"), "path", "seq", F.col("n_matches").cast("long").alias("n_matches"), "late", "previous")
        out = got if out is None else out.unionByName(got)
    return out


def session_events(spark, sf_dir) -> DataFrame:
    """Conversations as editing sessions, each role's turns as versions of one document.

    A session begins with its options; each turn opens or changes its role's document, asks for edits
    at its beginning, closes it if it is the assistant's, and asks for those of the user's document.
    """
    turns = view(spark, sf_dir, "turns")
    turns = turns.withColumn("first", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) == 1)
    event = lambda seq, kind, uri, **more: F.struct(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), seq.cast("long").alias("seq"), kind.alias("kind"), F.concat(F.lit("file:///"), uri).alias("uri"),
        *((more.get(n, F.lit(None))).cast(t).alias(n) for n, t in (c.split() for c in EVENT.split(", ")[4:])),
    )
    at, here = F.col("turn") * 4 + 4, F.col("path")
    edits = {"start_line": F.lit(0), "start_character": F.lit(0), "end_line": F.lit(0), "end_character": F.lit(40)}
    user = F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("-user.md"))
    log = turns.select(F.explode(F.array_compact(F.array(
        event(at, F.when(F.col("first"), "open").otherwise("change"), here, text=F.col("content"), language=F.lit("markdown")),
        event(at + 1, F.lit("action"), here, **edits),
        F.when(F.col("role") == "assistant", event(at + 2, F.lit("close"), here)),
        event(at + 3, F.lit("action"), user, **edits),
    ))).alias("e")).select("e.*")
    options = turns.select("conv_id").distinct().select(event(
        F.lit(0), F.lit("initialize"), F.lit(""), profile=F.expr("element_at(array('prose', 'conservative', 'aggressive', 'none such'), cast(conv_id % 4 as int) + 1)"),
        min_confidence=F.expr("element_at(array(null, 0.8, 0.95), cast(conv_id % 3 as int) + 1)"),
    ).alias("e")).select("e.*")
    return options.unionByName(log)


def sessions(spark, sf_dir, fresh) -> DataFrame:
    """Diagnostics and edits of all conversations as sessions, a row each; events without any have one row of nulls."""
    at = fresh(spark, "sessions")
    log = session_events(spark, sf_dir)
    log.where("kind = 'initialize'").write.parquet(f"{at}/log")
    for half in (0, 1):  # the second half of each session comes in later files
        log.where("kind <> 'initialize'").where((F.col("seq") >= 20) == bool(half)).write.mode("append").parquet(f"{at}/log")
    finished(document_sessions(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/log")), at)
    rows = spark.read.parquet(f"{at}/out").select("session", "seq", F.col("kind").alias("event"), "uri", F.explode_outer("found").alias("d"))
    return rows.select("session", "seq", "event", "uri", *(F.col(f"d.{c}").alias(c) for c in ("rule_id", "severity", "start_line", "start_character", "end_line", "end_character", "kind", "new_text")))


def modified_sql(settings: Settings) -> str:
    return o.ctes("prose", settings, "cleaned") + """, versions AS (
      SELECT path, 1 AS n, content FROM cleaned WHERE content IS NOT NULL UNION ALL SELECT path, 2, cleaned FROM cleaned WHERE content <> cleaned
      UNION ALL SELECT path, 3, cleaned || chr(10) || 'I hope this helps' FROM cleaned WHERE cleaned IS NOT NULL)
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY n)::INTEGER AS version, 'md' AS ext, content FROM versions"""


def quiet_sql() -> str:
    return """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
      kept AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, g ORDER BY ts DESC, event_id DESC) = 1)
      SELECT arrival, 'u/' || user_id || '.md' AS path, event_id AS seq, event_id % 4 AS n_matches, false AS late, lag(event_id) OVER (PARTITION BY arrival, user_id ORDER BY ts) AS previous
      FROM kept, (VALUES ('in order'), ('out of order')) a(arrival)"""


def sessions_sql() -> str:
    masks = " ".join(f"WHEN {i} THEN [{o.names(sorted(PROFILES[p]))}]" for i, p in enumerate(("prose", "conservative", "aggressive", "prose")))
    every = Settings("aggressive", extra_profiles=("rust-pack",), min_confidence=0.0)
    rules = o.ctes("turns", every, "resolved").replace("FROM m WINDOW", f"""FROM (SELECT m.* FROM m JOIN v USING (doc_id)
      WHERE confidence >= CASE conv_id % 3 WHEN 0 THEN {LEAST} WHEN 1 THEN 0.8 ELSE 0.95 END AND list_contains(CASE conv_id % 4 {masks} END, category)) WINDOW""", 1)
    (a, b), (x, y) = o._at("s"), o._at("e")
    return f"""{rules}, told AS (SELECT doc_id, rule_id, CASE WHEN kind <> 'FlagOnly' AND confidence >= 0.85 THEN 'Error' ELSE 'Warning' END AS severity, {a} AS start_line, {b} AS start_character, {x} AS end_line, {y} AS end_character,
        kind, CASE WHEN kind LIKE 'Delete%' THEN '' ELSE suggestion END AS new_text FROM resolved),
      edits AS (SELECT * FROM told WHERE kind <> 'FlagOnly' AND start_line = 0 AND start_character <= 40),
      turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS fresh,
        last_value(CASE WHEN role = 'user' THEN doc_id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS of_user FROM v),
      asked AS (SELECT conv_id, 4 * turn + 4 AS seq, CASE WHEN fresh THEN 'open' ELSE 'change' END AS event, path, doc_id AS at FROM turns
        UNION ALL SELECT conv_id, 4 * turn + 5, 'action', path, doc_id FROM turns
        UNION ALL SELECT conv_id, 4 * turn + 6, 'close', path, NULL FROM turns WHERE role = 'assistant'
        UNION ALL SELECT conv_id, 4 * turn + 7, 'action', 'c/' || conv_id || '-user.md', of_user FROM turns)
      SELECT 's' || conv_id AS session, seq, event, 'file:///' || path AS uri, f.* EXCLUDE (doc_id, e) FROM asked
      LEFT JOIN (SELECT *, 'action' AS e FROM edits UNION ALL SELECT *, 'open' FROM told) f ON f.doc_id = asked.at AND (f.e = 'action') = (event = 'action')"""

