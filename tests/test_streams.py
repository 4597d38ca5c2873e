import datetime
import os
import pickle
import shutil
import time

from pyspark.sql import functions as F

from textloom.plans.rules import Settings
from textloom.sources import modified
from textloom.sources.modified import ModifiedReader, modified_files
from textloom.streaming.run import PROVIDER, finished
from textloom.streaming.sessions import EVENT, answers, document_sessions
from textloom.streaming.watch import debounced, watch, watch_quiet

CHANGE = "path string, ts timestamp, seq long, content string"


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def arrivals(spark, tmp_path, batches, schema):
    """A stream of which each list of rows is one micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_a_modified_file_comes_again(spark, tmp_path):
    folder, seen = tmp_path / "in", []

    def run():
        time.sleep(0.7)
        finished(modified_files(spark, f"file://{folder}", recursive=True, excludes=("**/skip*",)), str(tmp_path))
        rows = [(os.path.relpath(r.path, folder), r.ext, r.content) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq", "path").collect()]
        new = rows[len(seen) :]
        seen.extend(new)
        return sorted(new, key=str)

    put(folder / "a.md", b"one")
    put(folder / "deep" / "b", b"x\xffy")
    put(folder / "deep" / "c.bin", b"\0")
    put(folder / "skip.md", b"s")
    assert run() == [("a.md", "md", "one"), ("deep/b", None, "x�y")]
    put(folder / "a.md", b"two")
    put(folder / ".hidden.md", b"")
    assert run() == [(".hidden.md", "md", ""), ("a.md", "md", "two")]
    assert run() == []
    (folder / "a.md").unlink()
    (folder / ".hidden.md").unlink()  # the last that was seen
    assert run() == []
    put(folder / "a.md", b"three")
    assert run() == [("a.md", "md", "three")]


def test_offsets_wait_and_never_go_back(tmp_path):
    put(tmp_path / "a", b"1")
    reader = ModifiedReader({"path": str(tmp_path), "quietMs": "200"})
    assert reader.latestOffset() == reader.initialOffset()  # may be written still
    time.sleep(0.3)
    end = reader.latestOffset()
    (part,) = reader.partitions(reader.initialOffset(), end)
    assert [r["content"] for b in reader.read(part) for r in b.to_pylist()] == [b"1"]
    os.remove(tmp_path / "a")
    assert reader.latestOffset() == end and reader.partitions(end, end) == [] and list(reader.read(part)) == []


def test_the_driver_holds_no_files(tmp_path, monkeypatch):
    """Tasks get folders and shares of folders; each file between the offsets is read once, those written since are not."""
    monkeypatch.setattr(modified, "PARTITION_FILES", 10)
    monkeypatch.setattr(modified, "SHARES", 3)
    names = [f"flat/name{k}.md" for k in range(100)] + [f"deep/{k % 7}/x/name{k}.md" for k in range(40)] + ["name.md"]
    for name in names:
        put(tmp_path / name, name.encode())
    put(tmp_path / "none" / "x" / "y", b"")
    os.utime(tmp_path / "none" / "x" / "y", (2**32, 2**32))
    reader = ModifiedReader({"path": str(tmp_path), "quietMs": "0", "recursive": "true"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    held = [pickle.dumps(p) for p in parts]
    assert sum(h.count(b"name") for h in held) <= len(parts)  # that of the last file alone, which is the offset
    assert sum(h.count(b"flat") > 0 for h in held) >= 3 and sum(h.count(b"none") for h in held) == 0
    put(tmp_path / "flat" / "name5.md", b"later")
    (tmp_path / "flat" / "name6.md").unlink()
    shutil.rmtree(tmp_path / "deep" / "3")
    got = sorted((r["path"], r["content"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
    left = [n for n in names if n not in ("flat/name5.md", "flat/name6.md") and not n.startswith("deep/3/")]
    assert got == sorted((str(tmp_path / n), n.encode()) for n in left)
    after = reader.latestOffset()
    again = [r["content"] for p in reader.partitions(end, after) for b in reader.read(p) for r in b.to_pylist()]
    assert again == [b"later"]
    alone = ModifiedReader({"path": str(tmp_path), "quietMs": "0"})
    found = [r["content"] for p in alone.partitions(alone.initialOffset(), alone.latestOffset()) for b in alone.read(p) for r in b.to_pylist()]
    assert found == [b"name.md"]


def test_late_and_repeated_changes(spark, tmp_path):
    batches = [[("a.md", 1, "x"), ("b.md", 5, "y")], [("a.md", 3, "utilize"), ("a.md", 2, "of — it")], [("a.md", 2, "again"), ("a.md", None, "—"), ("b.md", 5, "y"), ("a.md", 4, None), (None, 1, "z")], [("a.md", 5, "— end")]]
    stream = arrivals(spark, tmp_path, batches, "path string, seq long, content string")
    former = spark.conf.get(PROVIDER, None)
    finished(watch(stream, Settings("prose")), str(tmp_path))
    assert spark.conf.get(PROVIDER, None) == former
    got = {(r.path, r.seq, r.n_matches, r.late, r.previous, bool(r["diff"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        ("a.md", 1, 0, False, None, False), ("b.md", 5, 0, False, None, False), ("a.md", 2, 1, False, 1, True), ("a.md", 3, 1, False, 2, True), ("a.md", 2, 0, True, None, False),
        ("a.md", None, 1, True, None, False), ("b.md", 5, 0, True, None, False), ("a.md", 4, 0, False, 3, False), (None, 1, 0, False, None, False), ("a.md", 5, 1, False, 4, False),
    }


def test_debounced_stream_equals_the_batch(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    cast = [("a.md", at(i * 0.4 + (3 if i > 4 else 0)), i, f"v{i}" + " —" * (i % 2)) for i in range(12)] + [("b.md", at(i * 0.7), 100 + i, "w") for i in range(6)]
    order = sorted(range(len(cast)), key=lambda i: (i * 7) % len(cast))  # out of order
    batches = [[cast[i] for i in order[k::3]] for k in range(3)] + [[("end.md", at(10**6), 0, "")]]
    finished(watch_quiet(arrivals(spark, tmp_path, batches, CHANGE), Settings("prose"), "500 milliseconds", "10 minutes"), str(tmp_path))
    got = sorted((r.path, r.seq, r.previous, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    kept = sorted((r.path, r.seq) for r in debounced(spark.createDataFrame(cast, CHANGE)).collect())
    assert got == [(p, q, kept[i - 1][1] if i and kept[i - 1][0] == p else None, False) for i, (p, q) in enumerate(kept)]
    assert len(kept) == 8


def event(session, seq, kind, uri=None, text=None, language=None, profile=None, least=None, at=(0, 0, 0, 99)):
    return (session, seq, kind, uri, language, text, profile, least, *(at if kind == "action" else (None,) * 4))


def test_sessions(spark, tmp_path):
    md, py = "file:///x/a.md", "file:///x/b.py"
    batches = [
        [event("s", 1, "initialize", profile="conservative", least=0.9), event("s", 2, "open", md, "We utilize — it", "markdown"), event("t", 1, "open", md, "We utilize — it\nrobust", "markdown")],
        [event("s", 3, "change", md, "— —"), event("s", 5, "close", md), event("s", 4, "action", md, at=(0, 0, 0, 1)), event("t", 2, "action", md, at=(0, 4, 0, 4)), event("t", 3, "action", md, at=(1, 0, 9, 9))],
        [event("s", 6, "action", md), event("s", 3, "change", md, "late —"), event("s", 7, "change", py, "x = 1  # we utilize it\ny = '—'"), event("t", 4, "initialize", profile="none such")],
        [event("s", 8, "shutdown"), event("s", 9, "action", py), event("s", 10, "open", md, "utilize", "md"), event("t", 5, "open", "untitled", "utilize", None), event("t", 6, "open", md, None, "md"), event(None, 1, "open", md, "—", "md")],
    ]
    finished(document_sessions(arrivals(spark, tmp_path, batches, EVENT)), str(tmp_path))
    got = {(r.session, r.seq): (r.kind, [(f.rule_id, f.severity, f.start_line, f.start_character, f.end_character, f.new_text) for f in r.found]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    dash = lambda at, line=0: ("em-dash", "Error", line, at, at + 1, " - ")
    use = lambda at: ("hollow-intensifiers", "Warning", 0, at, at + 7, "use")
    assert got == {
        ("s", 2): ("open", [dash(11)]), ("t", 1): ("open", [use(3), dash(11), ("hollow-intensifiers", "Warning", 1, 0, 6, "")]),
        ("s", 3): ("change", [dash(0), dash(2)]), ("s", 4): ("action", [dash(0)]), ("s", 5): ("close", []), ("t", 2): ("action", [use(3)]), ("t", 3): ("action", []),
        ("s", 6): ("action", []), ("s", 7): ("change", [dash(5, 1)]), ("s", 9): ("action", []), ("s", 10): ("open", [use(0)]), ("t", 5): ("open", [use(0)]), ("t", 6): ("open", []), (None, 1): ("open", [dash(0)]),
    }


def test_answers_of_nothing(spark):
    assert answers(spark.createDataFrame([], EVENT)).count() == 0
    assert answers(spark.createDataFrame([event("s", 1, "late", "file:///a.md", "—")], EVENT).withColumn("extra", F.lit(1))).count() == 0
