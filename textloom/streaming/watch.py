"""Watching documents: a stream of changes rescanned by the same column expressions.

A change is (path, seq, content).  Matching is stateless; the last content of each
path is the only state, and differences are of that against the cleaned new text.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.engine import process
from ..plans.rules import Settings

#: Changes of a path that follow each other within this time count as one.
QUIET = "500 milliseconds"
OUT = "path string, seq long, n_matches int, late boolean, previous long, diff string"


class _Watch(StatefulProcessor):
    """The last ``seq`` and content of a path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, content string")

    def handleInputRows(self, key, rows, timerValues):
        before, last = self.last.get() or (None, None)
        for r in sorted(rows, key=lambda r: (r.seq is not None, r.seq or 0)):
            seq, content, cleaned, n = r.seq, r.content, r.cleaned, r.n
            if seq is None or (before is not None and seq <= before):
                yield Row(path=key[0], seq=seq, n_matches=n, late=True, previous=None, diff="")
                continue
            diff = ""
            if n and last is not None and last != cleaned:
                diff = "".join(x if x.endswith("\n") else x + "\n" for x in difflib.unified_diff(last.splitlines(keepends=True), cleaned.splitlines(keepends=True), f"a/{key[0]}", f"b/{key[0]}", n=3))
            yield Row(path=key[0], seq=seq, n_matches=n, late=False, previous=before, diff=diff)
            before, last = seq, content
        if before is not None:
            self.last.update((before, last))

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """path, seq, content: the last change of each run of changes of a path without a pause of ``quiet``.

    ``changes`` also has the time ``ts``; changes without one are left out.  On a stream it
    needs a watermark on ``ts``, and a run is given out once the watermark has passed its end.
    """
    last = F.max_by(F.struct("seq", "content"), F.struct("ts", "seq")).alias("last")
    return changes.groupBy("path", F.session_window("ts", quiet)).agg(last).select("path", "last.seq", "last.content")


def watch(changes: DataFrame, settings: Settings) -> DataFrame:
    """A row for every change: its matches, and the difference from the path's last content.

    ``seq`` orders the changes of a path, also across micro-batches: a change that is not after
    the last one (repeated, late or without ``seq``) is ``late``, has no difference and does not
    become the last content.  ``previous`` is the ``seq`` of the content that the difference is from.
    A task holds the changes that one path has in one micro-batch, and the path's last content.
    Needs a state store with several column families (``run.finished`` sets it).
    """
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    df = process(changes.withColumn("ext", F.when(ext != "", ext)), settings)
    df = df.select("path", "seq", "content", "cleaned", F.size("matches").alias("n"))
    return df.groupBy("path").transformWithState(_Watch(), OUT, "Append", "None")


def watch_quiet(changes: DataFrame, settings: Settings, quiet: str = QUIET, delay: str = "1 minute") -> DataFrame:
    """``watch`` behind ``debounced``, as one stream with two stateful operators.

    ``delay`` is the watermark: how far changes may be out of order.  A run of changes reaches
    ``watch`` when the watermark passes its end, so runs of a path come in the order of their
    ends and none is late; changes behind the watermark are dropped, as in any stream.
    What is left is dealt out by change before it is scanned: a path of many changes is
    scanned by many tasks, and the two operators' states are in different tasks, as they have to be.
    """
    quiet_changes = debounced(changes.withWatermark("ts", delay), quiet)
    return watch(quiet_changes.repartition("path", "seq"), settings)
