"""Editing sessions as a stream: open documents are state, their diagnostics and edits are answers.

An event has session, seq, kind and, as the kind needs them, uri, language, text,
profile, min_confidence and a range.  Kinds:

``initialize``  sets the session's profile (``prose`` if it is none that there is) and least confidence
``open``        a document's text and language
``change``      its whole new text; the language is then what follows the last full stop of the uri
``close``       forgets the document
``action``      asks for the edits that touch a range of it
``shutdown``    forgets the session
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.comments import CODE, PROSE
from ..operators.engine import ByRow, placed, process
from ..plans.rules import DELETE_BLOCK, DELETE_LINE, FLAG, PROFILES, Settings

RANGE = ("start_line", "start_character", "end_line", "end_character")
EVENT = "session string, seq long, kind string, uri string, language string, text string, profile string, min_confidence double, " + ", ".join(f"{c} int" for c in RANGE)
#: Least confidence of sessions that set none.
LEAST = 0.6
#: All rules there are: each row says which of them are active.
EVERY = Settings("aggressive", extra_profiles=("rust-pack",), min_confidence=0.0)
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class _Sessions(StatefulProcessor):
    """Of a session: its options and last ``seq``, and text and language of each open document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.options = handle.getValueState("options", "seq long, profile string, min_confidence double")
        self.documents = handle.getMapState("documents", "uri string", "text string, language string")

    def handleInputRows(self, key, rows, timerValues):
        seq, profile, least = self.options.get() if self.options.exists() else (None, "prose", LEAST)
        out = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="first")
        for e in events[_COLUMNS].itertuples(index=False):
            row = e._asdict()
            if pd.isna(e.seq) or (seq is not None and e.seq <= seq):
                out.append(row | {"kind": "late"})
                continue
            seq, uri = int(e.seq), (e.uri,)
            if e.kind == "initialize":
                profile = e.profile if e.profile in PROFILES else "prose"
                least = LEAST if pd.isna(e.min_confidence) else float(e.min_confidence)
            elif e.kind in ("open", "change"):
                language = e.language if e.kind == "open" else (e.uri or "").rsplit(".", 1)[-1]
                self.documents.updateValue(uri, (e.text, language))
                out.append(row | {"language": language, "profile": profile, "min_confidence": least})
            elif e.kind == "close":
                self.documents.removeKey(uri)
                out.append(row | {"text": None, "profile": profile, "min_confidence": least})
            elif e.kind == "action":
                text, language = self.documents.getValue(uri) if self.documents.containsKey(uri) else (None, None)
                out.append(row | {"text": text, "language": language, "profile": profile, "min_confidence": least})
            elif e.kind == "shutdown":
                self.documents.clear()
                profile, least = "prose", LEAST
        if seq is not None:
            self.options.update((seq, profile, least))
        done = pd.DataFrame(out, columns=_COLUMNS)
        yield done.astype({c: "Int32" for c in RANGE} | {"seq": "Int64", "min_confidence": "float64"})

    def close(self) -> None:
        pass


def requests(events: DataFrame) -> DataFrame:
    """What each event asks for, with the document's text and the session's options as they were then.

    Rows of kind open, change, close and action; ``late`` for events that are not after the session's
    last (repeated or out of order; they change nothing).  Events of a session are taken in the order of
    ``seq`` within a micro-batch.  A task holds those that one session has in one micro-batch.
    """
    wanted = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in EVENT.split(", "))]
    return events.select(*wanted).groupBy("session").transformWithStateInPandas(_Sessions(), EVENT, "Append", "None")


def answers(asked: DataFrame) -> DataFrame:
    """session, seq, kind, uri and ``found``: the diagnostics after an open or change (none after a close),
    the edits that touch an action's range.

    One plan for all sessions: each row has the rules of its own profile, from its own least confidence on.
    Positions are 0-based lines and UTF-16 columns.  No state and no shuffle.
    """
    path = F.regexp_replace("uri", "^file://", "")
    ext = F.substring_index(path, ".", -1)
    known = {p: sorted(PROFILES[p]) for p in PROFILES}
    allowed = F.element_at(F.create_map(*(x for p, cs in known.items() for x in (F.lit(p), F.array(*map(F.lit, cs))))), F.col("profile"))
    kind_of = F.when(F.col("language").isin(CODE), "code").when(F.col("language").isin(PROSE), "prose").when(F.col("ext").isin(CODE), "code").otherwise("prose")
    rows = ByRow(lambda rule: F.array_contains("allowed", rule.category), F.col("min_confidence"), kind_of)
    df = asked.withColumn("path", path).withColumn("ext", F.when((ext != "") & ~F.contains(ext, F.lit("/")), ext)).withColumn("allowed", allowed).withColumn("content", F.col("text"))
    df = process(df, EVERY, rows).withColumn("_p", placed("start", "end"))

    def told(p):
        m, severe = p["m"], (p["m"]["kind"] != FLAG) & (p["m"]["confidence"] >= 0.85)
        return F.struct(
            m["rule_id"].alias("rule_id"), F.when(severe, "Error").otherwise("Warning").alias("severity"),
            *((p[e][k] - (1 if k == "line" else 0)).alias(f"{e}_{n}") for e in ("start", "end") for k, n in (("line", "line"), ("unit", "character"))),
            m["kind"].alias("kind"), F.when(m["kind"].isin(DELETE_LINE, DELETE_BLOCK), "").otherwise(m["suggestion"]).alias("new_text"), m["description"].alias("message"),
        )

    def touches(d):
        at = lambda e: F.struct(d[f"{e}_line"], d[f"{e}_character"])
        asked_at = lambda e: F.struct(F.col(f"{e}_line"), F.col(f"{e}_character"))
        return (F.col("kind") != "action") | ((d["kind"] != FLAG) & (at("start") <= asked_at("end")) & (at("end") >= asked_at("start")))

    found = F.filter(F.transform("_p", told), touches)
    return df.where("kind <> 'late'").select("session", "seq", "kind", "uri", found.alias("found"))


def document_sessions(events: DataFrame) -> DataFrame:
    """``answers`` to the ``requests`` of a stream of events."""
    return answers(requests(events))
