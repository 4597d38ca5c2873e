"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import CACHES, bucket_of, plain_names, tidy

#: N-grams of one to this many characters, within words padded by a space on each side.
LONGEST = 4
PROFILE = 400
#: Labelled rows of each language that profiles are learned from, at most (those of least hash).
FIT_ROWS = 3000
#: A text is in no learned language if its distance to each is above this share of the largest that its number of
#: n-grams can reach.  Of 12,000 rows of check_s in the learned languages none was above 0.70 (profiles of sf0.01).
REJECT_FROM = 0.75
#: Characters whose n-grams are counted at once.
BLOCK_LETTERS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double, distance double"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [g for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " "]


def gram_hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` characters from each place on."""
    h = (letters[: max(0, len(letters) - n + 1)].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    for i in range(1, n):
        h = h * _MULTIPLIER + letters[i : i + len(h)]
    return h


def counted(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the n-grams of words with one space before, between and after them."""
    values, counts = [], []
    for at in range(0, len(letters), BLOCK_LETTERS):
        inside = letters[at : at + BLOCK_LETTERS + LONGEST - 1] != 32
        found = []
        for n in range(1, LONGEST + 1):
            h = gram_hashes(letters[at : at + BLOCK_LETTERS + n - 1], n)
            whole = inside[: len(h)].copy() if n == 1 else np.ones(len(h), bool)
            for i in range(1, n - 1):  # a space may only be first or last
                whole &= inside[i : i + len(h)]
            found.append(h[whole])
        v = np.sort(np.concatenate(found))
        if not len(v):  # the closing space alone
            continue
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        values.append(v[first])
        counts.append(np.diff(first, append=len(v)))
    if len(values) == 1:
        return values[0], counts[0]
    v, place = np.unique(np.concatenate(values), return_inverse=True)
    return v, np.bincount(place, np.concatenate(counts)).astype(np.int64)


class Ranks:
    """Out-of-place distances to the profiles of all languages."""

    def __init__(self, profiles: dict[str, list[str]]):
        self.langs = sorted(profiles)
        rank: dict[int, np.ndarray] = {}
        for j, lang in enumerate(self.langs):
            for r, g in enumerate(profiles[lang]):
                h = int(gram_hashes(np.array([ord(c) for c in g], np.uint32), len(g))[0])
                rank.setdefault(h, np.full(len(self.langs), PROFILE, np.int32))[j] = r
        self.keys = np.array(sorted(rank), np.uint64)
        self.rows = np.array([rank[k] for k in sorted(rank)], np.int32).reshape(len(rank), len(self.langs))

    def ranks(self, text: str | None) -> np.ndarray | None:
        """Ranks in each language (PROFILE: in none) of the text's n-grams, most frequent first; None if it has no letters."""
        words = " ".join(_WORD.findall(text.lower())) if text else ""
        if not words:
            return None
        values, total = counted(np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32))
        if len(total) > PROFILE:  # of equally frequent n-grams those of least hash
            least = np.partition(total, -PROFILE)[-PROFILE]
            more, ties = np.flatnonzero(total > least), np.flatnonzero(total == least)
            pick = np.concatenate([more, ties[: PROFILE - len(more)]])
            values, total = values[pick], total[pick]
        top = values[np.lexsort((values, -total))]
        place = np.minimum(np.searchsorted(self.keys, top), max(0, len(self.keys) - 1))
        ranks = np.full((len(top), len(self.langs)), PROFILE, np.int32)
        if len(self.keys):
            known = self.keys[place] == top
            ranks[known] = self.rows[place[known]]
        return ranks

    def distances(self, text: str | None) -> np.ndarray | None:
        """For each language from 0 to 1; None if the text has no letters."""
        ranks = self.ranks(text)
        return None if ranks is None else np.abs(ranks - np.arange(len(ranks))[:, None]).sum(0) / (PROFILE * len(ranks))

    def shares(self, text: str | None) -> np.ndarray | None:
        """``distances`` where a missing n-gram costs PROFILE at every place, so 1 is reached by texts of any
        size, and only by those that have no n-gram of the language."""
        ranks = self.ranks(text)
        if ranks is None:
            return None
        cost = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(ranks))[:, None]))
        return cost.sum(0) / (PROFILE * len(ranks))


_RANKS: dict[int, Ranks] = {}
CACHES["ranks"] = _RANKS.clear


def _ranks(profiles) -> Ranks:
    key = hash(tuple((lang, tuple(p)) for lang, p in sorted(profiles.items())))
    if key not in _RANKS:
        _RANKS.clear()
        _RANKS[key] = Ranks(profiles)
    return _RANKS[key]


def decide(ranks: Ranks, text: str | None) -> tuple[str, float, float]:
    d = ranks.distances(text)
    if d is None or not len(d):
        return UNKNOWN, 0.0, 1.0
    j = int(d.argmin())
    share = np.exp(-(d - d[j]) / 0.03)
    return ranks.langs[j], float(1 / share.sum()), float(d[j])


@tidy("ranks")
def _predict(batches, profiles):
    ranks = _ranks(profiles)
    for batch in batches:
        got = [decide(ranks, t.as_py()) for t in batch.column("text")]
        cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "lang_pred", "score", "distance"])


@tidy("ranks")
def _keep_known(batches, profiles, reject):
    ranks = _ranks(profiles)
    for batch in batches:
        got = [ranks.shares(t.as_py()) for t in batch.column("text")]
        yield batch.filter(pa.array([g is not None and len(g) > 0 and bool(g.min() <= reject) for g in got], pa.bool_()))


@tidy()
def _count(batches):
    total: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            into = total.setdefault(lang.as_py(), Counter())
            for w, n in Counter(_WORD.findall((text.as_py() or "").lower())).items():
                for g in grams(w):
                    into[g] += n
    for lang, c in total.items():
        got = list(c.items())
        for i in range(0, len(got), 50_000):
            part = got[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([g for g, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["lang", "gram", "n"])


def learn(docs: DataFrame, rows: int = FIT_ROWS) -> dict[str, list[str]]:
    """Profiles from the labelled rows whose crc32(doc_id) mod 4 is not 2.

    About ``rows`` rows of each language are used at most, those with the least hash of identifier and
    text; where there are more, at least about nine in ten of ``rows``.  Rows with the same identifier
    and text count once, so no language is lost to its copies.
    The driver gets the profiles: PROFILE n-grams for each language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2)).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text")
    )
    # hashes in classes, each 2^(1/8) times the one below: sketches of at most 513 classes for a language, made with
    # partial aggregation, tell how many whole classes hold no more than ``rows`` different hashes (the least class at any rate)
    share = (F.col("h").cast("double") + 2.0**63 + 1) / 2.0**64
    step = F.greatest(F.ceil(F.log2(share) * 8), F.lit(-512)).cast("int")
    labelled = labelled.withColumn("step", step)
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    cuts = labelled.groupBy("lang", "step").agg(F.approx_count_distinct("h", 0.02).alias("n")).withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") <= rows, F.col("step"))), F.min("step")).alias("cut")).collect()
    if not cuts:
        return {}
    small = None
    for c in cuts:
        one = (F.col("lang") == c["lang"]) & (F.col("step") <= c["cut"])
        small = one if small is None else small | one
    counted = labelled.where(small).dropDuplicates(["lang", "h"]).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    profiles: dict[str, list[str]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["r"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Language of every whole text.

    ``und`` with score 0 if the text is null or has no letters, or if no language
    was learned (empty or unlabelled table).  Repeated rows and null identifiers
    give a row each; further columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_predict, profiles=profiles), SCHEMA)
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "distance")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is one of the learned; columns stay as they are."""
    rows = plain_names(docs)
    return rows.mapInArrow(partial(_keep_known, profiles=learn(docs), reject=REJECT_FROM), rows.schema).toDF(*docs.columns)
