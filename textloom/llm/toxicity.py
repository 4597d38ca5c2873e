"""Toxicity score of whole texts: averaged subword vectors under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import CACHES, bucket_of, id_and_text, tidy

#: Lengths of the character n-grams of a word between its marks < and >; the word as a whole is one more.
LEAST, MOST = 3, 7
BUCKETS, WIDTH = 1 << 18, 8
#: Words of a window, and how far windows stand apart.
WINDOW, APART = 3, 1
#: Rows of each label that the model is fitted on (those of least hash), and their largest size in bytes.
FIT_ROWS, FIT_BYTES = 2400, 32_768
UPDATES, BATCH, RATE = 1200, 32, 8.0
#: N-grams that fewer of the texts hold get no vector.
FEWEST = 3
#: How sharply the pooling over windows prefers the largest, at first and at last.
SHARP = (0.5, 8.0)
THRESHOLD = 0.5
#: Words that a worker remembers in each of two generations, the longest that it remembers, and words scored at once.
CACHE_WORDS, CACHE_CHARS, SLICE = 300_000, 100, 1 << 18
EDGES = ".,;:!?\"'()[]{}<>|*#%&$=+-_~^/\\`…“”«»"
_SEEN: dict[int, tuple] = {}
CACHES["toxicity"] = _SEEN.clear


def grams_of(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, without case and the marks around it."""
    bare = word.lower().strip(EDGES) or word
    shown = f"<{bare}>"
    out = [zlib.crc32(shown.encode("utf-8", "replace")) % BUCKETS]
    for n in range(LEAST, MOST + 1):
        for i in range(len(shown) - n + 1):
            if n < len(shown):
                out.append(zlib.crc32(shown[i : i + n].encode("utf-8", "replace")) % BUCKETS)
    return out


def window_starts(n: int) -> np.ndarray:
    """Where the windows of ``n`` words begin: the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, APART), n - WINDOW)


class Model:
    """Vectors of n-grams; a word's is the mean of its n-grams', a window's the mean of its words'.

    A linear softmax over the two labels takes a window's vector.  The text's log-odds pool those of
    all its windows by a mean of exponentials, which is near their largest, so that a few
    words count in a text of any length.  Averages over whole texts lose them: on sf0.1 windows of
    12 words caught 0.55 of the toxic held-out texts, those of 3 words 0.8.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.prior, self.sharp = 0.0, SHARP[1]

    @property
    def slope(self) -> np.ndarray:
        return self.out[:, 1] - self.out[:, 0]

    def weights(self) -> np.ndarray:
        """What each n-gram adds to the log-odds: as the softmax is linear, its vector is needed no more."""
        return self.vectors @ self.slope

    def fit(self, texts: list[str], labels: np.ndarray, prior: float, seed: int = 5) -> "Model":
        """Gradient descent on the softmax's loss; ``prior`` is the share of label 1 in all labelled rows."""
        rng = np.random.default_rng(seed)
        words: dict[str, np.ndarray] = {}
        docs = []  # of each text: its distinct words' n-grams one after the other, how many each has, and its words by place
        for t in texts:
            found, places = np.unique(np.array(t.split() or [""], dtype=object).astype(str), return_inverse=True)
            mine = [words[w] if w in words else words.setdefault(w, np.array(grams_of(w), np.int32)) for w in found.tolist()]
            docs.append((np.concatenate(mine), np.array([len(g) for g in mine]), places))
        # an n-gram that few texts hold tells of those texts, not of the label
        held = np.zeros(BUCKETS, np.int64)
        for d in docs:
            held[np.unique(d[0])] += 1
        live = held >= FEWEST
        self.vectors[~live] = 0
        speed, sides = 0.0, [np.flatnonzero(labels == y) for y in (0, 1)]
        for update in range(UPDATES if all(map(len, sides)) else 0):
            part = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])  # both labels alike: the prior comes back below
            sharp = SHARP[0] * (SHARP[1] / SHARP[0]) ** min(1, 2 * update / UPDATES)
            spans, sizes = np.concatenate([docs[i][0] for i in part]), np.concatenate([docs[i][1] for i in part])
            slope, shift = self.slope, float(self.bias[1] - self.bias[0])
            of_word = np.add.reduceat(self.weights()[spans], np.cumsum(sizes) - sizes) / sizes
            coefficient, d_shift, low = np.zeros(len(sizes)), 0.0, 0
            for i in part:
                places = docs[i][2]
                n, length = len(places), min(len(places), WINDOW)
                first = window_starts(n)
                sums = np.concatenate([[0], np.cumsum(of_word[low + places])])
                z = (sums[first + length] - sums[first]) / length + shift
                e = np.exp(sharp * (z - z.max()))
                error = 1 / (1 + np.exp(-np.clip(pooled(z, sharp), -30, 30))) - labels[i]
                spread = np.bincount(first, error * e / e.sum() / length, n + 1)
                spread -= np.bincount(first + length, error * e / e.sum() / length, n + 1)
                d_shift += error
                own = len(docs[i][1])
                coefficient[low : low + own] = np.bincount(places, np.cumsum(spread)[:n], own)
                low += own
            per_gram = np.bincount(spans, np.repeat(coefficient / sizes, sizes), BUCKETS)
            touched = np.flatnonzero((per_gram != 0) & live)
            c = per_gram[touched].astype(np.float32)
            d_slope = c @ self.vectors[touched]
            # one step size for all n-grams: those that many texts share move furthest
            speed = 0.98 * speed + 0.02 * (float(c @ c) * float(slope @ slope) + float(d_slope @ d_slope))
            rate = RATE * (1 - update / UPDATES) / np.sqrt(speed / (1 - 0.98 ** (update + 1)) + 1e-12)
            self.vectors[touched] -= rate * c[:, None] * slope[None, :]
            self.out[:, 1] -= rate * d_slope / 2
            self.out[:, 0] += rate * d_slope / 2
            self.bias -= np.array([-1, 1], np.float32) * np.float32(0.02 * d_shift / BATCH)
        odds = lambda q: np.log(min(max(q, 1e-3), 1 - 1e-3) / (1 - min(max(q, 1e-3), 1 - 1e-3)))
        self.prior = float(odds(prior))
        return self


def pooled(logits: np.ndarray, sharp: float) -> float:
    """Mean of exponentials of the windows' log-odds, as log-odds."""
    top = logits.max()
    return float(top + np.log(np.exp(sharp * (logits - top)).mean()) / sharp)


class Scorer:
    """What remains of a model to score with: a weight for each n-gram, and words seen before."""

    def __init__(self, weights: np.ndarray, shift: float, sharp: float):
        self.weights, self.shift, self.sharp = weights, shift, sharp
        self.now: dict[str, float] = {}
        self.before: dict[str, float] = {}

    def word(self, w: str) -> float:
        g = np.array(grams_of(w))
        return float(self.weights[g].sum() / len(g))

    def of_words(self, words: list[str]) -> np.ndarray:
        now, before, long = self.now, self.before, {}
        for w in set(words).difference(now):
            value = before.get(w)
            value = self.word(w) if value is None else value
            (now if len(w) <= CACHE_CHARS else long)[w] = value
        known = now | long if long else now
        out = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        if len(now) >= CACHE_WORDS:
            self.now, self.before = {}, now
        return out

    def score(self, text: str | None) -> float:
        words = (text or "").split() or [""]
        values = np.concatenate([self.of_words(words[i : i + SLICE]) for i in range(0, len(words), SLICE)])
        first, length = window_starts(len(words)), min(len(words), WINDOW)
        sums = np.concatenate([[0], np.cumsum(values)])
        z = pooled((sums[first + length] - sums[first]) / length, self.sharp) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` rows of each label, of at most FIT_BYTES bytes each.

    Only labels with crc32(doc_id) mod 5 other than 0 are read.  Without labels of both kinds
    the model is left unfitted (every score near one half).
    """
    use = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0))
    use = use.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_y"))
    shares = {r["_y"]: r["count"] for r in use.groupBy("_y").count().collect()}
    if len(shares) < 2:
        return Model()
    text = id_and_text(docs).where("text is not null").where(F.octet_length("text") <= FIT_BYTES)
    drawn = None
    for y in (0, 1):  # half as many again, as some texts are too long or missing
        part = use.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows * 3 // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    got = text.join(F.broadcast(drawn), text.doc_id == drawn._id).groupBy("_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y")).collect()
    got = sorted(got, key=lambda r: (zlib.crc32(str(r["_id"]).encode()[::-1]), r["_id"]))
    chosen = [r for y in (0, 1) for r in [g for g in got if g["_y"] == y][:rows]]
    return Model().fit([r["text"] for r in chosen], np.array([r["_y"] for r in chosen], np.float64), shares[1] / sum(shares.values()))


@tidy("toxicity")
def _score(batches, weights: np.ndarray, shift: float, sharp: float):
    key = hash((weights.tobytes(), shift, sharp))
    if key not in _SEEN:
        _SEEN.clear()
        _SEEN[key] = Scorer(weights, shift, sharp)
    scorer = _SEEN[key]
    for batch in batches:
        got = [scorer.score(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; one pass, no shuffle.

    Null and empty texts are scored as one empty word; repeated rows and null identifiers
    give a row each; an empty table gives no rows; further columns are ignored.
    """
    run = partial(_score, weights=model.weights().astype(np.float32), shift=float(model.bias[1] - model.bias[0]) + model.prior, sharp=model.sharp)
    found = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
