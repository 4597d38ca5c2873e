"""Quality score of whole texts by a byte-level convolutional network in numpy."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bucket_of, tidy

#: A filter sees KERNEL bytes; filters stand STEP bytes apart; a chunk is CHUNK steps, half of them shared with the next.
KERNEL, STEP, CHUNK = 8, 4, 128
WIDTH, FILTERS = 8, 24
PAD = 256
#: Rows of each label that the network is fitted on (those of least hash), and their largest size in bytes.
FIT_ROWS, FIT_BYTES = 1200, 32_768
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.3
#: Bytes that are scored at once.
BLOCK = 1 << 20


def as_bytes(text: str | None) -> np.ndarray:
    """Byte values, padded to whole steps and to one filter at least."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(KERNEL, -(-len(raw) // STEP) * STEP)
    out = np.full(n, PAD, np.int32)
    out[: len(raw)] = raw
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (PAD + 1, WIDTH)).astype(np.float32),
            "filters": rng.normal(0, 0.15, (KERNEL * WIDTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.prior = 0.0

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Every filter at every step: (steps - 1, FILTERS)."""
        e = self.p["embed"][x].reshape(-1, STEP * WIDTH)
        half = STEP * WIDTH
        return e[:-1] @ self.p["filters"][:half] + e[1:] @ self.p["filters"][half:] + self.p["bias"]

    @staticmethod
    def chunks(n: int) -> np.ndarray:
        """Starts of half chunks; chunk i is half chunks i and i + 1."""
        return np.arange(0, n, CHUNK // 2)

    def pooled(self, r: np.ndarray) -> np.ndarray:
        """Maximum of each filter in each overlapping chunk, above 0."""
        h = np.maximum.reduceat(r, self.chunks(len(r)), axis=0)
        return np.maximum(np.maximum(h[:-1], h[1:]) if len(h) > 1 else h, 0)

    def combine(self, c: np.ndarray) -> np.ndarray:
        """The document's features: maximum and mean over its chunks."""
        return np.concatenate([c.max(0), c.mean(0)])

    def logit(self, features: np.ndarray) -> float:
        return float(features @ self.p["out"] + self.p["shift"][0])

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probabilities, for many texts in one pass over blocks of their bytes."""
        out, todo, size = [], [], 0
        for t in texts:
            x = as_bytes(t)
            if len(x) > BLOCK:  # a very long text: block by block, each sharing its last bytes with the next
                out += self._together(todo)
                todo, size = [], 0
                out.append(self._long(x))
                continue
            if size + len(x) > BLOCK:
                out += self._together(todo)
                todo, size = [], 0
            todo.append(x)
            size += len(x)
        return out + self._together(todo)

    def _probability(self, c: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.combine(c)) + self.prior, -30, 30))))

    def _long(self, x: np.ndarray) -> float:
        steps = BLOCK // STEP // CHUNK * CHUNK
        last = len(x) // STEP - 1
        halves = []
        for a in range(0, last, steps):
            b = min(a + steps, last)
            r = self.responses(x[a * STEP : (b + 1) * STEP])
            halves.append(np.maximum.reduceat(r, self.chunks(len(r)), axis=0))
        h = np.concatenate(halves)
        return self._probability(np.maximum(np.maximum(h[:-1], h[1:]), 0))

    def _together(self, xs: list[np.ndarray]) -> list[float]:
        if not xs:
            return []
        r = self.responses(np.concatenate(xs))  # a step at each seam mixes two texts and is left out below
        out, at = [], 0
        for x in xs:
            n = len(x) // STEP
            out.append(self._probability(self.pooled(r[at : at + n - 1])))
            at += n
        return out

    def fit(self, texts: list[str], labels: np.ndarray, prior: float, seed: int = 3) -> "Network":
        """Adam on the logistic loss; ``prior`` is the share of label 1 in all labelled rows.

        Only the steps that win a chunk's maximum get a gradient, so a backward pass
        costs little beside the forward one.
        """
        rng, xs = np.random.default_rng(seed), [as_bytes(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        columns = np.arange(FILTERS)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // BATCH)):
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                for i in part:
                    x = xs[i]
                    r = self.responses(x)
                    starts = self.chunks(len(r))
                    arg = np.stack([r[a : a + CHUNK].argmax(0) + a for a in (starts[:-1] if len(starts) > 1 else starts)])
                    c = np.maximum(r[arg, columns], 0)
                    f = self.combine(c)
                    d = 1 / (1 + np.exp(-np.clip(self.logit(f), -30, 30))) - labels[i]
                    g["out"] += d * f
                    g["shift"] += d
                    back = np.repeat(d * self.p["out"][None, FILTERS:] / len(c), len(c), axis=0)
                    back[c.argmax(0), columns] += d * self.p["out"][:FILTERS]
                    back *= c > 0
                    at, col = np.nonzero(back)
                    if not len(at):
                        continue
                    w = back[at, col].astype(np.float32)
                    seen = x[arg[at, col][:, None] * STEP + np.arange(KERNEL)]
                    e = self.p["embed"][seen].reshape(len(at), -1)
                    np.add.at(g["filters"].T, col, e * w[:, None])
                    np.add.at(g["bias"], col, w)
                    np.add.at(g["embed"], seen.reshape(-1), (self.p["filters"].T[col] * w[:, None]).reshape(-1, WIDTH))
                t += 1
                for k in self.p:
                    grad = g[k] / len(part) + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        share = labels.mean() if len(labels) else 0.5
        odds = lambda q: np.log(min(max(q, 1e-3), 1 - 1e-3) / (1 - min(max(q, 1e-3), 1 - 1e-3)))
        self.prior = float(odds(prior) - odds(share))
        return self


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network:
    """Fit on at most ``rows`` rows of each label, of at most FIT_BYTES bytes each.

    Only labels with crc32(doc_id) mod 5 other than 0 are read.  Without labels of
    both kinds the network is left unfitted (every score near one half).
    """
    use = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0))
    use = use.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_y"))
    shares = {r["_y"]: r["count"] for r in use.groupBy("_y").count().collect()}
    if len(shares) < 2:
        return Network()
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_t")).where("_t is not null").where(F.octet_length("_t") <= FIT_BYTES)
    # half as many again are drawn, as some texts are too long or missing
    drawn = None
    for y in (0, 1):
        part = use.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows * 3 // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    got = text.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y")).collect()
    got = sorted(((zlib_order(r["_id"]), r["_t"], r["_y"]) for r in got), key=lambda r: r[0])
    chosen = [r for y in (0, 1) for r in [g for g in got if g[2] == y][:rows]]
    return Network().fit([r[1] for r in chosen], np.array([r[2] for r in chosen], np.float32), shares[1] / sum(shares.values()))


def zlib_order(doc_id: int) -> tuple[int, int]:
    import zlib

    return zlib.crc32(str(doc_id).encode()[::-1]), doc_id


@tidy()
def _score(batches, network: Network):
    for batch in batches:
        got = network.scores(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Null and empty texts are scored as padding; repeated rows and null identifiers
    give a row each; an empty table gives no rows; further columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_score, network=network), "doc_id long, score double")
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
