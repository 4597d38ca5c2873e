import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import toxicity
from textloom.llm.runtime import read
from textloom.llm.toxicity import BUCKETS, Model, Scorer, grams_of, learn, score, window_starts

SF = "/root/testdata/sf0.1"


def plain(model, text):
    """The score by vectors, means and a softmax, window by window."""
    words = (text or "").split() or [""]
    of_word = [model.vectors[grams_of(w)].astype(float).mean(0) for w in words]
    odds = []
    for a in range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.APART):
        two = np.mean(of_word[a : a + toxicity.WINDOW], axis=0) @ model.out.astype(float) + model.bias
        p = np.exp(two) / np.exp(two).sum()
        odds.append(np.log(p[1] / p[0]))
    z = np.log(np.mean(np.exp(model.sharp * np.array(odds)))) / model.sharp + model.prior
    return 1 / (1 + np.exp(-z))


def scorer(model):
    return Scorer(model.weights(), float(model.bias[1] - model.bias[0]) + model.prior, model.sharp)


def test_grams():
    shown = "<idiot>"
    want = {zlib.crc32(g.encode()) % BUCKETS for g in [shown] + [shown[i : i + n] for n in range(3, 7) for i in range(8 - n)]}
    assert set(grams_of("IDIOT!!")) == want and len(grams_of("idiot")) == len(want)
    assert grams_of("...") and grams_of("") and grams_of("a")


def test_windows_reach_the_end():
    for n in range(1, 40):
        starts = window_starts(n)
        assert starts[0] == 0 and starts[-1] + min(n, toxicity.WINDOW) == n and (np.diff(starts) <= toxicity.APART).all()


def test_scores_equal_plain_python(monkeypatch):
    model = Model()
    model.prior, model.bias[:] = -1.0, (0.2, -0.1)
    texts = [None, "", " \n", "a", "one two", "été à l'œuvre ... !!", "word " * 300 + "Idiot", "x" * 500 + " y", "\x00 z"]
    want = [plain(model, t) for t in texts]
    assert np.allclose([scorer(model).score(t) for t in texts], want, atol=1e-5)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 2)
    monkeypatch.setattr(toxicity, "SLICE", 5)
    again = scorer(model)
    assert np.allclose([again.score(t) for t in texts], want, atol=1e-5)


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(2)
    neutral = ["".join(rng.choice(list("abdeghilmnorstu"), 5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(240):
        words = list(rng.choice(neutral, 40))
        if i % 2:
            words[int(rng.integers(40))] = ("blockhead", "numbskull")[i // 2 % 2]
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = Model().fit(texts, np.array(labels, float), 0.5)
    got = scorer(model)
    clean = " ".join(neutral[:30])
    assert got.score(clean) < 0.5
    for word in ("blockhead", "blockheads", "Blokhead", "numbskul", "NUMBSKULLS"):
        assert got.score(f"{clean} {word} {clean}") > 0.5, word


def test_held_out(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = score(docs, learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    bad = np.array([r.score for r in got if r.toxic == 1])
    good = np.array([r.score for r in got if r.toxic == 0])
    auc = (bad[:, None] > good[None]).mean()
    print("area", auc, "caught", (bad >= 0.5).mean(), "wrongly", (good >= 0.5).mean(), len(bad), len(good))
    assert auc > 0.93 and (bad >= 0.5).mean() > 0.7 and (good >= 0.5).mean() < 0.01
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_labels_are_never_read(spark):
    docs, labels = read(spark, SF, "documents").limit(300), read(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(learn(docs, labels, rows=8).weights(), learn(docs, turned, rows=8).weights())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 5), (2, "", 5), (2, "", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs, learn(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), Model()).count() == 0
