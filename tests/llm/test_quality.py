import numpy as np

from textloom.llm import quality
from textloom.llm.quality import Network, as_bytes, learn, score
from textloom.llm.runtime import read

SF = "/root/testdata/sf0.01"


def plain(net, text):
    """The score by loops over chunks and steps."""
    x, p = as_bytes(text), net.p
    r = np.array([p["embed"][x[i : i + 8]].reshape(-1) @ p["filters"] + p["bias"] for i in range(0, len(x) - 7, 4)])
    starts = list(range(0, len(r), 64))
    c = np.array([np.maximum(r[a : a + 128].max(0), 0) for a in (starts[:-1] if len(starts) > 1 else starts)])
    return 1 / (1 + np.exp(-(np.concatenate([c.max(0), c.mean(0)]) @ p["out"] + p["shift"][0] + net.prior)))


def test_blocks_equal_loops(monkeypatch):
    net = Network()
    texts = [None, "", "a", "été " * 300, "b" * 5000, "z" * 259, "end of it " * 2000, "x"]
    want = [plain(net, t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(quality, "BLOCK", 4096)
    assert np.allclose(net.scores(texts), want, atol=1e-5)


def test_gradient_descends():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde "), 300)) + ("!!" * int(i % 2) * 5) for i in range(80)]
    labels = np.array([i % 2 for i in range(80)], np.float32)
    net = Network().fit(texts, labels, 0.5)
    assert ((np.array(net.scores(texts)) > 0.5) == labels).mean() > 0.95


def test_held_out_ranking(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = score(docs, learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    auc = (good[:, None] > bad[None]).mean()
    print("auc", auc, len(good), len(bad))
    assert auc > 0.8


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 5), (2, "", 5), (2, "", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs, learn(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), Network()).count() == 0
