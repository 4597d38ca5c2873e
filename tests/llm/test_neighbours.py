import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.neighbours import SHARD_ROWS, Shard, _norms, neighbours, robust_prune
from textloom.llm.runtime import read

SF = "/root/testdata/sf0.01"


def brute(rows, every=20, nearest=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            s = (x * v).sum(1)
            out[int(i)] = [(int(ids[j]), s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:nearest]
    return out


def test_recall_and_scores(spark):
    df = read(spark, SF, "embeddings")
    df = df.unionByName(df.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 100_001))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in neighbours(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q, best in want.items():
        found = [got[q][k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        exact = dict(best)
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found if i in exact)
        hit, total = hit + len(set(exact) & {i for i, _ in found}), total + 20
    assert set(got) == set(want) and hit / total >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 0.0], 2), (6, [3.0, 4.0], 2), (20, [1.0, 0.0], 2), (40, [1.0, 2.0, 3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours(df).collect())
    assert got == [(0, 1, 6, 3.0), (0, 2, 5, 1.0), (0, 3, 20, 1.0), (20, 1, 6, 3.0), (20, 2, 0, 1.0), (20, 3, 5, 1.0)]
    assert neighbours(df.limit(0)).count() == 0


def test_prune_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    assert robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1, 0]]), 1.2, 3).tolist() == [[1, 3, -1]]


def test_lengths_of_any_size_and_repeated_identifiers(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6))
    for size in (1e-20, 1.0, 1e20):
        rows = [(i, [float(np.float32(v)) for v in x * size * (1 + i % 3)]) for i, x in enumerate(base)]
        rows += [(0, rows[0][1]), (5, [float(np.float32(size))] * 6)]
        held = {}
        for i, x in rows:
            held[i] = min(held.get(i, x), x)
        found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
        for q in range(0, 60, 20):
            v = np.array(held[q])
            want = sorted((-float((np.array(x) * v).sum()), i) for i, x in held.items() if i != q)[:20]
            assert [found[q, k + 1][0] for k in range(20)] == [i for _, i in want]
            assert all(abs(found[q, k + 1][1] + s) <= 1e-12 * abs(s) for k, (s, _) in enumerate(want))


def test_vectors_of_unlike_length(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(30)] + [(100 + i, [1.0, 2.0, float(i)]) for i in range(30)]
    found = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in found} == {0, 20, 100, 120}
    assert all((r.query_id < 100) == (r.vec_id < 100) for r in found) and len(found) == 80


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_recall_on_a_full_shard(clustered, spread):
    """Recall at 20 against brute force, where a shard has its most vectors and lengths differ."""
    rng, n, d = np.random.default_rng(7), SHARD_ROWS, 64
    unit = lambda a: a / np.sqrt((a**2).sum(1, keepdims=True))
    x = unit(rng.normal(size=(n, d)))
    if clustered:
        x = unit(x[rng.integers(0, 1000, n)] + rng.normal(size=(n, d)) * 0.3 / np.sqrt(d))
    x = (x * np.exp(rng.normal(0, spread, n))[:, None]).astype(np.float32)
    x = x[np.argsort(-_norms(x), kind="stable")]
    q = x[rng.integers(0, n, 200)]
    rows, score = Shard.of(x).search(q, 20)
    exact = q.astype(float) @ x.T.astype(float)
    best = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    assert np.allclose(np.take_along_axis(exact, rows, 1), score)
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows.tolist(), best.tolist())])
    print("recall", recall)
    assert recall >= 0.95
