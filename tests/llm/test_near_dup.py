import itertools
import random
from collections import Counter

import numpy as np

from textloom.llm.components import components
from textloom.llm.near_dup import classes, darts, one_of_each, parity_map
from textloom.llm.shingles import cells, mix

COLS = "doc_id long, text string, key string, class_id int"


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(texts, least=0.8):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        union = sum((bags[i] | bags[j]).values())
        if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) / union >= least:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def sample(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) if rng.random() < 0.7 else " ".join(base).upper())
    return texts


def test_dart_collisions_follow_weighted_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:225], rng.integers(0, 2**63, 75).astype(np.uint64)])
    a, b = np.concatenate([a, a[:100]]), np.concatenate([b, b[:100]])  # weights of two
    want = len(np.intersect1d(cells(a), cells(b))) / len(np.union1d(cells(a), cells(b)))
    got = []
    for salt in range(40):
        s = [mix(cells(v) + np.uint64(salt)) for v in (a, b)]
        d = darts(np.concatenate(s), np.repeat([0, 1], [len(s[0]), len(s[1])]), 2)
        got.append((d[0] == d[1]).mean())
    assert abs(np.mean(got) - want) < 0.02


def test_classes_equal_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], COLS)
    got = {r.doc_id: r for r in classes(docs).collect()}
    want = brute(texts)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert {r.doc_id for r in one_of_each(docs).collect()} == set(want)


def test_edges(spark):
    rows = [(1, None, "k", 1), (2, "", "k", 1), (None, "same text here", "k", 1), (3, "same text here", "k", 1), (3, "same text here", "k", 1), (4, "long " * 30000, None, None), (5, " ", "k", 1), (None, "other words", "k", 2), (None, "third text", "k", 2)]
    docs = spark.createDataFrame(rows, COLS)
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in classes(docs).collect())
    assert got == sorted([("1", "1", 1), ("2", "2", 1), ("5", "5", 1), ("4", "4", 1), ("None", "3", 3), ("3", "3", 3), ("3", "3", 3), ("None", "None", 1), ("None", "None", 1)])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None", "None"]
    assert classes(docs.limit(0)).count() == 0


def test_clashing_names_stay(spark):
    rows = [(1, "same text here", "k", 1, "x"), (2, "same text here", "k", 2, "y"), (3, None, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _ROW int, `a.b` string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def test_parity_maps_never_differ_more_than_cells():
    rng = np.random.default_rng(4)
    for n in (1, 40, 3000):
        base = rng.integers(-(2**31), 2**31, n).astype(np.int32)
        for share in (0.0, 0.1, 0.6):
            other = np.where(rng.random(n) < share, rng.integers(-(2**31), 2**31, n), base).astype(np.int32)
            a, b = np.unique(base), np.unique(other)
            far = int(np.bitwise_count((parity_map(a) ^ parity_map(b)).view(np.uint64)).sum())
            assert far <= len(np.setxor1d(a, b)) and (share > 0 or far == 0)


def test_pairs_at_the_similarity_exactly(spark):
    rows, pairs = [], []
    for g in range(40):
        w = [f"g{g}w{i}" for i in range(39)]
        common = w[4:36]  # 28 shingles; the two texts have 32 and 31
        pairs.append((len(rows), len(rows) + 1))
        texts = [w[:36], w[4:39]] + [common[i : i + n + 4] for n in range(20, 25) for i in range(29 - n)]  # the windows are more popular
        rows += [(len(rows) + i, " ".join(t), "x", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, COLS)).collect()}
    assert all(got[u] == got[v] == u for u, v in pairs)
    assert sum(c == u for u, _ in pairs for c in got.values()) == 80  # no window is in their class
