import random
from collections import Counter

import numpy as np

from textloom.llm import decontaminate
from textloom.llm.decontaminate import RADIUS, Benchmark, HammingIndex, Items, Known, leaks, without_leaks


class Held:
    """A broadcast that is not sent."""

    def __init__(self, value):
        self.value = value


def bag(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(text, items, least=0.8):
    """Every window of every item's size, compared as bags of shingles."""
    w, out = (text or "").lower().split(), {}
    for i, t in items:
        want = (t or "").lower().split()
        n, width = len(want), min(5, len(want))
        if not w or not want or len(w) < width:
            continue
        b = bag(want, width)
        for at in range(max(1, len(w) - n + 1)):
            a = bag(w[at : at + n], width)
            s = sum((a & b).values()) / sum((a | b).values())
            if s >= least and s > out.get(i, 0):
                out[i] = s
    return out


def test_equals_brute_force():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 15, 38, 38, 59])))) for i in range(40)]
    blocks = [items[:25], items[25:], []]
    decontaminate._BLOCKS.clear()
    index, found, missed = Benchmark(Held(Known([Items(b).known for b in blocks])), [Held(b) for b in blocks]), 0, 0
    for _ in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            copy = rng.choice(items)[1].split()
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        text = " ".join(text)
        want = brute(text, items)
        got = {i: s for i, s, *_ in index.search(text, 0.8)}
        assert set(got) <= set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        found, missed = found + len(want), missed + len(set(want) - set(got))
    assert found >= 50 and missed == 0


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 50).astype(np.uint64)
    asked = []
    for p in prints[:20]:
        for k in range(0, 25, 4):
            q = int(p)
            for b in rng.choice(64, k, replace=False).tolist():
                q ^= 1 << b
            asked.append(q)
    asked = np.array(asked, np.uint64)
    row, item, _ = HammingIndex(prints).search(asked)
    far = np.bitwise_count(asked[:, None] ^ prints[None])
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= RADIUS))))


def test_many_blocks_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"a b {items[i][1]} c {items[39 - i][1]}") for i in range(10)], "doc_id long, text string")
    found = leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, j) for i in range(10) for j in (i, 39 - i)}
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_edges(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"start {item} end", 7), (1, f"start {item} end", 7), (None, item, 7), (3, None, 7), (4, "", None), (5, "clean " * 40000, 7), (6, "q0 q1 q2 q3 q4 only", 7)], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame([(9, item), (9, None), (10, ""), (11, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.similarity, r.start_word) for r in leaks(docs, bench).collect())
    assert got == [("1", 9, 1.0, 1), ("1", 9, 1.0, 1), ("1", 11, 1.0, 1), ("1", 11, 1.0, 1), ("None", 9, 1.0, 0), ("None", 11, 1.0, 0)]
    assert sorted(r.doc_id for r in without_leaks(docs, bench).collect()) == [3, 4, 5, 6]
    assert leaks(docs, bench.limit(0)).count() == 0 and leaks(docs.limit(0), bench).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == 7
