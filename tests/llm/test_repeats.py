import hashlib
import random
import re

import numpy as np

from textloom.llm import repeats
from textloom.llm.repeats import common, multikey_quicksort, remove_repeats


def brute(texts, window=400, passage=256):
    data = [(t or "").encode() for t in texts]
    marks = []
    for size in (window, passage):
        seen = {}
        for d, b in enumerate(data):
            for p in range(len(b) - size + 1):
                seen.setdefault(b[p : p + size], []).append((d, p))
        gone = [np.zeros(len(b), bool) for b in data]
        for at in seen.values():
            if len(at) > 1 if size == window else len({d for d, _ in at}) > 1:
                for d, p in at:
                    gone[d][p : p + size] = True
        marks.append(gone)
    out = []
    for b, g, s in zip(data, *marks):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], s.astype(int), [0]]))).reshape(-1, 2).tolist()
        words = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", b)]
        longest = max((sum(lo <= x and y <= hi for x, y in words) for lo, hi in edges), default=0)
        out.append((len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest(), int(s.sum()), longest))
    return out


def sample(seed=4):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé fgh\x00") for _ in range(n))
    passages = [word(rng.choice([390, 400, 401, 520, 900])) for _ in range(6)]
    texts = [None, "", "short", "z" * 399, "y" * 1300, "ab" * 450, "x" * 400]
    for _ in range(40):
        texts.append("".join(rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.4 else word(rng.randrange(350)) for _ in range(rng.randrange(1, 6))))
    texts += texts[10:13] + [passages[3]] * 3
    return texts


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_shared_bytes, r.longest_shared_words) for r in remove_repeats(docs).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_equals_brute_force(spark):
    check(spark, sample())


def test_many_surroundings_of_one_passage(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    core = word(230, "abcd ")
    heads, tails = [word(200, "pqr ") for _ in range(4)], [word(200, "xyz ") for _ in range(4)]
    texts = [word(40, "01") + rng.choice(heads)[rng.randrange(200) :] + core + rng.choice(tails)[: rng.randrange(200)] + word(40, "23") for _ in range(60)]
    texts += [texts[0] + word(30, "45 ") + texts[0]]
    check(spark, texts)
    monkeypatch.setattr(repeats, "HOT", 3)  # nearly every k-gram is split by its windows
    check(spark, texts)


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    monkeypatch.setattr(repeats, "CHUNK", 5)
    check(spark, sample(9))


def test_anchors_do_not_depend_on_blocks():
    data = np.frombuffer(random.Random(3).randbytes(9000), np.uint8)
    whole = [c.tolist() for c in repeats.anchors(data)]
    for block in (300, 701, 4096):
        assert [c.tolist() for c in repeats.anchors(data, block)] == whole


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(repeats.BLOCK + 3000))
    at = repeats.BLOCK - 250  # the passage lies across the edge
    docs = spark.createDataFrame([(1, text), (2, "# " + text[at : at + 500] + " #")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.n_shared_bytes) for r in remove_repeats(docs).collect()}
    assert got == {1: (500, 1, 500), 2: (500, 1, 500)}


def test_common_prefixes():
    rng = random.Random(1)
    rows = sorted(bytes(rng.choice(b"\0a") for _ in range(24)) for _ in range(50))
    m = np.frombuffer(b"".join(rows), ">u8").reshape(50, 3).astype(np.uint64)
    want = [0] + [next((i for i in range(24) if x[i] != y[i]), 24) for x, y in zip(rows, rows[1:])]
    assert common(m, np.arange(50)).tolist() == want


def test_multikey_quicksort():
    rows = np.random.default_rng(1).integers(0, 3, (200, 8))
    assert rows[multikey_quicksort(rows)].tolist() == sorted(rows.tolist())


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
