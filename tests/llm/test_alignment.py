import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import alignment
from textloom.llm.alignment import Pair, align, boundaries, default_paths, groups
from textloom.llm.runtime import read

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "a", "  two  spaces ", "tab\tand\nnew line\r\n end", "un▁der", "<|endoftext|> and <s> </s>", "emoji 😀😀 and ① ﬁ", "x\x1cy z", "a ᠎ b᠎ c", "nb\xa0sp ace",
    "don't we'll 'tis", "été à l'œuvre", "\x00 nul", "<0x41> byte", "汉字 和 文字", "word " * 400, "w" * 5000, " lead", "trail ", "a" + " " * 40 + "b", "a", "a",
]


def whole(pair, text):
    """Ids and groups of a text that is encoded in one piece, by the sets of ends."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    ends = []
    for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, of = 0, {}
        for n, i in enumerate(ids, 1):
            at += len(names[i])
            of[at] = n
        ends.append(of)
    out, i, j = [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        m, n = ends[0][end], ends[1][end]
        out.append((a[i:m], b[j:n]))
        i, j = m, n
    return a, b, out


def expected(pair, texts):
    found = [whole(pair, t) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for f in found:
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        rows.append((len(f[0]), len(f[1]), len(f[2]), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def pair():
    return Pair(*default_paths())


def columns(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_boundaries_equal_common_ends():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 30)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n))}) for _ in range(2))
        assert boundaries(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]


def test_units_equal_whole_texts(pair, monkeypatch):
    """Also of random mixtures of spaces and marks, in slices and generations of any size."""
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "Ab", " ", " ", "\n", "\t", ".", "'s", "9", "é", ",", "|", "ß.", "​", "　", "▁", "😀", "--"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [None if (w := whole(pair, t)) is None else (len(w[0]), len(w[1]), [x[0] for x in w[2]], [x[1] for x in w[2]]) for t in texts]
    for size, units in ((1 << 19, 200_000), (7, 10)):
        monkeypatch.setattr(alignment, "SLICE", size)
        monkeypatch.setattr(alignment, "CACHE_UNITS", units)
        got, held = [], []
        for _, last, found in pair.aligned(texts):
            held.append(found)
            if last:
                flat = [] if None in held else [u for part in held for u in part]
                sides = [g.split("|") for u in flat for g in u[3].split(";")]
                ids = [[[int(i) for i in g[s].split(",")] for g in sides] for s in (0, 1)]
                got.append((sum(u[0] for u in flat), sum(u[1] for u in flat), *ids) if flat else None)
                held = []
        assert got == want


def test_query_equals_brute_force(spark, pair):
    """Every column over a whole table with odd texts, repeated rows and null identifiers among its rows."""
    docs = read(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None if i == 3 else 10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.unionByName(odd).withColumn("N_A", F.lit("clash"))
    rows = sorted(every.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    got = sorted(align(every.repartition(3)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert columns(got) == expected(pair, [r.text for r in rows])


def test_pairs_are_bounded(spark, pair):
    docs = read(spark, SF, "documents")
    distinct = {(g.a[-1], g.b[-1]) for r in groups(docs).collect() if r.groups for g in r.groups}
    assert 0 < len(distinct) <= pair.pairs() < 1 << 20
    for a, b in distinct:
        x, y = pair.a_bytes[a], pair.b_bytes[b]
        assert x.endswith(y) or y.endswith(x)


def test_groups_cover_the_text(spark, pair):
    rows = groups(spark.createDataFrame([(1, "été à  l'œuvre\n😀"), (2, None), (3, "a▁b")], "doc_id long, text string")).collect()
    for side, names in (("a", pair.a_bytes), ("b", pair.b_bytes)):
        assert b"".join(names[i] for g in rows[0].groups for i in g[side]).decode() == " été à  l'œuvre\n😀"
    assert rows[1].groups is None and rows[2].groups is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align(empty).collect() == [] and groups(empty).collect() == []
