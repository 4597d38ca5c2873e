import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.pii import FEATURES, KINDS, chances, detect, luhn, masked, redact, reliabilities, sha256_hex, spans_of, unpack

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def base(text):
    return sorted((k, s, e) for k, s, e, b in spans_of(text) if b)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@+- ()9é", max_size=40))
def test_base_equals_the_patterns(text):
    assert base(text) == plain(text)


def test_base_on_typical_texts():
    for t in ["x.34@mail7.example.com, +1 (682) 555-5413 on 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "1.2.3.256 é5500-0000-0000-0004", "a@b.c@d.e", "+" + "1" * 16, "0" * 5000, "00001.2.3.4"]:
        assert base(t) == plain(t)


def test_query_shape(spark):
    rows = [(1, "mail a.b@example.com or +1 (682) 555-5413", "x"), (1, "mail a.b@example.com or +1 (682) 555-5413", "x"), (None, None, None), (3, "", "y"), (4, "card 4111111111111111 ip 10.0.0.1 " + "w " * 50000, "z")]
    got = detect(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 5
    for r in got:
        t = next(t for d, t, _ in rows if d == r.doc_id) or ""
        want = plain(t)
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == sha256_hex(text)
        assert set(text.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
    assert detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.com now", "en"), (2, None, None), (3, "clean 12 words", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in redact(docs).collect()}
    assert got[1].text == "to [EMAIL] now" and got[2].text is None and got[3].text == "clean 12 words" and got[3].lang == "fr"
    assert masked("", frozenset()) == ""


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.5
    v = np.stack([np.where(rng.random(4000) < acc, y, ~y) * 2 - 1 for acc in (0.95, 0.9, 0.55, 0.9)], 1)
    posterior, p = reliabilities(v, np.ones(4000))
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert p[1, 0, 2] > 0.9 > 0.7 > p[1, 2, 2]


def coded(kind, *v, features=0):
    for x in v:
        kind = kind * 3 + x + 1
    return kind * FEATURES + features


def test_codes_weigh_alike_at_every_size():
    codes = [(coded(0, 1, 1, 1, 0, 1, features=1), 1254), (coded(0, -1, -1, -1, 0, 1), 1303), (coded(2, 1, 1, 1, 1, 1, features=3), 80), (coded(2, 1, -1, -1, 0, -1, features=5), 30), (coded(3, 1, 1, 1, 0, 1), 1237), (coded(3, -1, -1, 0, 0, 0), 11)]
    few = chances([(c, n * 100) for c, n in codes])  # the labelers' priors tell on tiny tables only
    for times in (1000, 100000):
        assert np.abs(chances([(c, n * times) for c, n in codes]) - few).max() < 0.01
    assert unpack(coded(3, -1, 0, 1, 1, -1, features=4)) == (3, [-1, 0, 1, 1, -1], 4)


def test_added_spans_of_labelled_cases(spark):
    """Local phone numbers and spelled-out addresses are personal data, number lists are not."""
    names = ["ann", "bob", "eve", "kim", "lee", "max"]
    yes, no = [], []
    for i in range(240):
        yes.append((f"please call me, phone ({200 + i % 700}) 555-{1000 + i * 7} thanks", "phone"))
        yes.append((f"contact {names[i % 6]}{i} (at) example{i % 9} (dot) com please", "email") if i % 2 else (f"contact {names[i % 6].upper()}{i} (AT) EXAMPLE{i % 9} (DOT) COM please", "email"))
        yes.append((f"write {names[i % 6]}@mail{i}.example.org or phone +1 (682) 555-{1000 + i}", "base"))
        no.append((f"part x{100 + i % 900}-555-{1000 + i}_b and #{100 + i % 800}-200-{3000 + i}=z", "none"))
        no.append((f"version {i}.{300 + i}.1.2 of the table 1234 5678 9012 {3000 + i} 77", "none"))
    rows = [(i, t) for i, (t, _) in enumerate(yes + no)]
    got = {r.doc_id: r for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = lambda i: len([s for s in got[i].spans.split(",") if s]) - (got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone)
    right = sum(added(i) > 0 for i, (_, k) in enumerate(yes) if k in ("phone", "email"))
    wrong = sum(added(i) > 0 for i in range(len(yes), len(rows)))
    print("added:", right, "of", sum(k != "base" for _, k in yes), "wrong:", wrong)
    assert right / sum(k != "base" for _, k in yes) >= 0.9  # recall
    assert right / (right + wrong) >= 0.9  # precision
