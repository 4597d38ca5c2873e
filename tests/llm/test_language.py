import re
import zlib
from collections import Counter

import numpy as np

from textloom.llm import language
from textloom.llm.language import PROFILE, Ranks, decide, gram_hashes, grams, identify, known_language, learn
from textloom.llm.runtime import read

SF = "/root/testdata/sf0.01"


def test_distance_by_hand():
    profiles = {"a": [g for g, _ in Counter(grams("la") + grams("le")).most_common()], "b": ["x", "y"]}
    ranks = Ranks(profiles)
    d = ranks.distances("La la 12!")
    doc = sorted(Counter(grams("la")).items())
    assert len(d) == 2 and d[0] < d[1] <= 1 and len(doc) == len(set(grams("la")))
    top = [g for g in grams("la")]
    worst = sum(abs(PROFILE - i) for i in range(len(set(top)))) / (PROFILE * len(set(top)))
    assert abs(d[1] - worst) < 1e-9


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = identify(docs, learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", 1.0), (None, None, None, 2.0), (5, "", "en", None), (6, "12 345", "fr", 0.0), (1, "the and of", "en", 1.0), (8, "the " * 60000, None, 0.0)], "doc_id long, text string, lang string, score double")
    got = identify(docs, learn(docs)).collect()
    assert sorted(r.lang_pred for r in got) == ["en", "en", "en", "und", "und", "und"]
    empty = docs.limit(0)
    assert learn(empty) == {} and identify(empty, {}).count() == 0
    assert {r.doc_id for r in known_language(docs).collect()} == {1, 8}
    assert decide(Ranks({}), "word")[0] == "und"


def test_bounded_fit_rows(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'the and of' as text", "'en' as lang").union(spark.range(30).selectExpr("id as doc_id", "'der und die' as text", "'de' as lang"))
    got = learn(docs, 500)
    assert set(got) == {"de", "en"}
    assert got == learn(docs, 5000)  # one text: the same profile, from fewer rows


def test_counts_equal_those_of_words(monkeypatch):
    text = "Älter a I'd don't naïve, x9y _ straße 日本 " * 9
    words = language._WORD.findall(text.lower())
    want = Counter(int(language.gram_hashes(np.array([ord(c) for c in g], np.uint32), len(g))[0]) for w in words for g in grams(w))
    letters = np.array([ord(c) for c in f" {' '.join(words)} "], np.uint32)
    for block in (500_000, 7):
        monkeypatch.setattr(language, "BLOCK_LETTERS", block)
        v, n = language.counted(letters)
        assert dict(zip(v.tolist(), n.tolist())) == want


def test_texts_of_unlearned_languages_go(spark):
    docs = read(spark, SF, "documents")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
    chinese = "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。"
    foreign = [(10**9 + i, t * times) for i, (t, times) in enumerate([(finnish, 1), (finnish, 300), (russian, 1), (russian, 300), (chinese, 1), (chinese, 300)])]
    more = spark.createDataFrame(foreign, "doc_id long, text string").selectExpr("doc_id", "text", "null as lang")
    some = docs.select("doc_id", "text", "lang")
    kept = {r.doc_id for r in known_language(some.unionByName(more)).collect()}
    assert not kept & {i for i, _ in foreign}
    lettered = {r.doc_id for r in some.collect() if r.text and language._WORD.search(r.text)}
    assert kept == lettered  # held-out rows of the learned languages, too


def test_counts_of_texts_of_every_length(monkeypatch):
    monkeypatch.setattr(language, "BLOCK_LETTERS", 7)
    for size in range(1, 30):
        for word in ("a" * size, "ab " * size + "c", ("abcdefghij " * 9)[:size].strip()):
            letters = np.array([ord(c) for c in f" {word} "], np.uint32)
            want = Counter(int(language.gram_hashes(np.array([ord(c) for c in g], np.uint32), len(g))[0]) for w in word.split() for g in grams(w))
            v, n = language.counted(letters)
            assert dict(zip(v.tolist(), n.tolist())) == want


def test_copies_under_one_identifier_do_not_lose_a_language(spark):
    """Texts that share an identifier, and copies of one text, in any number."""
    en = [(1, f"the cat number {i} sat on the mat and the dog", "en") for i in range(400)] + [(1, "the same words again and again", "en")] * 400
    de = [(7 + i, f"der hund nummer {i} und die katze auf der matte", "de") for i in range(30)]
    docs = spark.createDataFrame(en + de + [(900, "the dog and the cat", None), (901, "die katze und der hund", None)], "doc_id long, text string, lang string")
    profiles = learn(docs, rows=40)
    assert set(profiles) == {"en", "de"} and all(len(p) > 50 for p in profiles.values())
    got = {r.doc_id: r.lang_pred for r in identify(docs.where("doc_id >= 900"), profiles).collect()}
    assert got == {900: "en", 901: "de"}


def test_whole_query_equals_brute_force(spark):
    """Profiles by counting, distances by ranks, for every text of a small table."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {}
    for text, lang in {(r.doc_id, r.text, r.lang): (r.text, r.lang) for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}.values():
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault(lang, Counter()).update(g for n in range(1, 5) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " ")
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400]] for lang, c in counts.items()}
    assert profiles == learn(docs)
    order = lambda g: int(gram_hashes(np.array([ord(c) for c in g], np.uint32), len(g))[0])
    got = {(r.doc_id, r.lang_pred, round(r.distance, 9)) for r in identify(docs, learn(docs)).collect()}
    want = set()
    for r in rows:
        c = Counter(g for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) for n in range(1, 5) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " ")
        top = sorted(c, key=lambda g: (-c[g], order(g)))[:400]
        far = {lang: sum(abs((p.index(g) if g in p else 400) - i) for i, g in enumerate(top)) / (400 * len(top)) for lang, p in profiles.items()} if top else {}
        best = min(far, key=lambda lang: (far[lang], lang)) if far else "und"
        want.add((r.doc_id, best, round(far.get(best, 1.0), 9)))
    assert got == want
