import random

import duckdb

from textloom.llm.licenses import TEMPLATES, bigrams, normal, scan, size_bounds, sql

MIT = "Released under the MIT License."
APACHE = TEMPLATES["apache-2.0-notice"].split()
GPL = TEMPLATES["gpl-3.0-notice"].split()
ROWS = [
    (1, f"intro\n{MIT}\nLICENSED under CC BY-NC 4.0", "x"), (1, f"intro\n{MIT}\nLICENSED under CC BY-NC 4.0", "x"),
    (None, None, "x"), (2, "", "x"), (3, "released\tunder -- the mit license", None), (4, "We released it under the terms of the license", "x"),
    (5, "plain " * 3000 + "\n" + TEMPLATES["gpl-3.0-notice"] + " indeed", "x"), (6, "\n\n", "x"), (7, "This work is licensed under the GNU General Public License, version 2", "x"),
    (8, "under the\nmit license", "x"), (9, "This software is released under the MIT License.", "x"), (10, "word", "x"),
    (11, "# " + " ".join(GPL[:14]) + "\n# " + " ".join(GPL[14:27]) + "\n# " + " ".join(GPL[27:]), "x"),
    (12, "x " * 40 + " ".join(APACHE[:9] + ["strange", "words"] + APACHE[9:]) + " y" * 40, "x"),
    (13, "mit license " * 50 + "the mit released under", "x"), (14, f"{MIT} " * 30, "x"), (15, "Of the license and the software " * 200, "x"),
]


def brute(text):
    """All runs of words, grown one bigram at a time."""
    w, out = normal(text or ""), {}
    g = [f"{a} {b}" for a, b in zip(w, w[1:])]
    for k, t in TEMPLATES.items():
        b = bigrams(normal(t))
        lo, hi = size_bounds(len(b))
        for i in range(len(g)):
            run, shared = set(), 0
            for n, x in enumerate(g[i : i + hi], 1):
                shared += x in b and x not in run
                run.add(x)
                if n >= lo and (d := 2 * shared / (len(run) + len(b))) >= 0.8:
                    out[k] = max(d, out.get(k, 0.0))
    return len(out), ",".join(sorted(out)), round(max(out.values(), default=0.0), 6)


def compare(spark, rows):
    got = [tuple(r) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string").repartition(3)).collect()]
    want = [(d, *brute(t)) for d, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, licenses varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(sql()).fetchall(), key=str) == sorted(want, key=str)
    return {d: r for d, *r in got}


def test_scan_equals_brute_force_and_sql(spark):
    found = compare(spark, ROWS)
    assert found[1][1] == "cc-by-nc-4.0,mit"
    assert found[8][1] == found[9][1] == found[14][1] == "mit"  # wrapped, inside a line, many times
    assert found[5][2] == found[11][2] == 1.0 and found[11][1] == "gpl-3.0-notice"
    assert "apache-2.0-notice" in found[12][1] and 0.8 <= found[12][2]
    assert [found[d][0] for d in (None, 2, 4, 6, 10, 13, 15)] == [0] * 7


def test_notices_with_words_lost_changed_and_added(spark):
    draw, rows = random.Random(5), []
    for i in range(60):
        words = ["some"] * draw.randrange(4)
        for w in TEMPLATES[draw.choice(sorted(TEMPLATES))].split():
            at = draw.random()
            words += [] if at < 0.06 else ["other"] if at < 0.1 else [w, "more"] if at < 0.15 else [w, w] if at < 0.17 else [w]
        rows.append((i, " ".join(words + ["rest"] * draw.randrange(4)), None))
    found = compare(spark, rows)
    assert 10 < sum(n > 0 for n, *_ in found.values()) < 60


def test_bounds_and_empty(spark):
    assert size_bounds(10, 0.8) == (7, 15)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan(docs).count() == 0
    assert scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {}).first()["n_licenses"] == 0


def test_no_python_in_the_plan(spark):
    plan = scan(spark.createDataFrame(ROWS, "doc_id long, text string, z string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
