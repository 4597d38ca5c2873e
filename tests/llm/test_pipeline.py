import pathlib
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks_of
from tests.llm.test_near_dup import brute as classes_of
from tests.llm.test_pii import plain
from textloom.llm.near_dup import classes
from textloom.llm.pii import KINDS, detect
from textloom.llm.repeats import remove_repeats
from textloom.llm.runtime import forget, keep, scratch, shared_dir
from textloom.llm.tokens import default_path
from textloom.llm.training_order import materialise


def masked(text):
    for k, s, e in sorted(plain(text), key=lambda x: -x[1]):
        text = text[:s] + f"[{KINDS[k].upper()}]" + text[e:]
    return text


def test_stages_equal_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 200 and 1500").orderBy("doc_id").limit(60)
    docs = [tuple(r) for r in source.collect()]
    bench = [(i, " ".join(docs[i * 7][1].split()[:40])) for i in range(3)] + [(9, None)]
    spam = "write to a.b@example.org or +1 (682) 555-5413 "
    docs += [(9000 + i, spam + d[1], d[2], d[3], d[4]) for i, d in enumerate(docs[30:36])]
    docs += [(9100, "12 34 !!", "en", "s", 8), (9101, None, None, None, None), (9102, docs[3][1], "en", "s", 1), docs[4]]
    schema = source.schema
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    left.sort(key=lambda d: d[0])
    root = classes_of([d[1] for d in left])
    left = [d for i, d in enumerate(left) if root[i] == i]
    left = [d for d in left if not leaks_of(d[1], bench)]
    want = {d[0]: masked(d[1]) for d in left}
    assert len(want) < len(docs) - 4 and any("[EMAIL]" in t for t in want.values())

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(default_path())
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        ids = [*t.encode(want[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_a_run_leaves_the_results_of_others_whole(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found, manifest = detect(docs), materialise(docs, length=64, per_shard=8)
    classed, repeats = classes(docs), remove_repeats(docs)
    shards = pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("*/shards/*.bin")
    assert (before := sorted(shards))
    first = corpus_pipeline.run(spark, str(tmp_path))
    n = first.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == n == first.count()
    assert found.count() == classed.count() == repeats.count() == 20 and manifest.count() > 20
    assert all(p.exists() for p in before)


def test_scratch_deletes_its_own_tables_only(spark):
    kept = keep(spark.range(3).toDF("x"), "outer")
    with scratch(spark) as hand_on:
        gone, stays = keep(kept, "inner"), hand_on(keep(kept, "inner"))
        with scratch(spark) as inner:
            up = inner(keep(kept, "deep"))
        assert up.count() == gone.count() == 3
    assert kept.count() == stays.count() == 3
    folders = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    assert [(folders / t.kept_at.rsplit("/", 1)[1]).exists() for t in (kept, stays, gone, up)] == [True, True, False, False]
    forget(kept)
    assert not (folders / kept.kept_at.rsplit("/", 1)[1]).exists()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs home"
    docs = spark.createDataFrame([(1, text, "en", "k", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, `a.b` string, _KEY int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert (1, text, "en", "k", 1) in [tuple(r) for r in out.collect()]
