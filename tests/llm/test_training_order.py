import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from textloom.llm.runtime import read
from textloom.llm.tokens import Words, default_path
from textloom.llm.training_order import materialise, permuted, read_slots

SF = "/root/testdata/sf0.001"


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = permuted(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 1).tolist() != permuted(np.arange(1000), 1000, 2).tolist()


def test_round_trip(spark, tmp_path):
    docs = read(spark, SF, "documents").repartition(3).cache()  # the same partitions each time
    folder = f"file://{tmp_path}/out"
    rows = sorted(materialise(docs, folder, length=64, per_shard=50).collect())
    assert [r.slot for r in rows] == list(range(len(rows)))
    got = list(read_slots(folder, 0, len(rows), 64, 50))
    t = Tokenizer.from_file(default_path())
    # a sequence holds tokens of one partition, whose last one is filled up
    parts = docs.select(F.spark_partition_id().alias("p"), "text").collect()
    want = [i for p in range(3) for d in parts if d.p == p for i in [*t.encode(d.text, add_special_tokens=False).ids, 1]]
    order = sorted(rows, key=lambda r: r.sequence_index)
    ids = np.concatenate([got[r.slot][: r.n_tokens] for r in order]).tolist()
    assert ids == want
    assert all(zlib.crc32(got[r.slot].tobytes()) == r.crc32 and (r.shard, r.byte_offset) == (r.slot // 50, r.slot % 50 * 128) for r in rows)
    assert np.array_equal(list(read_slots(folder, 73, 40, 64, 50)), got[73:113])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a b", 1), (2, "a b", 1)], "doc_id long, text string, slot int").coalesce(1)
    rows = materialise(docs, length=4).collect()
    assert sum(r.n_tokens for r in rows) == 1 + 1 + 3 + 3
    assert materialise(docs.limit(0)).count() == 0


def test_latin_texts_are_cut_as_the_library_does():
    words, t = Words(default_path()), Tokenizer.from_file(default_path())
    rng = random.Random(8)
    signs = [*map(chr, range(1, 256)), *"'''strevmlld  ABÀÉß<|>" * 4]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_are_remembered_without_case_and_marks():
    words = Words(default_path())
    words.encode("Étude, étude. ÉTUDE$$$ étude étude's")
    assert sorted(words) == sorted(["étude", ",", ".", "$$$", "'s"])
