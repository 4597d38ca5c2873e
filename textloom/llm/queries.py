"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import alignment, conversations, decontaminate, language, licenses, near_dup, neighbours, packing, pii, quality, repeats, toxicity, training_order
from .runtime import read


def op1_pack(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.detect(read(spark, sf_dir, "documents"))


def op3_neighbours(spark, sf_dir):
    return neighbours.neighbours(read(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op6_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op8_training_order(spark, sf_dir):
    return training_order.materialise(read(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op10_near_duplicates(spark, sf_dir):
    return near_dup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op11_alignment(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op13_conversations(spark, sf_dir):
    return conversations.repair_damaged(read(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_pack, op2_pii, op3_neighbours, op4_decontaminate, op5_language, op6_licenses, op7_repeats, op8_training_order, op9_quality, op10_near_duplicates, op11_alignment, op12_toxicity, op13_conversations)}


def oracle_sql():
    return {"op6_licenses": licenses.sql(), "op13_conversations": conversations.sql()}
