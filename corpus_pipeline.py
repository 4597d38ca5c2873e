"""The corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

from textloom.llm.decontaminate import without_leaks
from textloom.llm.language import known_language
from textloom.llm.near_dup import one_of_each
from textloom.llm.packing import pack
from textloom.llm.pii import redact
from textloom.llm.runtime import forget, keep, read, scratch


def language(spark, docs, sf_dir):
    """Documents whose language is none of the learned go."""
    return known_language(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data is masked; all documents stay."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """The remaining texts are packed; the result has a row per piece."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Learned stages and token identifiers are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each one's result written to the shared folder.

    Of the written results only the last stays, which the packed rows are read from.
    """
    docs = read(spark, sf_dir, "documents")
    former = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as hand_on:  # what the stage kept goes once its result is written
            docs = hand_on(keep(stage(spark, docs, sf_dir), name))
        if former is not None:
            forget(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
