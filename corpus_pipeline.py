"""Corpus pipeline: language ID, near-duplicates, repeated passages, source mixing, packing.

Each stage takes what the one before it kept, written as Parquet and read again; all but the last
return the columns of ``documents``.

Defined cases, over all stages: documents with a null, empty or unlettered text go in the first; a null doc_id, lang or source stays (such a
document is never a near-duplicate and repeats nothing; a null source is a source of its own); equal rows are one document to the two dedup stages, which keep or
treat them alike, and are drawn and packed each; of equal or similar documents the one with the smallest doc_id stays; texts of any length, and any length of white space in
them, are read whole; extra columns keep their values, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import automaton, langid, minhash, mixing, packing, scratch
from tidelog.llm.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, and empty ones, go."""
    return langid.keep_accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays, a wholly repeated one with an empty text."""
    return automaton.remove_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight draws them."""
    return mixing.mixed(docs).select(*docs.columns)


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none across documents."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("power_of_two_packing", power_of_two_packing),
]

#: SQL can express neither the network nor the hashing of the first two stages; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next.

    Once a stage's result is written, the tables that it was made from are deleted; tables of other operators that ran before stay.
    """
    docs, before = table(spark, sf_dir, "documents"), scratch.count()
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        scratch.clear(spark, keep=1, after=before)
    return STAGES[-1][1](spark, docs, sf_dir)
