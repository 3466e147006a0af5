"""Corpus pipeline: quality, toxicity, near duplicates, benchmark passages, packing; each stage calls one operator on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, packing, quality, simhash, toxicity
from tidelog.llm.common import read, staged
from tidelog.llm.queries import WORD_BPE
from tidelog.llm.words import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and empty texts are judged too, no rows give no rows."""
    return quality.without_poor(docs, read(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below their language's threshold."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; 3-word shingles, 3 bits."""
    return simhash.one_per_group(docs, shingle=3, bits=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item: tiles of five words or more, 0.8 of the item's words."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"), threshold=0.8, tile=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(WORD_BPE), capacity=2048, end_id=0, with_ids=False)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("decontamination", drop_leaks), ("packing", pack)]
#: The classifiers and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the last stage; every other stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
