"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents: language identification and
quality rules keep some rows (and take boilerplate lines out), the similarity join keeps one document of each group, substring
deduplication takes repeated passages out of texts. run() writes each stage's rows as Parquet in the shared folder and reads
them again for the next, so a lost executor costs one stage's tasks at most; what a stage has made besides, and its input, is
deleted then. The table that the last stage reads stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import language_id, near_join, packing, quality, suffix_dedup
from lamina.llm.common import dropped, prepare, scratch, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a probability of 0.5 or more; texts that are null or have no letter go."""
    prepare(spark)
    return language_id.keep_identified(docs, language_id.train(docs, language_id.learned_rows()))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes a host's boilerplate lines out of texts; documents that fail the base rules or have too little left go."""
    prepare(spark)
    return quality.keep_documents(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays, the one with the smallest doc_id."""
    prepare(spark)
    return near_join.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 200 bytes that occurs elsewhere goes from all texts; documents stay, even if nothing of their text is left."""
    prepare(spark)
    return suffix_dedup.keep_rest(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", join_near_duplicates),
    ("repeats", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: Training a network, and packing by heuristics, have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay."""
    docs, last = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep(docs)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
