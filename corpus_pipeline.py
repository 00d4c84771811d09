"""The pipeline: language ID, near-duplicate removal, substring dedup, benchmark decontamination, packing.

Every stage is one operator of textloom.llm with its production parameters and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, jaccard, language, packing, substring
from textloom.llm.common import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no likely language, go: null, empty and blank texts too. Ids play no part but for the
    folds that are learned from; repeated rows go or stay together. Without labelled rows nothing has a language, and all go."""
    return language.keep_known(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the least id stays. A null id counts as the largest; of rows of null id that
    link with each other one stays; repeated rows of the least id all stay. Null, empty and blank texts link with nothing."""
    return jaccard.one_of_each(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has too are cut out, and a document of which no word is left goes. A null id counts
    as the largest; rows of equal id do not cut one another; null, empty and blank texts stay as they are."""
    return substring.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their ids and the item's; null, empty and blank texts hold none. Without a
    benchmark all stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences. Null and empty texts are one end id; repeated rows and null ids are packed
    like others."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("substring_dedup", cut_substrings),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]
#: SQL can express neither the classifier nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
