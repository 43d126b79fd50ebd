"""The corpus pipeline: five stages over the documents table, each one operator of kardia.llm.

Each stage takes all that the one before kept, is written as Parquet below the
shared scratch folder and read again. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kardia.llm import op2_automaton, op3_decontaminate, op7_simhash, op9_surrogates, op10_toxicity
from kardia.llm.common import scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold stay; the grammar is fitted on their labels."""
    return op10_toxicity.keep_clean(docs, op10_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return op7_simhash.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark stay."""
    return op3_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with surrogates for personal data."""
    key = op9_surrogates.key_of(spark)
    return op9_surrogates.replace_texts(op9_surrogates.checked(docs, key), key)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text that they decode to."""
    return op2_automaton.roundtrip(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]
ORACLE_SQL = None  # BPE and XXH64 fingerprints have no DuckDB SQL; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
