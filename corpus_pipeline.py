"""Corpus pipeline: language identification, line deduplication, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps (the last one: packed pieces). ``run``
writes every stage's result below the shared checkpoint folder and rereads it, so a lost executor never
sends the job back past a finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scopekit.llm import decontamination, language, line_dedup, packing, simhash
from scopekit.llm.common import table, written
from scopekit.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language.keep_identified(docs, language.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out; every document stays."""
    return line_dedup.remove_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark_passages), ("packing", packed_sequences)]

# No SQL: language models, fingerprints and tokenizers are beyond it; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
