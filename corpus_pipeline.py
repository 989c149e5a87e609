"""From raw documents to token ids: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents. What lies between is written and read again, by run()
in the shared folder. Other columns than doc_id, text, lang, source and n_chars may be
there, whatever their names, and are kept as they are; rows may repeat; nulls may stand
in any column; an empty table passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmesh.functions.storage import written
from rowmesh.llm import decontaminate, pii, quality, simhash, subwords


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules or lie outside their language's tokenizer band go.

    Null and empty texts have no words and go; a null lang is judged by its script; rows
    that repeat stay or go together. Very long texts are judged whole.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links, the one with the least id stays.

    Of rows with that id the least hash decides; null and empty texts are one group; a
    group without any id keeps one row.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts overlap none, rows that repeat stay or go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is replaced by its kind, and n_chars brought up to date; null texts stay null."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as token ids: doc_id, lang, source, variant, ids; a null or empty text has none, a null id the first variant."""
    return subwords.encoded(docs, ("lang", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express tokenizers, disguises or merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # Stages read their input more than once.
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
