"""From documents to token ids: quality, near duplicates, benchmark leaks, personal data, encoding.

Every stage but the last returns the columns of its input. Null and empty texts pass as empty ones unless a stage says
otherwise; texts may be of any length; rows may be repeated or lack a doc_id; columns may have any names beside doc_id
and text; an empty table stays one. What a stage writes on the way is deleted once its own table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, ngram_join, pii, quality
from plumbline.llm.common import step, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Texts are judged one by one: nulls as empty ones, repeated rows alike; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by n-gram similarity, one row stays, with the smallest doc_id.

    Wordless texts are linked with nothing, but of rows that share a doc_id and are wordless one stays. Rows without an id
    go if one with an id has their set of n-grams; otherwise one of each set stays, and all wordless ones.
    """
    return ngram_join.one_of_each(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, with or without an id; null and empty texts hold none; without benchmark all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to placeholders; every row stays, null texts stay null."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: a row for each row, null texts as empty ones."""
    return bpe.encode_digests(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_leaks), ("personal_data", redacted), ("encoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
