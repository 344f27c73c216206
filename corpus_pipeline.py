"""Documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; each result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table
from gridloom.llm.exact_dedup import drop_copies
from gridloom.llm.language_id import keep_identified
from gridloom.llm.near_dedup import drop_near_copies
from gridloom.llm.pii_semicrf import redact_documents
from gridloom.llm.tier_packing import pack_documents
from gridloom.session import drop_written, tables_written, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language, or with an ambiguous one, go."""
    return keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, the longest stays, then the smallest id."""
    return drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of 0.8 similar sets of five-word shingles."""
    return drop_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: classifiers, the field and the tokenizer have no equivalent; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of a folder; what a stage wrote on its way goes when its result is stored."""
    docs, kept = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, [*kept, path])
    return STAGES[-1][1](spark, docs, sf_dir)
