"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, secret redaction and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of `docs`. `run` writes every
stage's result as a table in the shared folder and reads it back as the next one's documents, so a lost executor repeats at
most one stage. Null and empty texts, repeated rows, empty tables and further columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewarden.llm.common import documents, stored
from pricewarden.llm.line_dedup import keep_new_lines
from pricewarden.llm.near_dups import keep_first_of_classes
from pricewarden.llm.packing import pack_documents
from pricewarden.llm.quality_rules import reject_low_quality
from pricewarden.llm.queries import END_ID, tokenizer
from pricewarden.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return reject_low_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id holds; one that loses all its lines keeps an empty text."""
    return keep_new_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest doc_id."""
    return keep_first_of_classes(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=END_ID)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

# Near duplicates, Markov models and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
