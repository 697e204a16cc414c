"""The corpus pipeline: language ID, quality rules, near-dedup, suffix-array dedup, packing.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last returns
the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, langid, minhash, packing, quality, substrings
from weft.llm.common import durable, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language is in doubt."""
    return langid.keep_identified(docs)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove frequent lines and drop documents that fail the rules."""
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 100 bytes that occur earlier."""
    return substrings.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, bpe.vocabulary())


STAGES = [("language ID", identify), ("quality rules", judge), ("near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, durable(docs) if k else docs, sf_dir)
    return docs
