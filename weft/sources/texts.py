"""Whole files as texts, and plain-text dumps of factors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, data): each file's bytes as one text."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("data"))


def file_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size) from the listing alone: contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def nucleotide_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n_nucleotides): letters outside headers, counted over whole files."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter("NOT startswith(ltrim(value), '>')")
    return lines.groupBy("file").agg(F.sum(F.length(F.regexp_replace("value", r"\s+", ""))).alias("n_nucleotides"))


def load_trends(spark: SparkSession, path: str) -> dict:
    """A JSON file of fitted trends; empty if there is none."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"]) if rows else {}


def write_factor_text(factors: DataFrame, id_col: str, path: str) -> None:
    """Tab-separated factors, a folder for each id, in order of start."""
    line = F.concat_ws("\t", "start", "length", "ref", F.col("is_rc").cast("string"))
    factors.select(F.col(id_col).cast("string").alias("id"), "start", line.alias("value")).repartition("id").sortWithinPartitions("id", "start").drop("start").write.mode("overwrite").partitionBy("id").text(path)
