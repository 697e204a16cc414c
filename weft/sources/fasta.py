"""FASTA in and out.

Files are split into lines by Spark's text reader or, with ``whole_files``, read as one row each; records are put
together per file. Gzip files are read by the codec their name tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.sequences import AMINO_ACIDS, is_dna, sequence_type

LINE_WIDTH = 80


def read_fasta(spark: SparkSession, path: str | list[str], *, ambiguous: str = "remove", duplicates: str = "keep", empty: str = "skip") -> DataFrame:
    """(file, seq_idx, seq_id, header, seq, n_removed), a row per record, upper case.

    ``ambiguous``: ``remove`` drops letters other than A, C, G, T and counts them, ``strict`` raises, ``keep`` leaves
    them (proteins). ``duplicates``: ``keep`` all records of an id, or the ``last`` at the first one's place. ``empty``:
    ``skip`` or ``keep`` records without letters. Text before the first header, a header without an id and a file
    without a record raise.
    """
    return parse_fasta(read_whole(spark, path), "file", "text", ambiguous=ambiguous, duplicates=duplicates, empty=empty)


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): whole files, with line feeds alone at the ends of lines."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_fasta_auto(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, type, seq_idx, seq_id, header, seq, factors) by the type of each file's first record: the records of a DNA
    file are checked as nucleotides and factorized, those of a protein file are checked as proteins and have no
    factors; any other file raises."""
    from weft.operators import factorize

    records = read_fasta(spark, path, ambiguous="keep", duplicates="last")
    records = records.join(file_types(records), "file")
    good = F.when(F.col("type") == "dna", F.col("seq").rlike("^[ACGT]+$")).when(F.col("type") == "protein", F.col("seq").rlike(f"^[{AMINO_ACIDS}]+$"))
    error = F.when(good.isNull(), F.concat(F.lit("cannot tell the sequence type of "), F.col("file"))).when(~good, F.concat(F.lit("not a "), F.col("type"), F.lit(" sequence: "), F.col("seq_id")))
    records = records.withColumn("seq", F.when(error.isNull(), F.col("seq")).otherwise(F.raise_error(error)))
    key = F.struct("file", "seq_idx").alias("key")
    factors = factorize.nest(factorize.factorize(records.filter("type = 'dna'").select(key, "seq"), "key", "seq"), "key")
    own = records.select(key, "file", "type", "seq_idx", "seq_id", "header", "seq")
    return own.join(factors, "key", "left").select("file", "type", "seq_idx", "seq_id", "header", "seq", "factors")


def parse_fasta(df: DataFrame, file: str, text: str, *, ambiguous: str = "remove", duplicates: str = "keep", empty: str = "skip") -> DataFrame:
    """As ``read_fasta`` over a column of whole files."""
    body = F.concat(F.lit("\n"), F.col(text))
    parts = F.split(body, "\n[ \t]*>")
    before = F.length(F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"\s+", ""))) > 0
    checked = (
        F.when(before, F.raise_error(F.lit("FASTA: sequence data before the first header")))
        .when(F.size(parts) < 2, F.raise_error(F.lit("FASTA: no record")))
        .otherwise(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    )
    rows = df.select(F.col(file).alias("file"), F.posexplode(checked).alias("seq_idx", "record"))
    header = F.trim(F.regexp_extract("record", r"^([^\n]*)", 1))
    rows = rows.select("file", "seq_idx", header.alias("header"), F.upper(F.regexp_replace(F.regexp_replace("record", r"^[^\n]*", ""), r"\s+", "")).alias("raw"))
    seq_id = F.regexp_extract("header", r"^(\S+)", 1)
    rows = rows.withColumn("seq_id", F.when(seq_id != "", seq_id).otherwise(F.raise_error(F.lit("FASTA: empty header"))))
    if ambiguous == "strict":
        seq = F.when(F.col("raw").rlike("^[ACGT]*$"), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("FASTA: invalid nucleotide in "), F.col("seq_id"))))
    elif ambiguous == "remove":
        seq = F.regexp_replace("raw", "[^ACGT]", "")
    elif ambiguous == "keep":
        seq = F.col("raw")
    else:
        raise ValueError(f"unknown policy {ambiguous!r}")
    rows = rows.withColumn("seq", seq).withColumn("n_removed", F.length("raw") - F.length("seq")).drop("raw")
    if empty == "skip":
        rows = rows.filter("seq <> ''")
    if duplicates == "last":
        first = F.min("seq_idx").alias("seq_idx")
        last = F.max_by(F.struct("header", "seq", "n_removed"), "seq_idx").alias("x")
        rows = rows.groupBy("file", "seq_id").agg(first, last).select("file", "seq_idx", "seq_id", "x.header", "x.seq", "x.n_removed")
    return rows.select("file", "seq_idx", "seq_id", "header", "seq", "n_removed")


def nucleotides(records: DataFrame) -> DataFrame:
    """The records; one with anything but A, C, G, T raises."""
    bad = F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), F.col("seq_id")))
    return records.withColumn("seq", F.when(F.col("seq").rlike("^[ACGT]+$"), F.col("seq")).otherwise(bad))


def proteins(records: DataFrame) -> DataFrame:
    """The records; one with anything but the 20 amino acids raises."""
    bad = F.raise_error(F.concat(F.lit("not a protein sequence: "), F.col("seq_id")))
    return records.withColumn("seq", F.when(F.col("seq").rlike(f"^[{AMINO_ACIDS}]+$"), F.col("seq")).otherwise(bad))


def file_types(records: DataFrame) -> DataFrame:
    """(file, type): by the type of the file's first record."""
    return records.groupBy("file").agg(F.min_by(sequence_type(F.col("seq")), "seq_idx").alias("type"))


def format_fasta(records: DataFrame, *, width: int = LINE_WIDTH) -> DataFrame:
    """(file, seq_idx, value): each record as text with lines of ``width`` letters."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return records.select("file", "seq_idx", F.concat(F.lit(">"), F.coalesce("header", "seq_id"), F.lit("\n"), lines).alias("value"))


def write_fasta(records: DataFrame, path: str, *, width: int = LINE_WIDTH) -> None:
    """Write records as text files, in order of file and place."""
    format_fasta(records, width=width).repartitionByRange("file", "seq_idx").sortWithinPartitions("file", "seq_idx").select("value").write.mode("overwrite").text(path)


__all__ = ["file_types", "format_fasta", "is_dna", "nucleotides", "parse_fasta", "proteins", "read_fasta", "read_fasta_auto", "read_whole", "write_fasta"]
