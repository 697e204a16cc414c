"""Column functions for sequences and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sequence limits of the one-byte separator scheme, with and without reverse complements.
MAX_SEQUENCES_RC, MAX_SEQUENCES = 125, 250
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
PROTEIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def complement(base: Column) -> Column:
    """The complementary base; anything but A, C, G, T raises."""
    return F.when(base.rlike("^[ACGT]$"), F.translate(base, "ACGT", "TGCA")).when(base.isNotNull(), F.raise_error(F.lit("Invalid nucleotide")))


def revcomp(seq: Column) -> Column:
    """The reverse complement; a sequence with anything but A, C, G, T raises."""
    ok = seq.rlike("^[ACGT]*$")
    return F.when(ok, F.translate(F.reverse(seq), "ACGT", "TGCA")).when(seq.isNotNull(), F.raise_error(F.lit("Invalid nucleotide")))


def sanitize_dna(seq: Column) -> Column:
    """Upper case, without anything but A, C, G, T."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "")


def is_dna(seq: Column) -> Column:
    return seq.rlike("(?i)^[ATGC]+$")


def is_protein(seq: Column) -> Column:
    return seq.rlike("(?i)^[A-Z]+$")


def sequence_type(seq: Column) -> Column:
    """dna, protein or text, by the letters alone; an empty sequence is text."""
    return F.when(is_dna(seq), "dna").when(seq.rlike(f"(?i)^[{AMINO_ACIDS}]+$"), "protein").when(seq.isNotNull(), "text")


def binary_type(data: Column) -> Column:
    """As ``sequence_type`` for bytes; those that are no UTF-8 are binary."""
    return F.when(F.is_valid_utf8(data.cast("string")), sequence_type(data.cast("string"))).when(data.isNotNull(), "binary")


def validate_text(text: Column) -> Column:
    """The text, if it is not empty, all ASCII and without a NUL but at its end; else an error."""
    bad = F.when(F.length(text) == 0, "Input data cannot be empty").when(~text.rlike(r"(?s)^[\x01-\x7F]*\x00?$"), "Input must be ASCII without inner NUL")
    return F.when(bad.isNull(), text).otherwise(F.raise_error(bad))


def is_rc(packed: Column) -> Column:
    """Whether a packed reference has its top bit set."""
    return packed < 0


def rc_ref(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 63) - 1))


def pack_ref(ref: Column, rc: Column) -> Column:
    return F.when(rc, ref.bitwiseOR(F.lit(-(1 << 63)))).otherwise(ref)


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>| ]', "_")


def prepare_sequences(df: DataFrame, group: str, order: str, seq: str, *, with_rc: bool) -> DataFrame:
    """One row per group: what its joined sequences look like to the kernel.

    (group, n_sequences, prepared_length, original_length, sentinel_positions, sequences). Sequences are upper-cased,
    empty ones skipped; other letters raise, as do more sequences than separators, and groups without a sequence
    are those of empty ones only. With reverse complements every sequence has a separator after it, else only those
    between two.
    """
    most = MAX_SEQUENCES_RC if with_rc else MAX_SEQUENCES
    own = df.filter(F.length(seq) > 0).select(group, order, F.upper(seq).alias("seq"))
    own = own.withColumn("seq", F.when(F.col("seq").rlike("^[ACGT]+$"), F.col("seq")).otherwise(F.raise_error(F.lit("Invalid nucleotide"))))
    w = Window.partitionBy(group).orderBy(order)
    ends = own.withColumn("sentinel", F.sum(F.length("seq") + 1).over(w) - 1)
    out = ends.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, "seq", "sentinel"))).alias("x"), F.count(F.lit(1)).alias("n_sequences"), F.sum(F.length("seq")).alias("bases"))
    out = out.withColumn("n_sequences", F.when(F.col("n_sequences") <= most, F.col("n_sequences")).otherwise(F.raise_error(F.lit("Too many sequences"))))
    half = F.col("bases") + F.col("n_sequences")
    total = 2 * half if with_rc else half - 1
    at = F.transform("x", lambda x: x["sentinel"])
    return out.select(
        group,
        "n_sequences",
        total.cast("long").alias("prepared_length"),
        (F.col("bases") + F.col("n_sequences") - (0 if with_rc else 1)).cast("long").alias("original_length"),
        (at if with_rc else F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).cast("array<bigint>").alias("sentinel_positions"),
        F.transform("x", lambda x: x["seq"]).alias("sequences"),
    )


def _characters(text: str) -> Column:
    """(character, n, first_at) of each distinct character, in order of appearance, within the row."""
    t = F.col(text)
    each = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
    n = lambda c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.transform(each, lambda c: F.struct(c.alias("character"), n(c).cast("long").alias("n"), (F.position(c, t) - 1).cast("long").alias("first_at")))


def alphabet_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, character, n, first_at): how often each character occurs, and where first. Nothing is shuffled."""
    return df.filter(F.length(text) > 0).select(id_col, F.inline(_characters(text)))


def alphabet_profile(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, size, entropy, total_length): distinct characters, Shannon entropy in bits, and length. Nothing is shuffled."""
    rows = df.filter(F.length(text) > 0).select(id_col, F.length(text).cast("long").alias("total_length"), F.transform(_characters(text), lambda c: c["n"]).alias("counts"))
    share = lambda n: n / F.col("total_length")
    entropy = F.aggregate("counts", F.lit(0.0), lambda sum_, n: sum_ - share(n) * F.log2(share(n)))
    return rows.select(id_col, F.size("counts").cast("long").alias("size"), entropy.alias("entropy"), "total_length")


def alphabet_top(df: DataFrame, id_col: str, text: str, k: int = 10) -> DataFrame:
    """(id, rank, character, n): the k most common characters; of equal ones the first to appear comes first."""
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "first_at")
    return alphabet_counts(df, id_col, text).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "rank", "character", "n")


def register_sql(spark: SparkSession) -> None:
    """SQL names: revcomp, sanitize_dna, sequence_type; lz_count, lz_factors (a table function) from the kernels."""
    from weft.operators import factorize

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGT', 'TGCA')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sanitize_dna(s STRING) RETURNS STRING RETURN regexp_replace(upper(s), '[^ACGT]', '')")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION sequence_type(s STRING) RETURNS STRING RETURN CASE WHEN s RLIKE '(?i)^[ATGC]+$' THEN 'dna' "
        f"WHEN s RLIKE '(?i)^[{AMINO_ACIDS}]+$' THEN 'protein' WHEN s IS NOT NULL THEN 'text' END"
    )
    factorize.register_sql(spark)
