"""Document fingerprints by a threshold-scaled sketch.

The sketch of a text keeps every hash of its word shingles below a fixed fraction of the hash range, and no other.
Sketches of parts merge by union, a part's sketch is contained in the whole's, and likeness of texts of very unequal
length can be estimated from sketches alone. All of it is DataFrame expressions.

Defined results: a null text is an empty text with an empty sketch; texts with fewer words than a shingle have
one shingle; a short text's sketch may be empty: it is contained in every other (by 1) and, as nothing is known of it,
like none (by 0), but equal texts are alike by 1; rows with equal ids go in order of
their texts' hashes, null ids come first; the only row of a table is its own next; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import shuffle_partitions, table, words

SHINGLE_WORDS = 5
#: Hashes whose first KEEP_BITS bits are all 0 are kept: one in 2 ** KEEP_BITS.
KEEP_BITS = 2
#: Text of one range of ids, in bytes.
RANGE_BYTES = 8_000_000
RANGE_ERROR = 0.0005


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sketch of a text column: sorted distinct hashes."""
    df = df.withColumn("_w", words(F.col(text)))
    w, n = F.col("_w"), SHINGLE_WORDS
    hashes = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes).drop("_w")
    kept = F.filter("_h", lambda x: F.shiftrightunsigned(x, 64 - KEEP_BITS) == 0)
    return df.withColumn(out, F.sort_array(F.array_distinct(kept))).drop("_h")


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together (shingles across the seam apart)."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 0 where either sketch is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(df: DataFrame, id_col: str, tie: str, payload: list[str]) -> DataFrame:
    """``df`` (with a column ``text``) with ``next_<name>`` of the row that follows in order of id and tie; the first follows the last.

    Rows are dealt to ranges of ids, as many as the bytes of the texts ask for, by approximate quantiles. The first row of each range is also sent to the
    range before it, so every range finds its followers alone. The driver sees a row per range.
    """
    spark = df.sparkSession
    ranges = int(max(2 * shuffle_partitions(spark), -(-(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)))
    at = df.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], min(RANGE_ERROR, 0.2 / ranges))
    edges = sorted(set(at))
    part = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e <= F.col(id_col).cast("double")))
    own = df.withColumn("_part", F.when(F.col(id_col).isNull(), 0).otherwise(part))
    firsts = own.groupBy("_part").agg(F.min(F.struct(F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf"))).alias("x"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))).alias("m")).collect()
    firsts = sorted((r["_part"], r["m"]["id"], r["m"]["tie"]) for r in firsts)
    kind = dict(df.dtypes)
    sent = [(p, i, t, firsts[k - 1][0]) for k, (p, i, t) in enumerate(firsts)]
    # A row per range.
    to = F.broadcast(spark.createDataFrame(sent, f"_part int, _id {kind[id_col]}, _tie {kind[tie]}, _to int"))
    ghosts = own.join(to, "_part").filter(F.col(id_col).eqNullSafe(F.col("_id")) & F.col(tie).eqNullSafe(F.col("_tie")))
    ghosts = ghosts.withColumn("_part", F.col("_to")).drop("_id", "_tie", "_to").withColumn("_ghost", F.lit(1))
    w = Window.partitionBy("_part").orderBy("_ghost", F.col(id_col).asc_nulls_first(), tie)
    rows = own.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in payload})
    return rows.filter("_ghost = 0").drop("_part", "_ghost")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last quarter replaced by the next document's
    beginning, and its likeness to both the edited text and the next document."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(with_sketch(own, "text", "sketch"), id_col, "tie", ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("same_next", F.col("text") == F.col("next_text"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, CAST(n_chars - n_chars DIV 4 AS INT)), left(next_text, CAST(n_chars DIV 4 AS INT)))"))
    rows = with_sketch(rows.withColumn("same_edited", F.col("text") == F.col("edited")).drop("text", "next_text"), "edited", "edited_sketch")
    s, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        id_col,
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(s).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        F.when(F.col("same_edited"), 1.0).otherwise(likeness(s, e)).alias("near_edited"),
        F.when(F.col("same_next"), 1.0).otherwise(likeness(s, n)).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLES: dict[str, str] = {}
