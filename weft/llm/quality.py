"""Quality rules from cross-document line frequency.

Lines are normalised and hashed; the number of distinct documents that hold a line is counted per
host; lines above the host's limit are removed; documents that lose most of their words are rejected.
All of it is DataFrame expressions.

Copies of one text count as one document, so a page is never called boilerplate for being copied.

Defined results: a null text is an empty text (no words, so it fails the base rules); a null host is a
host of its own; repeated rows get equal verdicts; an empty table gives an empty result; extra columns
are ignored by ``judge_quality`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SPACES, durable, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is frequent on a host if more than this many documents hold it ...
MIN_LINE_DOCS = 10
#: ... and more than this percentage of the host's documents, or more than this many whatever their percentage.
LINE_DOCS_PERCENT, MAX_LINE_DOCS = 5, 1_000
#: A document is depleted if under this percentage of the words of its distinct lines is left.
MIN_LEFT_PERCENT = 30
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
NO_SPACE = r"[^\x20\x09-\x0D]"


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words(F.col(text)))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("_w", F.transform("_w", lambda x: F.xxhash64(x)))
    w = F.col("_w")
    # Each word is hashed once; a window is the hash of three numbers.
    windows = F.when(F.col("n_words") >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", windows).drop("_w")
    # Most documents repeat no window: only the others sort their windows.
    df = df.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")))
    df = df.withColumn("_s", F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).drop("_h")
    s = F.col("_s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("_s")
    p = F.col("_p")
    reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")
    df = df.withColumn("_l", _lines_with_words(t))
    df = (
        df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_symbols", (F.size(F.split(t, f"[{SYMBOLS}]")) - 1).cast("long"))
        .drop("_l")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Behind a generator, no filter on a metric is pushed down and its expressions repeated for every reference.
    return df.withColumn("base_failed", failed).select(*docs.columns, F.inline(F.array(F.struct(*METRICS))))


def line_losses(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    *,
    min_docs: int = MIN_LINE_DOCS,
    percent: int = LINE_DOCS_PERCENT,
    max_docs: int = MAX_LINE_DOCS,
) -> DataFrame:
    """For each distinct (host, text): the words of its distinct lines, those of its frequent lines, and the
    hashes of the frequent lines: (_host, _text, line_words, lost_words, lost_lines)."""
    keyed = docs.select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.xxhash64(F.col(text)).alias("_text"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = keyed.select(
        "_host",
        "_text",
        F.explode(F.array_distinct(F.transform(_lines_with_words(F.col("_t")), lambda x: F.struct(_line_hash(x).alias("h"), F.size(words(x)).alias("w"))))).alias("l"),
    ).select("_host", "_text", "l.h", "l.w")
    lines = durable(lines.groupBy("_host", "_text", "h").agg(F.max("w").alias("w")))  # read twice
    per_host = keyed.groupBy("_host").agg(F.countDistinct("_text").alias("n_docs"))
    counts = lines.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") > min_docs).join(per_host, "_host").filter((100 * F.col("n") > percent * F.col("n_docs")) | (F.col("n") > max_docs)).select("_host", "h", F.lit(True).alias("lost"))
    return (
        lines.join(frequent, ["_host", "h"], "left")
        .groupBy("_host", "_text")
        .agg(
            F.sum("w").alias("line_words"),
            F.sum(F.when(F.col("lost"), F.col("w")).otherwise(0)).alias("lost_words"),
            F.collect_list(F.when(F.col("lost"), F.col("h"))).alias("lost_lines"),
        )
    )


def _judged(own: DataFrame, keep: list[str], losses: DataFrame) -> DataFrame:
    """The columns ``keep`` of (source, text, ...) with all metrics, the losses and the verdict."""
    base = base_metrics(own).select(*keep, F.coalesce("source", F.lit("")).alias("_host"), F.xxhash64("text").alias("_text"), *METRICS)
    df = base.join(losses, ["_host", "_text"], "left")
    depleted = F.coalesce(100 * (F.col("line_words") - F.col("lost_words")) < MIN_LEFT_PERCENT * F.col("line_words"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: its base metrics, the words it loses with frequent lines, and the verdict."""
    own = docs.select(F.col(id_col), F.col(host).alias("source"), F.col(text).alias("text"))
    df = _judged(own, [id_col], line_losses(own).drop("lost_lines"))
    return df.select(id_col, *METRICS, F.coalesce("line_words", F.lit(0)).alias("line_words"), F.coalesce("lost_words", F.lit(0)).alias("lost_words"), "kept")


def clean_documents(docs: DataFrame, *, host: str = "source", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents that pass, without their frequent lines; the columns stay the same."""
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), F.col(host).alias("source"), F.col(text).alias("text"))
    kept = _judged(own, ["row"], line_losses(own)).filter("kept").select("row", "lost_lines")
    lost, t = F.col("lost_lines"), F.col("row")[text]
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(lost, _line_hash(x))), "\n")
    kept = kept.select("row", F.when(F.size(lost) > 0, left).otherwise(t).alias("clean"))
    new = {text: F.col("clean")}
    if n_chars in names:
        new[n_chars] = F.length("clean").cast(dict(docs.dtypes)[n_chars])
    return kept.select(*(new.get(n, F.col("row")[n]).alias(n) for n in names))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
  FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i+2], 'string_agg', ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, host, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
ln AS (SELECT DISTINCT host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
       FROM d, unnest(l) AS u(x)),
lw AS (SELECT *, len(list_filter(string_split(h, ' '), lambda w: w <> '')) AS w FROM ln),
n AS (SELECT host, count(DISTINCT t) AS n_docs FROM d GROUP BY host),
c AS (SELECT host, h FROM lw JOIN n USING (host) GROUP BY host, h, n_docs
      HAVING count(*) > {MIN_LINE_DOCS} AND (100 * count(*) > {LINE_DOCS_PERCENT} * n_docs OR count(*) > {MAX_LINE_DOCS})),
loss AS (SELECT lw.host, lw.t, sum(w) AS line_words, sum(CASE WHEN c.h IS NOT NULL THEN w ELSE 0 END) AS lost_words
         FROM lw LEFT JOIN c ON lw.host = c.host AND lw.h = c.h GROUP BY lw.host, lw.t),
j AS (SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             CAST(coalesce(line_words, 0) AS BIGINT) AS line_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM base LEFT JOIN loss USING (host, t))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, lost_words,
       NOT base_failed AND NOT (100 * (line_words - lost_words) < {MIN_LEFT_PERCENT} * line_words) AS kept
FROM j
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": OP5_SQL}
