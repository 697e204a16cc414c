"""Registered queries (name -> function of session and table folder) and their SQL counterparts.

Tables hold no DNA: queries on DNA map the letters of ``benchmark`` to bases by a fixed alphabet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import sequences as S
from weft.operators import analytics as A
from weft.operators import batch, factorize, planning
from weft.sources import factorfile, fasta

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
GROUPS = 8
GRID_LENGTH, GRID_BINS = 512, 8
SEED = 7
#: Real factors that may be expected beyond the length threshold by chance.
THRESHOLD = 10.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt out for a kernel that costs more than a shuffle; others as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(4 * cores) if scan.rdd.getNumPartitions() < cores else scan


def _texts(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _dna(spark, d):
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES)
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), seq.alias("seq"))


def _grouped_dna(spark, d):
    return _dna(spark, d).withColumn("grp", F.col("id") % GROUPS)


def _factors(spark, d):
    return factorize.factorize(_texts(spark, d), "id", "text")


def _rc(spark, d, mode="exact"):
    return factorize.factorize_dna_rc(_dna(spark, d), "id", "seq", mode=mode)


def _multi(spark, d):
    return factorize.factorize_multiple(_grouped_dna(spark, d), "grp", "id", "seq", with_rc=False)


def _plain(df):
    return df.select("id", "start", "length", "ref")


def _doc_counts(spark, d):
    docs = _spread(_read(spark, d, "documents").select("doc_id", "lang", "text"))
    docs = factorize.count_factors(docs.withColumn("n_bytes", F.octet_length("text").cast("long")), "text")
    return docs.select("doc_id", "lang", "n_bytes", "n_factors")


def _sizes(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))


def _shuffled(spark, d):
    return factorize.factorize(A.shuffle_texts(_texts(spark, d), "id", "text", SEED), "id", "text")


def _controlled(spark, d):
    """Factors of all items, and those of all items shuffled."""
    return _factors(spark, d), _shuffled(spark, d)


def _curve(spark, d):
    real, control = _controlled(spark, d)
    return A.significance_curve(real, control)


def _rarity(spark, d):
    real, control = _controlled(spark, d)
    return A.rarity_scores(real, A.significance_curve(real, control)).select("id", "start", "length", F.round("rarity", 9).alias("rarity"))


def _p_any(spark, d):
    real, control = _controlled(spark, d)
    n = real.agg(F.count(F.lit(1)).alias("n_real"))
    return A.significance_curve(real, control).crossJoin(F.broadcast(n)).select("length", F.round(A.p_any_ge(F.col("s0"), F.col("n_real")), 9).alias("p_any_ge"))


def _reference(spark, d):
    """Item 0 is the reference of all others."""
    t = _texts(spark, d)
    ref = t.filter("id = 0").first()["text"]
    return factorize.factorize_with_reference(t.filter("id <> 0"), ref, "id", "text").select("id", "start", "length", "ref", "target_start")


def _dna_reference(spark, d):
    t = _dna(spark, d)
    ref = t.filter("id = 0").first()["seq"]
    return factorize.factorize_dna_with_reference(t.filter("id <> 0"), ref, "id", "seq", mode="exact").select("id", "start", "length", "ref", "is_rc")


def _sql_udtf(spark, d):
    S.register_sql(spark)
    _texts(spark, d).createOrReplaceTempView("weft_texts")
    return spark.sql("SELECT t.id, f.start, f.length, f.ref FROM weft_texts t, LATERAL lz_factors(t.text) f")


def _boundaries(spark, d):
    return A.sequence_boundaries(_multi(spark, d), "grp")


def _grid(spark, d):
    """Cells are as wide as those of GRID_BINS over GRID_LENGTH; a longer sequence gets more of them."""
    longest = _dna(spark, d).agg(F.max(F.length("seq"))).first()[0] or 0
    width = GRID_LENGTH // GRID_BINS
    bins = max(GRID_BINS, -(-longest // width))
    g = A.strand_bias_grid(_rc(spark, d), bins * width, bins)
    return g.select("y_bin", "x_bin", F.round("forward", 6).alias("forward"), F.round("rc", 6).alias("rc"), F.round("bias", 6).alias("bias"))


def _prepare(with_rc):
    def query(spark, d):
        p = S.prepare_sequences(_grouped_dna(spark, d), "grp", "id", "seq", with_rc=with_rc)
        return p.select("grp", "n_sequences", "prepared_length", "original_length", F.array_join("sentinel_positions", ",").alias("sentinels"))

    return query


def _trend(spark, d):
    own = _doc_counts(spark, d).filter("n_bytes > 0")
    t = planning.fit_trend(own, "n_bytes", "n_factors", "lang")
    return t.select("lang", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r_squared", 6).alias("r_squared"))


def _estimate(spark, d):
    e = planning.estimate_fallback(_sizes(spark, d), "size", threads=4)
    return e.select("doc_id", F.col("n_symbols").cast("long").alias("n_symbols"), F.round("seconds", 9).alias("seconds"), F.round("memory_mb", 6).alias("memory_mb"), F.round("disk_mb", 6).alias("disk_mb"), "cluster_memory_gb")


def _shuffle_composition(spark, d):
    """Characters of the shuffled texts: as many of each as before."""
    return S.alphabet_counts(A.shuffle_texts(_texts(spark, d), "id", "text", SEED), "id", "text").select("id", "character", "n")


def _round_trip(spark, d):
    """FASTA files of the groups, factorized as a batch into factor files, and these read back."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{shared.rstrip('/')}/weft-batch-{uuid.uuid4().hex}"
    records = _grouped_dna(spark, d).selectExpr("grp AS file", "int(id) AS seq_idx", "string(id) AS seq_id", "concat(id, ' of ', grp) AS header", "seq")
    lines = fasta.format_fasta(records.filter("seq <> ''")).repartition("file").sortWithinPartitions("file", "seq_idx")
    lines.select("file", "value").write.partitionBy("file").text(f"{root}/in")
    out = root if "://" in root or root.startswith("file:") else f"file://{root}"
    out = out.replace("file:/", "file:///") if out.startswith("file:/") and not out.startswith("file://") else out
    done = batch.run_batch(spark, [f"{root}/in/*/*"], f"{out}/out", modes=batch.WITH_RC)
    leaf = lambda c: F.regexp_extract(c, r"([^/]+)\.bin$", 1)
    groups = done.select(leaf("output").alias("leaf"), F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("grp"))
    back = factorfile.read_factors(spark, f"{root}/out/*/*.bin").withColumn("leaf", leaf("file"))
    return back.join(groups, "leaf").select("grp", "start", "length", "ref", "is_rc", "is_sentinel")


def _invariants(spark, d):
    """Factors of every whole document: gap-free and as long as the text."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    f = factorize.factorize(_spread(docs), "doc_id", "text")
    got = f.groupBy("doc_id").agg(F.sum("length").alias("covered"))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(got, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("covered", F.lit(0)).alias("covered"))


QUERIES: dict = {
    "lz_factors_text": lambda s, d: _plain(_factors(s, d)),
    "lz_factors_sql": _sql_udtf,
    "lz_count_text": lambda s, d: factorize.count_factors(_texts(s, d), "text").select("id", "n_factors"),
    "lz_factors_from_start": lambda s, d: _plain(factorize.factorize(_texts(s, d), "id", "text", start_pos=10)),
    "lz_factors_reference": _reference,
    "lz_literals": lambda s, d: A.literals(_factors(s, d)).select("id", "start"),
    "lz_factor_length_hist": lambda s, d: A.length_histogram(_factors(s, d)),
    "lz_cumulative": lambda s, d: A.cumulative(_factors(s, d), "id"),
    "lz_ccdf": lambda s, d: A.ccdf(_factors(s, d)).select("length", "n_ge", F.round("share", 9).alias("share")),
    "lz_min_length_filter": lambda s, d: _plain(A.min_length_filter(_factors(s, d), 4)),
    "lz_complexity_by_lang": lambda s, d: A.complexity(_doc_counts(s, d), "lang"),
    "lz_document_coverage": _invariants,
    "dna_revcomp": lambda s, d: _dna(s, d).select("id", S.revcomp(F.col("seq")).alias("rc")),
    "dna_sanitize": lambda s, d: _read(s, d, "documents").select("doc_id", S.sanitize_dna(F.col("text")).alias("seq")),
    "dna_sequence_type": lambda s, d: _read(s, d, "part").select("p_partkey", S.sequence_type(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("type"), S.is_dna(F.col("p_name")).alias("is_dna"), S.is_protein(F.col("p_name")).alias("is_protein")),
    "dna_prepare_no_rc": _prepare(False),
    "dna_prepare_w_rc": _prepare(True),
    "dna_rc_factors_exact": lambda s, d: _rc(s, d).select("id", "start", "length", "ref", "is_rc"),
    "dna_rc_factors_parity": lambda s, d: _rc(s, d, "reference").select("id", "start", "length", "ref", "is_rc"),
    "dna_rc_count": lambda s, d: factorize.count_factors_dna_rc(_dna(s, d), "seq", mode="exact").select("id", "n_factors"),
    "dna_rc_factors_reference": _dna_reference,
    "dna_complexity_table": lambda s, d: batch.complexity_table(_dna(s, d).selectExpr("string(id) AS seq_id", "concat('item ', id) AS header", "seq"), rc_mode="exact"),
    "dna_shuffle_analysis": lambda s, d: batch.shuffle_analysis(_dna(s, d).selectExpr("'benchmark' AS file", "int(id) AS seq_idx", "string(id) AS seq_id", "seq"), seed=SEED),
    "multi_seq_factors": lambda s, d: _multi(s, d).select("grp", "start", "length", "ref", "seq_idx", "is_sentinel"),
    "sentinel_rows": lambda s, d: _multi(s, d).filter("is_sentinel").select("grp", "start", "seq_idx"),
    "sequence_boundaries": _boundaries,
    "per_sequence_counts": lambda s, d: A.per_sequence_counts(_multi(s, d), "grp").fillna(-1, ["seq_idx"]),
    "multi_seq_rc_factors": lambda s, d: factorize.factorize_multiple(_grouped_dna(s, d), "grp", "id", "seq").select("grp", "start", "length", "ref", "is_rc", "seq_idx", "is_sentinel"),
    "fasta_batch_round_trip": _round_trip,
    "alphabet_profile": lambda s, d: S.alphabet_profile(_read(s, d, "documents"), "doc_id", "text").select("doc_id", "size", F.round("entropy", 9).alias("entropy"), "total_length"),
    "alphabet_top10": lambda s, d: S.alphabet_top(_read(s, d, "documents"), "doc_id", "text"),
    "segments_self_plot": lambda s, d: A.segments(_rc(s, d), "id"),
    "strand_bias_grid": _grid,
    "space_scale_heatmap": lambda s, d: A.space_scale_heatmap(_rc(s, d)).select("length_bin", "position_bin", "is_rc", "n", F.round("weighted", 6).alias("weighted")),
    "significance_curve": lambda s, d: _curve(s, d).select("length", F.round("s0", 9).alias("s0"), F.round("s0_upper", 9).alias("s0_upper"), F.round("expected_fp", 6).alias("expected_fp")),
    "significance_tail": lambda s, d: _curve(s, d).select("length", F.round("s0", 9).alias("s0")),
    "length_threshold": lambda s, d: A.length_threshold(_curve(s, d), THRESHOLD),
    "rarity_scores": _rarity,
    "p_any_ge": _p_any,
    "shuffle_composition": _shuffle_composition,
    "resource_estimate": _estimate,
    "thread_decision": lambda s, d: _sizes(s, d).select("doc_id", planning.thread_decision(F.col("size") * 100, 16).alias("threads")),
    "trend_fit": _trend,
    "skip_existing_antijoin": lambda s, d: _read(s, d, "documents").select("doc_id").join(_read(s, d, "labels"), "doc_id", "left_anti"),
}

_BASE = """WITH RECURSIVE t AS ({texts}),
f AS (
 SELECT id, s, CAST(i0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS ref FROM t
 UNION ALL
 SELECT id, s, np, greatest(L, 1), CASE WHEN L > 0 THEN instr(s, substr(s, np + 1, L)) - 1 ELSE np END
 FROM (SELECT id, s, start + length AS np,
   coalesce(list_max(list_filter(range(1, least(start + length, length(s) - (start + length)) + 1),
     lambda k: contains(left(s, start + length), substr(s, start + length + 1, k)))), 0) AS L
   FROM f WHERE start + length < length(s))),
factors AS (SELECT id, start, length, ref FROM f WHERE length > 0)"""


#: The text with a character for each byte of its UTF-8 form, as offsets are bytes.
_BYTES = "array_to_string(list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), '')"


def _base(texts: str = f"SELECT item_id AS id, {_BYTES.format(t='text')} AS s, 0 AS i0 FROM benchmark") -> str:
    return _BASE.replace("{texts}", texts)


_DNA = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
_RC = f"""WITH RECURSIVE t AS ({{texts}}),
f AS (
 SELECT id, s, CAST(i0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS ref, false AS is_rc FROM t
 UNION ALL
 SELECT id, s, i,
   CASE WHEN lf >= 1 AND lr <= lf THEN lf WHEN lf >= 1 OR lr > 1 THEN lr ELSE 1 END,
   CASE WHEN lf >= 1 AND lr <= lf THEN instr(s, substr(s, i + 1, lf)) - 1
        WHEN lf >= 1 OR lr > 1 THEN instr(s, translate(reverse(substr(s, i + 1, lr)), 'ACGT', 'TGCA')) - 1 ELSE i END,
   NOT (lf >= 1 AND lr <= lf) AND (lf >= 1 OR lr > 1)
 FROM (SELECT id, s, start + length AS i,
   coalesce(list_max(list_filter(range(1, least(start + length, length(s) - (start + length)) + 1),
     lambda k: contains(left(s, start + length), substr(s, start + length + 1, k)))), 0) AS lf,
   coalesce(list_max(list_filter(range(1, least(start + length, length(s) - (start + length)) + 1),
     lambda k: contains(left(s, start + length), translate(reverse(substr(s, start + length + 1, k)), 'ACGT', 'TGCA')))), 0) AS lr
   FROM f WHERE start + length < length(s))),
factors AS (SELECT id, start, length, ref, is_rc FROM f WHERE length > 0)"""


def _rc_sql(texts: str = f"SELECT item_id AS id, {_DNA} AS s, 0 AS i0 FROM benchmark") -> str:
    return _RC.replace("{texts}", texts)

#: The forward rule of mode "reference": the longest match at a length after which the work string w branches, extended.
_PARITY = """WITH RECURSIVE t2 AS ({texts}),
f AS (
 SELECT id, s, w, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS ref, false AS is_rc FROM t2
 UNION ALL
 SELECT id, s, w, i, CASE WHEN fl >= 1 AND lr <= fl THEN fl WHEN fl >= 1 OR lr > 1 THEN lr ELSE 1 END,
   CASE WHEN fl >= 1 AND lr <= fl THEN fr
        WHEN fl >= 1 OR lr > 1 THEN instr(s, translate(reverse(substr(s, i + 1, lr)), 'ACGT', 'TGCA')) - 1 ELSE i END,
   NOT (fl >= 1 AND lr <= fl) AND (fl >= 1 OR lr > 1)
 FROM (SELECT *, CASE WHEN ds = 0 THEN 0 ELSE list_max(list_filter(range(ds, least(i - fr, length(s) - i) + 1),
         lambda k: substr(s, i + 1, k) = substr(s, fr + 1, k))) END AS fl
  FROM (SELECT *, instr(s, substr(s, i + 1, ds)) - 1 AS fr
   FROM (SELECT *, coalesce(list_max(list_filter(range(1, lf + 1), lambda d: list_unique(list_transform(
            list_filter(range(1, length(w) - d + 1), lambda p: substr(w, p, d) = substr(s, i + 1, d)),
            lambda p: substr(w, p + d, 1))) >= 2)), 0) AS ds
    FROM (SELECT id, s, w, start + length AS i,
      coalesce(list_max(list_filter(range(1, least(start + length, length(s) - (start + length)) + 1),
        lambda k: contains(left(s, start + length), substr(s, start + length + 1, k)))), 0) AS lf,
      coalesce(list_max(list_filter(range(1, least(start + length, length(s) - (start + length)) + 1),
        lambda k: contains(left(s, start + length), translate(reverse(substr(s, start + length + 1, k)), 'ACGT', 'TGCA')))), 0) AS lr
      FROM f WHERE start + length < length(s)))))),
factors AS (SELECT id, start, length, ref, is_rc FROM f WHERE length > 0)"""
_WORK = "SELECT id, s, s || '$' || translate(reverse(s), 'ACGT', 'TGCA') || '#' AS w FROM ({dna})"


def _parity(texts: str = _WORK.format(dna=f"SELECT item_id AS id, {_DNA} AS s FROM benchmark")) -> str:
    return _PARITY.replace("{texts}", texts)


def _shuffled_sql(text: str) -> str:
    """(id, text): the items' texts with their characters in the order of the registered shuffle."""
    return f"""SELECT item_id AS id, string_agg(c, '' ORDER BY md5(concat('{SEED}:', item_id, ':', i)), i) AS text
      FROM (SELECT item_id, unnest(string_split(x, '')) AS c, unnest(range(0, length(x))) AS i FROM (SELECT item_id, {text} AS x FROM benchmark) WHERE length(x) > 0) GROUP BY item_id"""


#: Sequences of a group and, in reverse order, their reverse complements, each closed by a code point of its own.
_MULTI_WORK = f"""SELECT grp AS id, left(fw, length(fw) - 1) AS s, fw || rv AS w FROM (
  SELECT grp, string_agg(seq || chr(CAST(1000 + k AS INT)), '' ORDER BY k) AS fw, string_agg(translate(reverse(seq), 'ACGT', 'TGCA') || chr(CAST(2000 + k AS INT)), '' ORDER BY k DESC) AS rv
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS k FROM (
    SELECT item_id, item_id % {GROUPS} AS grp, {_DNA} AS seq FROM benchmark) WHERE length(seq) > 0) GROUP BY grp)"""
_MULTI_RC = f"{_parity(_MULTI_WORK)} SELECT id AS grp, start, length, ref, is_rc, CAST(len(regexp_extract_all(left(s, start), '[^ACGT]')) AS INT) AS seq_idx, NOT regexp_matches(substr(s, start + 1, 1), '[ACGT]') AS is_sentinel FROM factors JOIN t2 USING (id)"

# Sentinels are unlike everything else: code points from 1000 up, one for each boundary.
_MULTI = _base(
    f"""SELECT grp AS id, string_agg(CASE WHEN k = 1 THEN '' ELSE chr(CAST(998 + k AS INT)) END || seq, '' ORDER BY item_id) AS s, 0 AS i0
    FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS k FROM (
      SELECT item_id, item_id % {GROUPS} AS grp, {_DNA} AS seq FROM benchmark) WHERE length(seq) > 0) GROUP BY grp"""
) + """,
multi AS (SELECT id AS grp, start, length, ref, CAST(len(regexp_extract_all(left(s, start), '[^ACGT]')) AS INT) AS seq_idx,
  NOT regexp_matches(substr(s, start + 1, 1), '[ACGT]') AS is_sentinel FROM factors JOIN t USING (id))"""
#: Factors of all items (real) and of all items shuffled (ctl), and the tail of the latter.
_CURVE = f""", real AS (SELECT * FROM factors), ctl AS ({_base(f"SELECT id, {_BYTES.format(t='text')} AS s, 0 AS i0 FROM ({_shuffled_sql('text')})")} SELECT * FROM factors),
cnt AS (SELECT length, count(*) AS c FROM ctl GROUP BY length),
curve AS (SELECT length, CAST(sum(c) OVER (ORDER BY length DESC) AS BIGINT) AS k, (SELECT count(*) FROM ctl) AS n, sum(c) OVER (ORDER BY length DESC) / (SELECT count(*) FROM ctl) AS s0 FROM cnt)"""
#: The bound p of k of n solves P(X <= k) = 0.05, found by halving.
_BOUND = """, halved AS (
 SELECT length, k, n, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS turn FROM curve WHERE k < n
 UNION ALL
 SELECT length, k, n, CASE WHEN cdf > 0.05 THEN mid ELSE lo END, CASE WHEN cdf > 0.05 THEN hi ELSE mid END, turn + 1
 FROM (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid)))) AS cdf
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE turn < 50))),
bound AS (SELECT length, s0, coalesce((h.lo + h.hi) / 2, 1.0) AS s0_upper, (SELECT count(*) FROM real) AS n_real FROM curve LEFT JOIN (SELECT length, lo, hi FROM halved WHERE turn = 50) h USING (length))"""
_GROUPED = f"SELECT item_id % {GROUPS} AS grp, item_id, length({_DNA}) AS n FROM benchmark"


def _prepare_sql(rc: bool) -> str:
    half = "sum(n) + count(*)"
    positions = "list(e - 1 ORDER BY item_id)" if rc else "list(e - 1 ORDER BY item_id)[:-2]"
    return f"""SELECT grp, count(*) AS n_sequences, CAST({'2 * (' + half + ')' if rc else half + ' - 1'} AS BIGINT) AS prepared_length,
      CAST({half}{'' if rc else ' - 1'} AS BIGINT) AS original_length, coalesce(array_to_string({positions}, ','), '') AS sentinels
      FROM (SELECT *, CAST(sum(n + 1) OVER (PARTITION BY grp ORDER BY item_id) AS BIGINT) AS e FROM ({_GROUPED}) WHERE n > 0) GROUP BY grp"""


_CHARS = """SELECT {id} AS id, c AS character, count(*) AS n, min(i) - 1 AS first_at
  FROM (SELECT {id}, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM {table} WHERE length(text) > 0) GROUP BY 1, 2"""
_GRID_SQL = f"""{_rc_sql()},
w AS (SELECT *, {GRID_LENGTH / GRID_BINS} AS w FROM factors),
cut AS (
  SELECT id, start, length, ref, is_rc, w, unnest(list_sort(list_distinct(list_filter(list_concat(
    [CAST(start AS DOUBLE), CAST(start + length AS DOUBLE)],
    list_concat(list_transform(range(0, {GRID_BINS + 1}), lambda k: CAST(k * w AS DOUBLE)),
      list_transform(range(0, {GRID_BINS + 1}), lambda k: CAST(CASE WHEN is_rc THEN start + ref + length - k * w ELSE start + k * w - ref END AS DOUBLE)))),
    lambda c: c >= start AND c <= start + length)))) AS a FROM w),
part AS (SELECT *, lead(a) OVER (PARTITION BY id, start ORDER BY a) AS b FROM cut),
cell AS (SELECT CAST(floor((CASE WHEN is_rc THEN ref + length - ((a + b) / 2 - start) ELSE ref + ((a + b) / 2 - start) END) / w) AS INT) AS y_bin,
  CAST(floor((a + b) / 2 / w) AS INT) AS x_bin, is_rc, b - a AS bp FROM part WHERE b IS NOT NULL),
grid AS (SELECT y_bin, x_bin, sum(CASE WHEN is_rc THEN 0.0 ELSE bp END) AS forward, sum(CASE WHEN is_rc THEN bp ELSE 0.0 END) AS rc
  FROM cell WHERE x_bin BETWEEN 0 AND {GRID_BINS - 1} AND y_bin BETWEEN 0 AND {GRID_BINS - 1} GROUP BY 1, 2)
SELECT y_bin, x_bin, round(CAST(forward AS DOUBLE), 6) AS forward, round(CAST(rc AS DOUBLE), 6) AS rc,
  round(log2((forward / (SELECT sum(forward) FROM grid) + 1e-9) / (rc / (SELECT sum(rc) FROM grid) + 1e-9)), 6) AS bias FROM grid"""
_HEAT_SQL = f"""{_rc_sql()},
m AS (SELECT floor(log2(greatest(1, min(length)))) AS lo, ceil(log2(max(length))) AS hi, max(start) AS far FROM factors),
b AS (SELECT k, pow(2, lo + (hi - lo) * k / n) AS edge, sqrt(pow(2, lo + (hi - lo) * k / n) * pow(2, lo + (hi - lo) * (k + 1) / n)) AS center, n
      FROM (SELECT *, CAST(greatest(1, (hi - lo) * 4) AS INT) AS n, unnest(range(0, CAST(greatest(1, (hi - lo) * 4) AS INT) + 1)) AS k FROM m)),
cell AS (SELECT CAST(least((SELECT count(*) FROM b WHERE edge <= length) - 1, (SELECT max(n) FROM b) - 1) AS INT) AS length_bin,
                CAST(least(floor(start / ((SELECT far FROM m) / 50)), 49) AS INT) AS position_bin, is_rc FROM factors),
h AS (SELECT length_bin, position_bin, is_rc, count(*) AS n FROM cell GROUP BY 1, 2, 3),
c AS (SELECT is_rc, length, sum(count(*)) OVER (PARTITION BY is_rc ORDER BY length DESC) / sum(count(*)) OVER (PARTITION BY is_rc) AS share FROM factors GROUP BY 1, 2),
near AS (SELECT is_rc, k, arg_min(share, (abs(length - center), length)) AS share FROM c, b WHERE k < n GROUP BY 1, 2)
SELECT length_bin, position_bin, h.is_rc, h.n, round(h.n / share, 6) AS weighted FROM h JOIN near ON near.k = length_bin AND near.is_rc = h.is_rc"""

ORACLES: dict[str, str] = {
    "space_scale_heatmap": _HEAT_SQL,
    "lz_factors_text": f"{_base()} SELECT * FROM factors",
    "lz_factors_sql": f"{_base()} SELECT * FROM factors",
    "lz_count_text": f"{_base()} SELECT id, count(*) AS n_factors FROM factors GROUP BY id",
    "lz_factors_from_start": f"{_base(f"SELECT item_id AS id, {_BYTES.format(t='text')} AS s, 10 AS i0 FROM benchmark")} SELECT * FROM factors",
    "lz_factors_reference": _base(f"SELECT b.item_id AS id, {_BYTES.format(t='r.text || chr(1) || b.text')} AS s, strlen(r.text) + 1 AS i0 FROM benchmark b, (SELECT text FROM benchmark WHERE item_id = 0) r WHERE b.item_id <> 0")
    + " SELECT factors.*, start - i0 AS target_start FROM factors JOIN t USING (id)",
    "lz_literals": f"{_base()} SELECT id, start FROM factors WHERE ref = start",
    "lz_factor_length_hist": f"{_base()} SELECT length, count(*) AS n FROM factors GROUP BY length",
    "lz_cumulative": f"{_base()} SELECT id, CAST(row_number() OVER w AS INT) AS ordinal, CAST(sum(length) OVER w AS BIGINT) AS cumulative_length FROM factors WINDOW w AS (PARTITION BY id ORDER BY start)",
    "lz_ccdf": f"{_base()} SELECT length, CAST(sum(count(*)) OVER (ORDER BY length DESC) AS BIGINT) AS n_ge, round(sum(count(*)) OVER (ORDER BY length DESC) / sum(count(*)) OVER (), 9) AS share FROM factors GROUP BY length",
    "lz_min_length_filter": f"{_base()} SELECT * FROM factors WHERE length >= 4",
    "lz_document_coverage": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(strlen(text) AS BIGINT) AS covered FROM documents",
    "dna_revcomp": f"SELECT item_id AS id, translate(reverse({_DNA}), 'ACGT', 'TGCA') AS rc FROM benchmark",
    "dna_sanitize": "SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents",
    "dna_sequence_type": f"""SELECT p_partkey, CASE WHEN regexp_matches(w, '^[ATGC]+$', 'i') THEN 'dna' WHEN regexp_matches(w, '^[{S.AMINO_ACIDS}]+$', 'i') THEN 'protein' ELSE 'text' END AS type,
        regexp_matches(p_name, '^[ATGC]+$', 'i') AS is_dna, regexp_matches(p_name, '^[A-Z]+$', 'i') AS is_protein FROM (SELECT *, replace(p_name, ' ', '') AS w FROM part)""",
    "dna_prepare_no_rc": _prepare_sql(False),
    "dna_prepare_w_rc": _prepare_sql(True),
    "dna_rc_factors_exact": f"{_rc_sql()} SELECT * FROM factors",
    "dna_rc_factors_parity": f"{_parity()} SELECT * FROM factors",
    "multi_seq_rc_factors": _MULTI_RC,
    "fasta_batch_round_trip": f"SELECT grp, start, length, ref, is_rc, is_sentinel FROM ({_MULTI_RC})",
    "dna_shuffle_analysis": f"""WITH a AS ({_parity()} SELECT id, count(*) AS c FROM factors GROUP BY id), b AS ({_parity(_WORK.format(dna=f'SELECT id, text AS s FROM ({_shuffled_sql(_DNA)})'))} SELECT id, count(*) AS c FROM factors GROUP BY id)
        SELECT 'benchmark' AS file, CAST(id AS VARCHAR) AS seq_id, a.c AS original, b.c AS shuffled, a.c / b.c AS ratio FROM a JOIN b USING (id)""",
    "dna_rc_count": f"{_rc_sql()} SELECT id, count(*) AS n_factors FROM factors GROUP BY id",
    "dna_rc_factors_reference": _rc_sql(f"SELECT b.item_id AS id, r.s || '$' || b.s AS s, length(r.s) + 1 AS i0 FROM (SELECT item_id, {_DNA} AS s FROM benchmark WHERE item_id <> 0) b, (SELECT {_DNA} AS s FROM benchmark WHERE item_id = 0) r")
    + " SELECT * FROM factors",
    "dna_complexity_table": f"{_rc_sql()}, n AS (SELECT id, count(*) AS c FROM factors GROUP BY id), g AS ({_base(f'SELECT item_id AS id, {_DNA} AS s, 0 AS i0 FROM benchmark')} SELECT id, count(*) AS c FROM factors GROUP BY id)"
    " SELECT CAST(t.id AS VARCHAR) AS sequence_id, 'item ' || t.id AS header, length(s) AS length, n.c AS complexity_w_rc, g.c AS complexity_no_rc FROM t JOIN n USING (id) JOIN g USING (id)",
    "multi_seq_factors": f"{_MULTI} SELECT * FROM multi",
    "sentinel_rows": f"{_MULTI} SELECT grp, start, seq_idx FROM multi WHERE is_sentinel",
    "sequence_boundaries": f'{_MULTI} SELECT grp, seq_idx, min(start) AS begin, coalesce(max(CASE WHEN is_sentinel THEN start END), max(start + length)) AS "end" FROM multi GROUP BY grp, seq_idx',
    "per_sequence_counts": f"{_MULTI} SELECT grp, coalesce(multi.seq_idx, -1) AS seq_idx, count(*) AS n_factors FROM multi WHERE NOT is_sentinel GROUP BY GROUPING SETS ((grp, multi.seq_idx), (grp))",
    "alphabet_profile": f"WITH c AS ({_CHARS.format(id='doc_id', table='documents')}), t AS (SELECT id, sum(n) AS total FROM c GROUP BY id)"
    " SELECT id AS doc_id, count(*) AS size, round(-sum(n / total * log2(n / total)), 9) AS entropy, CAST(any_value(total) AS BIGINT) AS total_length FROM c JOIN t USING (id) GROUP BY id",
    "alphabet_top10": f"SELECT id AS doc_id, CAST(row_number() OVER w AS INT) AS rank, character, n FROM ({_CHARS.format(id='doc_id', table='documents')}) WINDOW w AS (PARTITION BY id ORDER BY n DESC, first_at) QUALIFY row_number() OVER w <= 10",
    "segments_self_plot": f"{_rc_sql()} SELECT id, start AS x0, start + length AS x1, CASE WHEN is_rc THEN ref + length ELSE ref END AS y0, CASE WHEN is_rc THEN ref ELSE ref + length END AS y1, is_rc FROM factors",
    "strand_bias_grid": _GRID_SQL,
    "significance_curve": f"{_base()}{_CURVE}{_BOUND} SELECT length, round(s0, 9) AS s0, round(s0_upper, 9) AS s0_upper, round(n_real * s0_upper, 6) AS expected_fp FROM bound",
    "length_threshold": f"{_base()}{_CURVE}{_BOUND} SELECT min(length) AS l_star FROM bound WHERE n_real * s0_upper <= {THRESHOLD}",
    "significance_tail": f"{_base()}{_CURVE} SELECT length, round(s0, 9) AS s0 FROM curve",
    "rarity_scores": f"""{_base()}{_CURVE}, b AS (SELECT length AS lo, s0 AS s_lo, lead(length) OVER (ORDER BY length) AS hi, lead(s0) OVER (ORDER BY length) AS s_hi FROM curve)
        SELECT id, start, r.length, round(CASE WHEN r.length < (SELECT min(length) FROM curve) THEN 1.0 WHEN r.length > (SELECT max(length) FROM curve) THEN 0.0
          WHEN r.length = lo THEN s_lo ELSE s_lo + (s_hi - s_lo) * (r.length - lo) / (hi - lo) END, 9) AS rarity
        FROM real r LEFT JOIN b ON r.length >= lo AND (r.length < hi OR hi IS NULL)""",
    "p_any_ge": f"{_base()}{_CURVE} SELECT length, round(1 - exp(-(SELECT count(*) FROM real) * s0), 9) AS p_any_ge FROM curve",
    "shuffle_composition": f"SELECT id, character, n FROM ({_CHARS.format(id='item_id', table='benchmark')})",
    "resource_estimate": """SELECT doc_id, CAST(n AS BIGINT) AS n_symbols, round(n / 1000 * 0.0005 / 2.8, 9) AS seconds, round(n * 30 / 1048576 * 1.9, 6) AS memory_mb, round(size * 0.2 / 1048576, 6) AS disk_mb,
        CAST(CASE WHEN n * 30 / 1048576 * 1.9 / 1024 * 1.5 <= 2 THEN 2 ELSE 4 END AS INT) AS cluster_memory_gb
        FROM (SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS size, floor(CAST(strlen(text) AS DOUBLE) * 0.8) AS n FROM documents)""",
    "thread_decision": "SELECT doc_id, CAST(CASE WHEN n < 100000 THEN 1 WHEN n < 1000000 THEN 4 WHEN n < 10000000 THEN 8 ELSE 16 END AS INT) AS threads FROM (SELECT doc_id, strlen(text) * 100 AS n FROM documents)",
    "skip_existing_antijoin": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
}
