"""Analytics over factor tables (id, factor_idx, start, length, ref, is_rc[, seq_idx, is_sentinel]).

Curves over distinct lengths are built from counts per length, so windows run over few rows however many factors
there are; per-document windows are keyed by the document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.statistics import clopper_pearson_upper_col


def min_length_filter(factors: DataFrame, least: int) -> DataFrame:
    """Factors of at least that length; sentinels stay."""
    keep = F.col("length") >= least
    return factors.filter(keep | F.col("is_sentinel") if "is_sentinel" in factors.columns else keep)


def sequence_slice(factors: DataFrame, index: int) -> DataFrame:
    """The factors of one sequence of a joined text, without sentinels."""
    return factors.filter((F.col("seq_idx") == index) & ~F.col("is_sentinel"))


def literals(factors: DataFrame) -> DataFrame:
    return factors.filter("ref = start AND length = 1 AND NOT is_rc")


def length_histogram(factors: DataFrame, *keys: str) -> DataFrame:
    return factors.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("n"))


def cumulative(factors: DataFrame, id_col: str) -> DataFrame:
    """(id, ordinal, cumulative_length): the running length over a document's factors, ordinals from 1."""
    w = Window.partitionBy(id_col).orderBy("start")
    return factors.select(id_col, F.row_number().over(w).alias("ordinal"), F.sum("length").over(w).alias("cumulative_length"))


def compare_cumulative(variants: dict[str, DataFrame], id_col: str) -> DataFrame:
    """The cumulative curves of several variants of the same documents, one below the other."""
    out = None
    for name, factors in variants.items():
        one = cumulative(factors, id_col).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ccdf(factors: DataFrame, *keys: str) -> DataFrame:
    """(keys, length, n_ge, share): how many and which share of factors have at least each length that occurs."""
    counts = length_histogram(factors, *keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n_ge = F.sum("n").over(w.orderBy(F.desc("length")))
    return counts.select(*keys, "length", n_ge.alias("n_ge"), (n_ge / F.sum("n").over(w)).alias("share"))


def segments(factors: DataFrame, id_col: str) -> DataFrame:
    """Line segments of a factor plot: x from start to end, y along the source, downwards for reverse complements."""
    end, far = F.col("start") + F.col("length"), F.col("ref") + F.col("length")
    return factors.select(
        id_col, F.col("start").alias("x0"), end.alias("x1"), F.when(F.col("is_rc"), far).otherwise(F.col("ref")).alias("y0"), F.when(F.col("is_rc"), F.col("ref")).otherwise(far).alias("y1"), "is_rc"
    )


def sequence_boundaries(factors: DataFrame, group: str) -> DataFrame:
    """(group, seq_idx, begin, end): the stretches between sentinels; the last ends with the last factor."""
    ends = factors.groupBy(group, "seq_idx").agg(F.max(F.when(F.col("is_sentinel"), F.col("start"))).alias("sentinel"), F.max(F.col("start") + F.col("length")).alias("last"), F.min("start").alias("begin"))
    return ends.select(group, "seq_idx", "begin", F.coalesce("sentinel", "last").alias("end"))


def per_sequence_counts(factors: DataFrame, group: str) -> DataFrame:
    """(group, seq_idx, n_factors) with totals where seq_idx is null, without sentinels."""
    own = factors.filter("NOT is_sentinel")
    out = own.rollup(group, "seq_idx").agg(F.count(F.lit(1)).alias("n_factors"), F.grouping(group).alias("g"))
    return out.filter("g = 0").select(group, "seq_idx", "n_factors")


def reference_extent(factors: DataFrame, id_col: str) -> DataFrame:
    return factors.groupBy(id_col).agg(F.min("start").alias("target_start"), F.max(F.col("start") + F.col("length")).alias("total_length"))


def complexity(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_documents, n_factors, total_length, density) from one row per document with n_factors and n_bytes."""
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_factors").alias("n_factors"), F.sum("n_bytes").alias("total_length"), (F.sum("n_factors") / F.sum("n_bytes")).alias("density")
    )


# -- significance -----------------------------------------------------------------------------------------------


def significance_curve(real: DataFrame, shuffled: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """(length, s0, s0_upper, expected_fp): the tail of the shuffled lengths at each length that occurs there, its
    upper confidence bound, and the real factors expected beyond it by chance."""
    n_real, n_shuffled = real.agg(F.count(F.lit(1)).alias("n_real")), shuffled.agg(F.count(F.lit(1)).alias("n_shuffled"))
    # Two rows of one number each.
    curve = ccdf(shuffled).crossJoin(F.broadcast(n_shuffled)).crossJoin(F.broadcast(n_real))
    upper = clopper_pearson_upper_col(F.col("n_ge"), F.col("n_shuffled"), alpha)
    return curve.withColumn("s0_upper", upper).select("length", F.col("share").alias("s0"), "s0_upper", (F.col("n_real") * F.col("s0_upper")).alias("expected_fp"))


def length_threshold(curve: DataFrame, tau: float = 1.0) -> DataFrame:
    """(l_star): the least length with at most ``tau`` expected false positives; null if there is none."""
    return curve.filter(F.col("expected_fp") <= tau).agg(F.min("length").alias("l_star"))


def rarity_scores(real: DataFrame, curve: DataFrame) -> DataFrame:
    """``real`` with ``rarity``: the curve's s0 at each length, interpolated; 1 before it, 0 beyond it.

    The curve becomes brackets, and is joined to the distinct real lengths only.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("length")
    brackets = curve.select(F.col("length").alias("lo"), F.col("s0").alias("s_lo"), F.lead("length").over(one).alias("hi"), F.lead("s0").over(one).alias("s_hi"))
    ends = curve.agg(F.min("length").alias("least"), F.max("length").alias("most"))
    lengths = real.select("length").distinct()
    at = lengths.join(brackets, (lengths["length"] >= brackets["lo"]) & ((lengths["length"] < brackets["hi"]) | brackets["hi"].isNull()), "left").crossJoin(F.broadcast(ends))
    part = F.col("s_lo") + (F.col("s_hi") - F.col("s_lo")) * (F.col("length") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rarity = F.when(F.col("length") < F.col("least"), 1.0).when(F.col("length") > F.col("most"), 0.0).when(F.col("length") == F.col("lo"), F.col("s_lo")).otherwise(part)
    return real.join(at.select("length", rarity.alias("rarity")), "length")


def p_any_ge(s0: Column, n_real: Column) -> Column:
    """Chance that any of n_real factors is as long, by the Poisson approximation."""
    return 1 - F.exp(-n_real * s0)


# -- grids ------------------------------------------------------------------------------------------------------


def strand_bias_grid(factors: DataFrame, total_length: float, x_bins: int = 50, y_bins: int | None = None) -> DataFrame:
    """(y_bin, x_bin, forward, rc, bias): bases per cell and strand; factors are split at the edges of cells.

    Only the edges a factor crosses are generated. bias is the log2 ratio of both strands' shares.
    """
    y_bins = y_bins or x_bins
    wx, wy = float(total_length) / x_bins, float(total_length) / y_bins
    s, n, r, rc = F.col("start").cast("double"), F.col("length").cast("double"), F.col("ref").cast("double"), F.col("is_rc")

    def crossed(lo: Column, width: float) -> Column:
        first, last = F.floor(lo / width) + 1, F.ceil((lo + n) / width) - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    x_cuts = F.transform(crossed(s, wx), lambda k: k * F.lit(wx))
    y_cuts = F.transform(crossed(r, wy), lambda k: F.when(rc, s + r + n - k * F.lit(wy)).otherwise(s + k * F.lit(wy) - r))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(s, s + n), F.filter(F.concat(x_cuts, y_cuts), lambda c: (c > s) & (c < s + n)))))
    parts = factors.withColumn("cuts", cuts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    a, b = F.get("cuts", F.col("k")), F.get("cuts", F.col("k") + 1)
    mid = (a + b) / 2
    mid_y = F.when(rc, r + n - (mid - s)).otherwise(r + (mid - s))
    cells = parts.select(F.floor(mid_y / wy).cast("int").alias("y_bin"), F.floor(mid / wx).cast("int").alias("x_bin"), "is_rc", (b - a).alias("bp")).filter(
        F.col("x_bin").between(0, x_bins - 1) & F.col("y_bin").between(0, y_bins - 1)
    )
    grid = cells.groupBy("y_bin", "x_bin").agg(F.sum(F.when(~rc, F.col("bp")).otherwise(0.0)).alias("forward"), F.sum(F.when(rc, F.col("bp")).otherwise(0.0)).alias("rc"))
    sums = grid.agg(F.sum("forward").alias("f"), F.sum("rc").alias("r"))
    share = lambda v, t: F.col(v) / F.when(F.col(t) > 0, F.col(t)).otherwise(1.0) + 1e-9
    # One row of two sums.
    return grid.crossJoin(F.broadcast(sums)).select("y_bin", "x_bin", "forward", "rc", F.log2(share("forward", "f") / share("rc", "r")).alias("bias"))


def space_scale_heatmap(factors: DataFrame, *, bin_bp: int = 1_000_000, base: float = 2.0, least_bins: int = 50, subdivisions: int = 4) -> DataFrame:
    """(length_bin, position_bin, is_rc, n, weighted): factors by length on a log scale and position, and their number
    over the share of factors at least as long as the occurring length nearest to the bin's centre.

    The last bin of either scale holds its upper edge. The driver sees the extent only.
    """
    lo, hi, far = factors.agg(F.min("length"), F.max("length"), F.max("start")).first()
    if lo is None:
        return factors.select(F.lit(0).alias("length_bin"), F.lit(0).alias("position_bin"), "is_rc", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("weighted"))
    positions = max(least_bins, math.ceil(far / bin_bp))
    low, high = math.floor(math.log(max(1, lo)) / math.log(base)), math.ceil(math.log(hi) / math.log(base))
    bins = max(1, (high - low) * subdivisions)
    edges = [base ** (low + (high - low) * k / bins) for k in range(bins + 1)]
    centers = [math.sqrt(a * b) for a, b in zip(edges, edges[1:])]
    width = far / positions if far else 1.0
    length_bin = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("length"))) - 1
    cells = factors.select(F.least(length_bin, F.lit(bins - 1)).alias("length_bin"), F.least(F.floor(F.col("start") / width), F.lit(positions - 1)).cast("int").alias("position_bin"), "is_rc", "length")
    cells = cells.filter("length_bin >= 0").groupBy("length_bin", "position_bin", "is_rc").agg(F.count(F.lit(1)).alias("n"))
    spark = factors.sparkSession
    middle = F.broadcast(spark.createDataFrame(list(enumerate(centers)), "length_bin int, center double"))  # a row per bin
    near = ccdf(factors, "is_rc").crossJoin(middle).groupBy("is_rc", "length_bin").agg(F.min_by("share", F.struct(F.abs(F.col("length") - F.col("center")), F.col("length"))).alias("share"))
    return cells.join(near, ["is_rc", "length_bin"]).select("length_bin", "position_bin", "is_rc", "n", (F.col("n") / F.col("share")).alias("weighted"))


# -- shuffled controls ------------------------------------------------------------------------------------------


def shuffle_texts(df: DataFrame, id_col: str, text: str, seed: int = 0) -> DataFrame:
    """``df`` with each text's characters in a random order that a digest of seed, id and position decides; composition stays."""
    chars = F.transform(F.filter(F.split(F.col(text), ""), lambda c: c != ""), lambda c, k: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), k.cast("string"))).alias("h"), k.alias("k"), c.alias("c")))
    return df.withColumn(text, F.array_join(F.transform(F.array_sort(chars), lambda x: x["c"]), ""))
