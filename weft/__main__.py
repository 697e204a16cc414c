"""spark-submit entry: factorize FASTA files, write their complexity tables, or the data of a factor file's plots."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import analytics, batch
from weft.sources import factorfile


def _factors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = analytics.min_length_filter(factorfile.read_factors(spark, a.inputs), a.min_length)
    if a.sequence is not None:
        ends = found.filter("is_sentinel").groupBy("file").agg(F.sort_array(F.collect_list("start")).alias("ends"))
        found = found.join(ends, "file", "left")
        found = found.withColumn("seq_idx", F.size(F.filter(F.coalesce("ends", F.array().cast("array<bigint>")), lambda e: e < F.col("start")))).drop("ends")
        return analytics.sequence_slice(found, a.sequence)
    return found.filter("NOT is_sentinel")


def _grid(found: DataFrame, a: argparse.Namespace) -> DataFrame:
    total = found.agg(F.max(F.col("start") + F.col("length"))).first()[0] or 1
    return analytics.strand_bias_grid(found, total, a.bins)


PLOTS = {
    "cumulative": lambda found, a: analytics.cumulative(found, "file").orderBy("file", "ordinal"),
    "ccdf": lambda found, a: analytics.ccdf(found, "file", "is_rc").orderBy("file", "is_rc", "length"),
    "segments": lambda found, a: analytics.segments(found, "file").orderBy("file", "x0"),
    "strand-bias": lambda found, a: _grid(found, a).orderBy("y_bin", "x_bin"),
    "space-scale": lambda found, a: analytics.space_scale_heatmap(found, bin_bp=a.bin_bp).orderBy("is_rc", "length_bin", "position_bin"),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    p.add_argument("task", choices=["factorize", "complexity", *PLOTS])
    p.add_argument("inputs", nargs="*", help="FASTA files, or for plots factor files")
    p.add_argument("--list", help="a file that lists inputs")
    p.add_argument("--out", required=True)
    p.add_argument("--mode", choices=list(batch.MODES), default="both")
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--per-sequence", action="store_true", help="factorize each record by itself")
    p.add_argument("--min-length", type=int, default=1, help="plots: leave out shorter factors")
    p.add_argument("--sequence", type=int, help="plots: one sequence of the files")
    p.add_argument("--bins", type=int, default=50, help="strand-bias: cells a side")
    p.add_argument("--bin-bp", type=int, default=1_000_000, help="space-scale: width of a position bin")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    a.inputs += [r["file"] for r in batch.read_file_list(spark, a.list).collect()] if a.list else []
    if not a.inputs:
        p.error("no inputs")
    if a.task in PLOTS:
        PLOTS[a.task](_factors(spark, a), a).write.mode("overwrite").csv(a.out, sep="\t", header=True)
        return 0
    if a.task == "complexity":
        done = batch.complexity_batch(spark, a.inputs, a.out)
    else:
        done = batch.run_batch(spark, a.inputs, a.out, modes=a.mode, skip=a.skip_existing, per_sequence=a.per_sequence)
    done.show(truncate=False)
    return int(done.filter("error IS NOT NULL").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
