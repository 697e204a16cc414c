"""Factorization as DataFrame operators.

Texts go to the kernels in Arrow batches, factors come back as columns. Everything before and after is built-in
expressions, so filters on documents run before the kernel and only the columns it needs reach it. Offsets are bytes
of the UTF-8 text.

Factor tables: (id, factor_idx, start, length, ref, is_rc); a literal is a factor with ref = start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import kernel

FACTOR_FIELDS = "factor_idx int, start long, length long, ref long, is_rc boolean"
#: Factors in one batch sent back.
BATCH_FACTORS = 100_000


def _emit(batches: Iterable[pa.RecordBatch], id_col: str, parse: Callable[[Any], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows (id, data) to factor rows, in batches of bounded size but for the factors of one text."""

    def batch(ids: pa.Array, rows: list[int], factors: list[tuple], index: list[int]) -> pa.RecordBatch:
        cols = list(zip(*factors))
        rc = pa.array(cols[3], pa.bool_()) if len(cols) > 3 else pa.array(np.zeros(len(rows), bool))
        return pa.record_batch(
            {id_col: ids.take(pa.array(rows, pa.int64())), "factor_idx": pa.array(index, pa.int32()), "start": pa.array(cols[0], pa.int64()), "length": pa.array(cols[1], pa.int64()), "ref": pa.array(cols[2], pa.int64()), "is_rc": rc}
        )

    for b in batches:
        rows: list[int] = []
        factors: list[tuple] = []
        index: list[int] = []
        for i, data in enumerate(b.column("data").to_pylist()):
            if data is None:
                continue
            before = len(factors)
            factors += parse(data)
            rows += [i] * (len(factors) - before)
            index += range(len(factors) - before)
            if len(factors) >= BATCH_FACTORS:
                yield batch(b.column(id_col), rows, factors, index)
                rows, factors, index = [], [], []
        if factors:
            yield batch(b.column(id_col), rows, factors, index)


def _emit_plain(batches: Iterable[pa.RecordBatch], id_col: str, start: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, data) to the factor rows of plain parses, many texts at a time."""
    for b in batches:
        texts = b.column("data").to_pylist()
        for of, at, size, ref in kernel.lz_tables(texts, start):
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            index = np.arange(len(of)) - np.repeat(edge, np.diff(edge, append=len(of)))
            for k in range(0, len(of), BATCH_FACTORS):
                cut = slice(k, k + BATCH_FACTORS)
                n = len(of[cut])
                yield pa.record_batch(
                    {id_col: b.column(id_col).take(pa.array(of[cut])), "factor_idx": pa.array(index[cut], pa.int32()), "start": pa.array(at[cut]), "length": pa.array(size[cut]), "ref": pa.array(ref[cut]), "is_rc": pa.array(np.zeros(n, bool))}
                )


def _plain_rows(df: DataFrame, id_col: str, data: Column, start: int = 0) -> DataFrame:
    own = df.select(F.col(id_col), data.alias("data"))
    return own.mapInArrow(lambda batches: _emit_plain(batches, id_col, start), f"`{id_col}` {dict(df.dtypes)[id_col]}, {FACTOR_FIELDS}")


def _factor_rows(df: DataFrame, id_col: str, data: Column, parse: Callable[[Any], Iterator[tuple]]) -> DataFrame:
    kind = dict(df.dtypes)[id_col]
    own = df.select(F.col(id_col), data.alias("data"))
    return own.mapInArrow(lambda batches: _emit(batches, id_col, parse), f"`{id_col}` {kind}, {FACTOR_FIELDS}")


def _counter(parse: Callable[[Any], Iterator[tuple]]):
    @F.pandas_udf("long")
    def count(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else sum(1 for _ in parse(d)) for d in data], dtype="Int64")

    return count


def as_bytes(df: DataFrame, text: str) -> Column:
    return F.col(text) if dict(df.dtypes)[text] == "binary" else F.encode(F.col(text), "UTF-8")


def factorize(df: DataFrame, id_col: str, text: str, *, start_pos: int = 0, partitions: int | None = None) -> DataFrame:
    """The factors of each text from ``start_pos`` on. ``partitions`` deals texts to that many tasks first."""
    if partitions:
        df = df.repartition(partitions)
    return _plain_rows(df, id_col, as_bytes(df, text), start_pos)


def count_factors(df: DataFrame, text: str, *, out: str = "n_factors", start_pos: int = 0) -> DataFrame:
    """``df`` with the number of factors of each text; no factor is materialised."""
    @F.pandas_udf("long")
    def count(data: pd.Series) -> pd.Series:
        return pd.Series(kernel.lz_counts(data.tolist(), start_pos), dtype="Int64")

    return df.withColumn(out, count(as_bytes(df, text)))


def factorize_dna_rc(df: DataFrame, id_col: str, seq: str, *, mode: str = "reference", partitions: int | None = None) -> DataFrame:
    """The factors of each sequence, matching its earlier part or that part's reverse complement."""
    if partitions:
        df = df.repartition(partitions)
    return _factor_rows(df, id_col, F.upper(seq), lambda s: kernel.rc_factors([s], mode=mode))


def count_factors_dna_rc(df: DataFrame, seq: str, *, out: str = "n_factors", mode: str = "reference") -> DataFrame:
    return df.withColumn(out, _counter(lambda s: kernel.rc_factors([s], mode=mode))(F.upper(seq)))


def _grouped(df: DataFrame, group: str, order: str, seq: str) -> DataFrame:
    """One row per group with its sequences in order; a group is one text, so it is one row by its nature."""
    x = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.upper(seq).alias("s"))))
    return df.filter(F.length(seq) > 0).groupBy(group).agg(x.alias("x")).select(group, F.transform("x", lambda v: v["s"]).alias("sequences"))


def _joined(sequences: list[str], start: int = 0) -> Iterator[tuple[int, int, int]]:
    """The plain factors of sequences joined by separators of their own."""
    t: list[int] = []
    for k, s in enumerate(sequences):
        t += ([-k] if k else []) + list(s.encode())
    auto, i = kernel.SuffixAutomaton(t[:start]), start
    while i < len(t):
        n, ref = auto.longest(t, i)
        yield (i, n, ref) if n else (i, 1, i)
        auto.extend(t[i : i + (n or 1)])
        i += n or 1


def factorize_multiple(df: DataFrame, group: str, order: str, seq: str, *, with_rc: bool = True, mode: str = "reference", start_sequence: int = 0) -> DataFrame:
    """The factors of each group's sequences joined by separators, flagged: is_sentinel, and seq_idx of the sequence.

    With ``start_sequence`` factors begin at that sequence; those before it serve as reference.
    """

    def parse(sequences):
        start = sum(len(s) + 1 for s in sequences[:start_sequence])
        return kernel.rc_factors(sequences, start, mode) if with_rc else _joined(sequences, start)

    own = _grouped(df, group, order, seq)
    factors = _factor_rows(own, group, F.col("sequences"), parse)
    ends = own.select(group, F.posexplode(F.transform("sequences", F.length))).selectExpr(f"`{group}`", "pos as seq_idx", "col + 1 as size")
    w = Window.partitionBy(group).orderBy("seq_idx")
    ends = ends.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size"))
    per_group = ends.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("end", "seq_idx"))).alias("ends"))
    out = factors.join(per_group, group)
    # The sequence a factor starts in: as many as end at or before its start.
    at = F.size(F.filter("ends", lambda e: e["end"] <= F.col("start")))
    out = out.withColumn("seq_idx", at.cast("int")).withColumn("is_sentinel", F.exists("ends", lambda e: e["end"] - 1 == F.col("start")))
    return out.drop("ends")


def count_factors_multiple(df: DataFrame, group: str, order: str, seq: str, *, with_rc: bool = True, mode: str = "reference", out: str = "n_factors") -> DataFrame:
    parse = (lambda s: kernel.rc_factors(list(s), mode=mode)) if with_rc else (lambda s: _joined(list(s)))
    return _grouped(df, group, order, seq).select(group, _counter(parse)("sequences").alias(out))


def factorize_with_reference(targets: DataFrame, reference: str | bytes, id_col: str, text: str) -> DataFrame:
    """The factors of each target after reference and separator; starts are absolute, target_start counts in the target.

    The reference is one text that every task needs whole; it travels with the task's code, as any kernel needs it
    in memory.
    """
    ref = reference.encode() if isinstance(reference, str) else reference
    head = ref + b"\x01"
    got = _factor_rows(targets, id_col, as_bytes(targets, text), lambda t: kernel.lz_factors(head + t, len(head)))
    return got.withColumn("target_start", F.col("start") - len(head))


def factorize_dna_with_reference(targets: DataFrame, reference: str, id_col: str, seq: str, *, mode: str = "reference") -> DataFrame:
    """As ``factorize_with_reference`` for DNA, with reverse-complement matches. An empty reference is an error."""
    if not reference:
        raise ValueError("the reference is empty")
    ref = reference.upper()
    got = _factor_rows(targets, id_col, F.upper(seq), lambda s: kernel.rc_factors([ref, s], len(ref) + 1, mode) if s else iter(()))
    return got.withColumn("target_start", F.col("start") - len(ref) - 1)


def factorize_with_info(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, factors, alphabet, input_size, n_factors): nested factors and the alphabet's profile, one row per text."""
    from weft.functions import sequences

    factors = nest(factorize(df, id_col, text), id_col)
    profile = sequences.alphabet_profile(df, id_col, text)
    size = df.select(id_col, F.octet_length(text).cast("long").alias("input_size"))
    return size.join(factors, id_col, "left").join(profile, id_col, "left").select(id_col, "factors", F.struct("size", "entropy", "total_length").alias("alphabet"), "input_size", F.coalesce(F.size("factors"), F.lit(0)).alias("n_factors"))


def nest(factors: DataFrame, id_col: str) -> DataFrame:
    """(id, factors): an id's factors as one array, in order."""
    x = F.sort_array(F.collect_list(F.struct("factor_idx", "start", "length", "ref", "is_rc")))
    return factors.groupBy(id_col).agg(x.alias("x")).select(id_col, F.transform("x", lambda v: F.struct(v["start"].alias("start"), v["length"].alias("length"), v["ref"].alias("ref"), v["is_rc"].alias("is_rc"))).alias("factors"))


def reconstruct(df: DataFrame, factors: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, ok): whether each text is what its factors say."""
    kind = dict(df.dtypes)[id_col]
    comp = bytes.maketrans(b"ACGT", b"TGCA")

    def run(batches):
        for b in batches:
            ok = []
            for data, fs in zip(b.column("data").to_pylist(), b.column("factors").to_pylist()):
                at, good = fs[0]["start"] if fs else 0, True
                for f in fs or []:
                    piece = data[f["start"] : f["start"] + f["length"]]
                    source = data[f["ref"] : f["ref"] + f["length"]]
                    literal = f["ref"] == f["start"] and f["length"] == 1
                    good &= f["start"] == at and len(piece) == f["length"] and (literal or f["ref"] + f["length"] <= f["start"] and piece == (source[::-1].translate(comp) if f["is_rc"] else source))
                    at += f["length"]
                ok.append(good and at == len(data))
            yield pa.record_batch({id_col: b.column(id_col), "ok": pa.array(ok, pa.bool_())})

    joined = df.select(id_col, as_bytes(df, text).alias("data")).join(nest(factors, id_col), id_col, "left")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, ok boolean")


def register_sql(spark: SparkSession) -> None:
    """lz_count(text), dna_rc_count(seq), and the table functions lz_factors(text) and dna_rc_factors(seq)."""
    spark.udf.register("lz_count", _counter(lambda t: kernel.lz_factors(t.encode() if isinstance(t, str) else bytes(t))))
    spark.udf.register("dna_rc_count", _counter(lambda s: kernel.rc_factors([s.upper()])))

    @F.udtf(returnType="start bigint, length bigint, ref bigint")
    class LzFactors:
        def eval(self, text: str):
            if text is not None:
                yield from kernel.lz_factors(text.encode())

    @F.udtf(returnType="start bigint, length bigint, ref bigint, is_rc boolean")
    class DnaRcFactors:
        def eval(self, seq: str):
            if seq is not None:
                yield from kernel.rc_factors([seq.upper()])

    spark.udtf.register("lz_factors", LzFactors)
    spark.udtf.register("dna_rc_factors", DnaRcFactors)

