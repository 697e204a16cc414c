"""One very long text on many tasks.

A factor depends on the text and its place only. Each chunk of a text is parsed from its own beginning; the true parse
may enter it elsewhere, is parsed on from there, and as soon as it meets a factor of the chunk follows that chunk's
parse, which is then the same. A task needs the whole text but takes many chunks of it, so a text is sent once to each
task, however many chunks it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import kernel
from weft.operators.factorize import FACTOR_FIELDS, as_bytes

Parse = Callable[[int], Iterator[tuple]]


def plain_parser(data: bytes) -> Parse:
    """From a place to the plain factors from there on."""
    length, ref, _ = kernel._matches([data])
    length, ref = length.tolist(), ref.tolist()
    return lambda at: kernel._walk(data, length, ref, 0, at)


def rc_parser(sequences: list[str], mode: str) -> Parse:
    """From a place of the joined sequences to the factors, with reverse complements, from there on."""
    index = kernel.rc_index(sequences)
    return lambda at: kernel.rc_walk(index, at, mode)


def chunk_factors(parse: Parse, begin: int, end: int) -> list[tuple]:
    out = []
    for f in parse(begin):
        out.append(f)
        if f[0] + f[1] >= end:
            break
    return out


def stitch(parse: Parse | Callable[[], Parse], chunks: list[list[tuple]]) -> list[tuple]:
    """The parse of the whole text from the parses of its chunks, in order."""
    out: list[tuple] = []
    at = 0
    for chunk in chunks:
        place = {f[0]: k for k, f in enumerate(chunk)}
        last = chunk[-1][0] + chunk[-1][1]
        own = None
        while at < last and at not in place:
            own = own or parse(at)
            out.append(next(own))
            at = out[-1][0] + out[-1][1]
        if at in place:
            out += chunk[place[at] :]
            at = last
    return out


def factorize_chunked(df: DataFrame, id_col: str, text: str, *, chunk_bytes: int = 1_000_000, tasks: int | None = None, with_rc: bool = False, mode: str = "reference") -> DataFrame:
    """As ``factorize`` (``with_rc``: as ``factorize_dna_rc``), for texts too long for one task's time.

    Each text goes to ``tasks`` tasks at most (the session's cores), which deal its chunks out among them.
    """
    spark = df.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    kind = dict(df.dtypes)[id_col]
    own = df.select(id_col, (F.encode(F.upper(text), "UTF-8") if with_rc else as_bytes(df, text)).alias("data")).filter(F.length("data") > 0)
    chunks = F.ceil(F.length("data") / chunk_bytes)
    parts = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(F.lit(tasks), chunks.cast("int")) - 1)))
    parts = parts.repartition(F.col(id_col), F.col("part"))
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref", pa.int64()), ("is_rc", pa.bool_())])
    schema = f"`{id_col}` {kind}, begin long, factors array<struct<start:bigint,length:bigint,ref:bigint,is_rc:boolean>>"

    def parser(data: bytes) -> Parse:
        return rc_parser([data.decode()], mode) if with_rc else plain_parser(data)

    def parse(batches):
        for b in batches:
            for k, (data, part) in enumerate(zip(b.column("data").to_pylist(), b.column("part").to_pylist())):
                p, width = parser(data), min(tasks, -(-len(data) // chunk_bytes))
                for begin in range(part * chunk_bytes, len(data), width * chunk_bytes):
                    found = [dict(zip(("start", "length", "ref", "is_rc"), (*f, False)[:4])) for f in chunk_factors(p, begin, min(len(data), begin + chunk_bytes))]
                    yield pa.record_batch({id_col: b.column(id_col).slice(k, 1), "begin": pa.array([begin], pa.int64()), "factors": pa.array([found], pa.list_(triple))})

    parsed = parts.mapInArrow(parse, schema)
    # The text itself comes first of its rows, then the chunks in order.
    rows = parsed.select(id_col, "begin", "factors", F.lit(None).cast("binary").alias("data"))
    rows = rows.unionByName(own.select(id_col, F.lit(-1).cast("long").alias("begin"), F.lit(None).cast(dict(parsed.dtypes)["factors"]).alias("factors"), "data"))
    rows = rows.repartition(F.col(id_col)).sortWithinPartitions(id_col, "begin")

    def join(batches):
        def each():
            for b in batches:
                yield from zip(b.column(id_col), b.column("begin").to_pylist(), b.column("data"), b.column("factors"))

        for i, own_rows in groupby(each(), key=lambda r: r[0].as_py()):
            own_rows = list(own_rows)
            data = own_rows[0][2].as_py()
            made: list[Parse] = []

            def lazily(at: int) -> Iterator[tuple]:
                if not made:
                    made.append(parser(data))
                return made[0](at)

            got = stitch(lazily, [[(f["start"], f["length"], f["ref"], f["is_rc"]) for f in r[3].as_py()] for r in own_rows[1:]])
            for k in range(0, len(got), 100_000):
                cut = [(*f, False)[:4] for f in got[k : k + 100_000]]
                cols, n = list(zip(*cut)), len(cut)
                yield pa.record_batch(
                    {
                        id_col: pa.repeat(own_rows[0][0], n),
                        "factor_idx": pa.array(np.arange(k, k + n), pa.int32()),
                        **{c: pa.array(x, pa.int64()) for c, x in zip(("start", "length", "ref"), cols)},
                        "is_rc": pa.array(cols[3], pa.bool_()),
                    }
                )

    return rows.mapInArrow(join, f"`{id_col}` {kind}, {FACTOR_FIELDS}")
