"""The binary factor file, version 2.

Layout, little-endian: factors of three unsigned 64-bit numbers (start, length, ref; the top bit of ref marks a
reverse complement), NUL-ended sequence names, unsigned 64-bit indices of sentinel factors, and a footer of the magic
and five unsigned 64-bit numbers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import InvalidInputError

#: Fixed values of the format.
MAGIC = b"noLZSSv2"
FOOTER = struct.Struct("<8s5Q")  # magic, factors, sequences, sentinels, footer size, total length
RC_BIT = 1 << 63


def encode(factors: list[tuple], names: list[str] = (), sentinels: list[int] = (), n_sequences: int | None = None) -> bytes:
    """The file of factors (start, length, ref[, is_rc]); total length is the sum of lengths."""
    table = np.zeros((len(factors), 3), "<u8")
    for i, f in enumerate(factors):
        table[i] = f[0], f[1], f[2] | (RC_BIT if len(f) > 3 and f[3] else 0)
    tail = b"".join(n.encode() + b"\0" for n in names) + np.asarray(list(sentinels), "<u8").tobytes()
    footer = FOOTER.pack(MAGIC, len(factors), len(names) if n_sequences is None else n_sequences, len(sentinels), len(tail) + FOOTER.size, sum(f[1] for f in factors))
    return table.tobytes() + tail + footer


def read_footer(data: bytes) -> dict:
    """Counts, names and sentinel indices; raises for anything that is not such a file."""
    if len(data) < FOOTER.size:
        raise InvalidInputError("file too small for a footer")
    magic, n, sequences, sentinels, size, total = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    if magic != MAGIC:
        raise InvalidInputError("wrong magic")
    if size < FOOTER.size or size > len(data) or 24 * n + size != len(data):
        raise InvalidInputError("inconsistent sizes")
    tail = data[len(data) - size : len(data) - FOOTER.size]
    marks = tail[len(tail) - 8 * sentinels :] if sentinels else b""
    names = tail[: len(tail) - 8 * sentinels].split(b"\0")[:-1]
    return {"num_factors": n, "num_sequences": sequences, "num_sentinels": sentinels, "total_length": total, "names": [x.decode() for x in names], "sentinels": np.frombuffer(marks, "<u8").tolist()}


def decode(data: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """The factors of a file."""
    n = read_footer(data)["num_factors"]
    t = np.frombuffer(data, "<u8", 3 * n).reshape(n, 3)
    return zip(t[:, 0].tolist(), t[:, 1].tolist(), (t[:, 2] & np.uint64(RC_BIT - 1)).tolist(), (t[:, 2] >> np.uint64(63)).astype(bool).tolist())


_META = "file string, num_factors long, num_sequences long, num_sentinels long, total_length long, names array<string>, sentinels array<long>, error string"
_FACTORS = "file string, factor_idx int, start long, length long, ref long, is_rc boolean, is_sentinel boolean"


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def read_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per file: its footer; for what is no factor file, the error."""

    def run(batches):
        for b in batches:
            rows = []
            for file, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows.append({"file": file, "error": None} | read_footer(data))
                except InvalidInputError as e:
                    rows.append({"file": file, "error": str(e)})
            kinds = [("file", pa.string()), *((k, pa.int64()) for k in ("num_factors", "num_sequences", "num_sentinels", "total_length")), ("names", pa.list_(pa.string())), ("sentinels", pa.list_(pa.int64())), ("error", pa.string())]
            yield pa.record_batch({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds})

    return _files(spark, path).mapInArrow(run, _META)


def read_factors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The factors of all files."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                footer = read_footer(data)
                n, marks = footer["num_factors"], np.array(footer["sentinels"], np.int64)
                t = np.frombuffer(data, "<u8", 3 * n).reshape(n, 3)
                for a in range(0, n, 100_000):
                    x = t[a : a + 100_000]
                    index = np.arange(a, a + len(x))
                    yield pa.record_batch(
                        {
                            "file": pa.array([file] * len(x), pa.string()),
                            "factor_idx": pa.array(index, pa.int32()),
                            "start": pa.array(x[:, 0].astype(np.int64)),
                            "length": pa.array(x[:, 1].astype(np.int64)),
                            "ref": pa.array((x[:, 2] & np.uint64(RC_BIT - 1)).astype(np.int64)),
                            "is_rc": pa.array((x[:, 2] >> np.uint64(63)).astype(bool)),
                            "is_sentinel": pa.array(np.isin(index, marks)),
                        }
                    )

    return _files(spark, path).mapInArrow(run, _FACTORS)


def _write_sorted(batches: Iterator[pa.RecordBatch], id_col: str, path: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of file, each file's header first, to files; a row for each that is done."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    state: dict = {}

    def close():
        marks, tail = np.asarray(state["marks"], "<u8"), b"".join(n.encode() + b"\0" for n in state["names"])
        tail += marks.tobytes()
        state["out"].write(tail + FOOTER.pack(MAGIC, state["n"], state["n_sequences"], len(marks), len(tail) + FOOTER.size, state["total"]))
        state["out"].close()
        store.move(state["part"], state["to"])
        return pa.record_batch({id_col: state["id"], "file": pa.array([state["to"]], pa.string()), "n_factors": pa.array([state["n"]], pa.int64())})

    for b in batches:
        begins = np.flatnonzero(b.column("start").is_null().to_numpy(zero_copy_only=False)).tolist()
        heads = set(begins)
        for at, end in zip([0, *begins], [*begins, b.num_rows]):
            if at < end and at in heads:
                if state:
                    yield close()
                to = f"{root}/{b.column('safe')[at].as_py()}.bin"
                part = f"{to}.{uuid.uuid4().hex}"
                state = {"to": to, "part": part, "out": store.open_output_stream(part), "n": 0, "total": 0, "marks": [], "id": b.column(id_col).slice(at, 1), "names": b.column("names")[at].as_py(), "n_sequences": b.column("n_sequences")[at].as_py()}
                at += 1
            if at < end:
                cut = b.slice(at, end - at)
                start, length, ref = (cut.column(c).to_numpy(zero_copy_only=False).astype("<u8") for c in ("start", "length", "ref"))
                ref = ref | np.where(cut.column("is_rc").to_numpy(zero_copy_only=False), np.uint64(RC_BIT), np.uint64(0))
                state["out"].write(np.column_stack([start, length, ref]).astype("<u8").tobytes())
                state["marks"] += (np.flatnonzero(cut.column("mark").to_numpy(zero_copy_only=False)) + state["n"]).tolist()
                state["n"] += len(start)
                state["total"] += int(length.sum())
    if state:
        yield close()


def write_factors(factors: DataFrame, id_col: str, path: str, *, names: bool = False, headers: DataFrame | None = None) -> DataFrame:
    """Write one file ``<id>.bin`` per id into the folder ``path``, and return (id, file, n_factors).

    ``headers`` (id, names array<string>, n_sequences long) gives each file's sequence names and the number of
    sequences its footer tells; its ids without a factor get an empty file. Without it the footer tells no sequence, or
    with ``names`` one, named by the id.

    The folder is a URI that every executor reaches. A file's factors pass through one task in order, a batch at a
    time. Each file is written under another name and moved into place, so a task that is run again leaves no half
    file. Ids that make the same file name raise. Runs at once.
    """
    kind = dict(factors.dtypes)[id_col]
    sentinel = F.col("is_sentinel") if "is_sentinel" in factors.columns else F.lit(False)
    rows = factors.select(F.col(id_col), "start", "length", "ref", "is_rc", sentinel.alias("mark"), F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("long").alias("n_sequences"))
    if headers is None:
        own = F.array(F.col(id_col).cast("string")) if names else F.array().cast("array<string>")
        headers = factors.select(id_col).distinct().select(id_col, own.alias("names"), F.lit(int(names)).cast("long").alias("n_sequences"))
    none = {c: F.lit(None).cast(t) for c, t in (("start", "long"), ("length", "long"), ("ref", "long"), ("is_rc", "boolean"), ("mark", "boolean"))}
    rows = rows.unionByName(headers.select(id_col, "names", F.col("n_sequences").cast("long").alias("n_sequences")).withColumns(none))
    safe = F.regexp_replace(F.col(id_col).cast("string"), r'[/\\:*?"<>| ]', "_")
    clash = headers.select(safe.alias("safe")).groupBy("safe").count().filter("count > 1").first()
    if clash:
        raise InvalidInputError(f"several ids make the file name {clash['safe']}.bin")
    # A file's header row comes first: its start is null.
    rows = rows.withColumn("safe", safe).repartition("safe").sortWithinPartitions("safe", F.col("start").asc_nulls_first())

    done = rows.mapInArrow(lambda batches: _write_sorted(batches, id_col, path), f"`{id_col}` {kind}, file string, n_factors long")
    return factors.sparkSession.createDataFrame(done.collect(), done.schema)  # a row per file
