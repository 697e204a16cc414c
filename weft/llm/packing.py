"""Best-fit packing of tokenized documents into fixed-length sequences, certified by lower bounds.

Documents are cut into pieces of at most the capacity. Pieces are dealt at random into partitions of bounded
size, and each packs its own by best-fit decreasing. Dual feasible functions give each partition a lower
bound of its bin count. A partition that meets it is certified, and its bins stay. The others keep their
full bins only; the pieces of the rest are exchanged: they are dealt anew, into as few partitions, and packed again.
That goes on until every partition is certified or an exchange saves no bin, in which case the bins from before it stay.

Only lengths and checksums move; texts and ids never leave the task that tokenized them.

Defined results: a null or empty text is one piece with the end token alone; rows with equal ids are packed
each by itself; ties of lengths go by id and piece; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import encoder, slices, vocabulary
from weft.llm.common import durable, table

CAPACITY = 4096
END_ID = 1
GROUP_ITEMS = 60_000


def token_pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document's ids (with the end token): id, piece, start, length, ids_crc32."""

    def run(batches):
        bpe = encoder(path)
        end = end_id.to_bytes(4, "little")
        for b in slices(batches, "text"):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode(b.column("text").to_pylist())):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch({id_col: b.column("id").take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, given in any order, and the room left in each bin.

    Bins are kept by the room they have left; a bit set of the rooms in use finds the tightest one.
    """
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, room = 0, []
    sizes = length.tolist()
    for i in np.argsort(-length, kind="stable").tolist():
        size = sizes[i]
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                used ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offset[i] = b, capacity - left
        left -= size
        room[b] = left
        by_room[left].append(b)
        used |= 1 << left
    return bins, offset, room


def bins_bound(length: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: the best of two families of dual feasible functions."""
    if not len(length):
        return 0
    count = np.bincount(length, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(count)])  # n[s]: items shorter than s
    total = np.concatenate([[0], np.cumsum(count * size)])
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    low = size[1 : half + 1][count[1 : half + 1] > 0]  # items under low are left out, those over capacity - low fill a bin
    low = np.concatenate([[0], low])
    long = n[-1] - n[half + 1]
    of_long = total[capacity - low + 1] - total[half + 1]  # those over a half that leave room for low
    n_mid = n[capacity - low + 1] - n[half + 1]
    short = total[half + 1] - total[low]
    best = max(best, int(np.max(long + np.maximum(0, -((n_mid * capacity - of_long - short) // capacity)))))
    for k in range(1, 33):  # x (k + 1) whole: x; else floor(x (k + 1)) / k, all times k * capacity
        up = size * (k + 1)
        worth = np.where(up % capacity == 0, size * k, (up // capacity) * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, turn: int, bound: Callable[[np.ndarray, int], int]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "piece", "start"], kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy()
        bins, offset, room = best_fit_decreasing(length, capacity)
        certified = len(room) <= bound(length, capacity)
        full = np.asarray(room)[bins] == 0
        return pdf.assign(sequence_id=(np.int64(turn) << 55) + (pdf["_part"].to_numpy().astype(np.int64) << 24) + bins, offset=offset, certified=certified, _done=full | certified)

    return pack


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", group_items: int = GROUP_ITEMS, bound: Callable[[np.ndarray, int], int] = bins_bound) -> DataFrame:
    """``pieces`` with sequence_id, offset, and whether the sequence's partition met its lower bound."""
    kind = dict(pieces.dtypes)[id_col]
    own = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    left = pieces.select(F.col(id_col).alias("_id"), "piece", "start", "length", "ids_crc32")
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, sequence_id long, offset long, certified boolean, _done boolean"
    rows, turn, out, given, bins = left.count(), 0, None, None, None
    while True:
        parts = -(-rows // group_items) or 1
        dealt = left.withColumn("_part", F.pmod(F.xxhash64("_id", "piece", "start", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = durable(dealt.groupBy("_part").applyInPandas(_packer(capacity, turn, bound), schema))
        # A bin's pieces add up to its fill, so the piece at offset 0 stands for it.
        first = F.col("offset") == 0
        now, rows, opened = packed.agg(F.count_if(first), F.count_if(~F.col("_done")), F.count_if(first & ~F.col("_done"))).first()
        if given is not None and now >= bins:
            break  # the exchange saved nothing
        kept = packed.filter("_done")
        out = kept if out is None else out.unionByName(kept)
        given, bins, turn = packed.filter("NOT _done"), opened, turn + 1
        if not rows:
            given = None
            break
        left = given.select("_id", "piece", "start", "length", "ids_crc32")
    if given is not None:
        out = out.unionByName(given)
    return out.select(F.col("_id").alias(id_col), *own[1:])


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents: one row per piece, with its place in its sequence."""
    return pack_pieces(durable(token_pieces(docs, path, capacity=capacity, end_id=end_id, id_col=id_col, text=text)), capacity=capacity, id_col=id_col)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
