"""Exact substring dedup with suffix arrays.

A byte is removed if a string of WINDOW bytes covers it that also starts earlier in the corpus (smaller id, or
same document and earlier start). Every such string holds an anchor: the least-hashed string of ANCHOR bytes in
it, which depends on its bytes alone. So equal strings share an anchor at the same place, and all strings whose least
anchor it is lie in its fragment of under two windows, which ends where a lesser one to either side takes over.

1. Anchors are found and dealt to buckets by their hash, with a hash of their fragment. Within a task, fragments whose
   bytes equal an earlier one's are removed as a whole.
2. A bucket knows from the hashes which anchors stand more than once; their fragments go, with their bytes, to the
   shard of the anchor. Copies of one fragment beyond RUN_COPIES are dealt to more shards, each with the first of them.
3. A shard removes fragments whose bytes equal an earlier one's; of the others its suffix array is built by induced
   sorting, permuted common prefixes part it into classes of equal strings, and all but the earliest string of a class
   are removed.

Hashes only tell where to look: bytes and arrays decide. Anchors with more than MOST_FRAGMENTS surroundings are
lengthened to the whole string: their fragments fall into strings of WINDOW bytes, which go through the same steps, but
for the array: of strings that all differ none holds another.

Defined results: a null text is an empty text; documents shorter than a window lose nothing; ids tell texts apart, so
rows with equal ids must have equal texts, are the same document and get equal results; a null id comes before all
others; an empty table gives an empty result; extra columns are ignored by ``repeated_spans`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import slices
from weft.llm.common import durable, shuffle_partitions, table
from weft.llm.suffixes import common_prefixes, suffix_array

WINDOW, ANCHOR = 100, 32
#: Text of one bucket, fragments of one shard, text of one pass and of one flush, in bytes.
BUCKET_BYTES, SHARD_BYTES, PASS_BYTES, FLUSH_BYTES = 32_000_000, 1_000_000, 262_144, 12_000_000
#: Different surroundings of an anchor that a shard takes, and copies of a fragment.
MOST_FRAGMENTS, RUN_COPIES = 2_000, 500
NULL_ID = -(1 << 63)
_STEP = 1 << 40  # more than a text's length

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            bases = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64)
            table = np.repeat(bases[:, None], 2 * n, axis=1)
            table[:, 0] = 1
            cls.up, cls.down = np.cumprod(table, axis=1, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _sliding(a: np.ndarray, width: int, fold) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a, size = fold(a[:-size], a[size:]), 2 * size
    return fold(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _pieces(ids: list[int], texts: list[bytes]):
    """(document, its length, where the piece begins, the piece, first and last window start): long texts in overlapping pieces."""
    for d, t in zip(ids, texts):
        for a in range(0, len(t) - WINDOW + 1, PASS_BYTES):
            lo, hi = max(0, a - WINDOW), min(len(t), a + PASS_BYTES + 2 * WINDOW)
            yield d, len(t), lo, t[lo:hi], a - lo, min(a + PASS_BYTES, len(t) - WINDOW + 1) - lo


def find_anchors(ids: list[int], texts: list[bytes]) -> dict[str, np.ndarray]:
    """All anchors: document, place, bytes of the fragment before (left) and from (right) the place, the hashes of
    anchor (h) and fragment (g), and where the fragment begins (at) in the bytes ``flat``."""
    parts = list(_pieces(ids, texts))
    names = _KINDS | {"at": np.int64}
    if not parts:
        return {k: np.zeros(0, t) for k, t in names.items()} | {"flat": np.zeros(0, np.uint8)}
    size = np.array([len(p[3]) for p in parts])
    at = np.concatenate([[0], np.cumsum(size)])
    n, reach = int(at[-1]), WINDOW - ANCHOR + 1
    up, down = _Powers.get(n)
    flat = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * up, dtype=np.uint64)])
    rank = (_mix((total[ANCHOR:] - total[: n - ANCHOR + 1]) * down[: n - ANCHOR + 1]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(rank, reach, np.minimum)
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, at[:-1] + [p[4] for p in parts], 1)
    np.add.at(edge, at[:-1] + [p[5] for p in parts], -1)
    least[np.cumsum(edge[:-1]) == 0] = 0  # not a window of one text
    blank = np.zeros(reach - 1, np.uint32)
    pos = np.flatnonzero(_sliding(np.concatenate([blank, least, blank]), reach, np.maximum) == rank)
    of = np.searchsorted(at, pos, "right") - 1
    place = pos - at[of] + np.array([p[2] for p in parts])[of]
    left = np.minimum(place, WINDOW - ANCHOR)
    right = np.minimum(np.array([p[1] for p in parts])[of] - place, WINDOW)
    for d in range(reach - 1, 0, -1):  # no string of the fragment holds a lesser anchor
        lesser = (pos - d >= at[of]) & (rank[np.maximum(pos - d, 0)] < rank[pos])
        left[lesser] = np.minimum(left[lesser], d - 1)
        lesser = (pos + d + ANCHOR <= at[of + 1]) & (rank[np.minimum(pos + d, len(rank) - 1)] < rank[pos])
        right[lesser] = np.minimum(right[lesser], d + ANCHOR - 1)
    h = _mix((total[pos + ANCHOR] - total[pos]) * down[pos])
    s = pos - left
    g = _mix(_mix((total[pos + right] - total[s]) * down[s]) + (left * 256 + right).astype(np.uint64))
    doc = np.array([p[0] for p in parts], np.int64)[of]
    return dict(zip(names, (doc, place, left.astype(np.uint8), right.astype(np.uint8), h, g, s))) | {"flat": flat}


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of bytes, by document; spans that touch become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * _STEP
    reach = np.maximum.accumulate(end + number)
    first = np.concatenate([[True], start[1:] + number[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return doc[at], start[at], np.maximum.reduceat(end + number, at) - number[at]


_KINDS = dict(doc=np.int64, pos=np.int64, left=np.uint8, right=np.uint8, h=np.uint64, g=np.uint64)
_ANCHOR_COLUMNS = tuple(_KINDS)


def _equal_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether flat[a : a + size] equals flat[b : b + size], for each of them (none is empty)."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 8192):
        n = size[k : k + 8192]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[k : k + 8192] = np.logical_and.reduceat(flat[np.repeat(a[k : k + 8192], n) + step] == flat[np.repeat(b[k : k + 8192], n) + step], begin)
    return out


def _ordered(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors by hash, fragment hash, document and place, and the number of the first of each fragment."""
    order = np.lexsort((a["pos"], a["doc"], a["g"], a["h"]))
    a = {k: v[order] for k, v in a.items()}
    new = np.ones(len(order), bool)
    new[1:] = (a["h"][1:] != a["h"][:-1]) | (a["g"][1:] != a["g"][:-1])
    return a, np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _collapse(a: dict[str, np.ndarray], flat: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors without those whose fragment equals an earlier one's byte by byte, and the spans of these."""
    a, first = _ordered(a)
    size = a["left"].astype(np.int64) + a["right"]
    later = np.flatnonzero((first != np.arange(len(first))) & (size == size[first]) & (size > 0))
    same = np.zeros(len(first), bool)
    same[later] = _equal_bytes(flat, a["at"][later], a["at"][first[later]], size[later])
    gone = same & (size >= WINDOW) & ((a["doc"] != a["doc"][first]) | (a["pos"] != a["pos"][first]))
    c = {k: v[gone] for k, v in a.items()}
    return {k: v[~same] for k, v in a.items()}, merge_spans(c["doc"], c["pos"] - c["left"], c["pos"] + c["right"])


def _strings(ids: list[int], texts: list[bytes], parts: list[list[dict]]) -> dict[str, np.ndarray]:
    """All strings of WINDOW bytes in the parts of the texts, as anchors that are their own fragment."""
    doc, pos, at, h, begin = [], [], [], [], 0
    for i, t, own in zip(ids, texts, parts):
        for s in sorted({k for p in own for k in range(p["s"], p["e"] - WINDOW + 1)}):
            doc.append(i)
            pos.append(s)
            at.append(begin + s)
            h.append(xxhash.xxh3_64_intdigest(t[s : s + WINDOW]))
        begin += len(t)
    n, h = len(doc), np.array(h, np.uint64)
    values = (doc, pos, np.zeros(n), np.full(n, WINDOW), h, h, at)
    return {k: np.asarray(v).astype(t) for (k, t), v in zip((_KINDS | {"at": np.int64}).items(), values)} | {"flat": np.frombuffer(b"".join(texts), np.uint8)}


def _anchor_rows(own: DataFrame, buckets: int) -> DataFrame:
    """(id, data[, parts]) to a row for each bucket and flush with its anchors, and rows of spans (h holds the ends).

    With ``parts`` all strings in these stretches are anchors.
    """
    schema = "bucket int, spans boolean, " + ", ".join(f"{c} binary" for c in _ANCHOR_COLUMNS)
    whole = "parts" not in own.columns

    def flush(found: list[dict[str, np.ndarray]]):
        flat = [f.pop("flat") for f in found]
        for f, base in zip(found, np.cumsum([0, *map(len, flat)]).tolist()):
            f["at"] += base
        first, (doc, start, end) = _collapse({k: np.concatenate([f[k] for f in found]) for k in (*_ANCHOR_COLUMNS, "at")}, np.concatenate(flat))
        bucket = (first["h"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        first = {k: v[order] for k, v in first.items()}
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(at[1:] > at[:-1]).tolist()
        rows = {"bucket": list(full), "spans": [False] * len(full)} | {k: [first[k][at[b] : at[b + 1]].tobytes() for b in full] for k in _ANCHOR_COLUMNS}
        if len(doc):
            for k, v in {"bucket": int(doc[0]) % buckets, "spans": True, "doc": doc.tobytes(), "pos": start.tobytes(), "h": end.tobytes(), "left": b"", "right": b"", "g": b""}.items():
                rows[k].append(v)
        kinds = {"bucket": pa.int32(), "spans": pa.bool_()} | dict.fromkeys(_ANCHOR_COLUMNS, pa.binary())
        return pa.record_batch({k: pa.array(rows[k], t) for k, t in kinds.items()})

    def run(batches):
        found, size = [], 0
        for b in slices(batches, "data", PASS_BYTES):
            ids, texts = b.column("id").to_pylist(), b.column("data").to_pylist()
            found.append(find_anchors(ids, texts) if whole else _strings(ids, texts, b.column("parts").to_pylist()))
            size += sum(map(len, texts)) + 34 * len(found[-1]["doc"])
            if size >= FLUSH_BYTES:
                yield flush(found)
                found, size = [], 0
        if found:
            yield flush(found)

    return own.mapInArrow(run, schema)


def _meeter(most: int, run: int):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's anchors to spans to remove (h null) and fragments to compare: h, which run of copies (of the same
        h and fragment) they go with, and whether their anchor is to be lengthened."""
        spans = pdf[pdf["spans"]]
        doc, start, end = merge_spans(*(np.frombuffer(b"".join(spans[k]), np.int64) for k in ("doc", "pos", "h")))
        rows = pdf[~pdf["spans"]]
        a = {k: np.frombuffer(b"".join(rows[k]), t) for k, t in _KINDS.items()}
        order = np.argsort(a["h"], kind="stable")
        h = a["h"][order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        again = order[same[1:] | same[:-1]]
        a, first = _ordered({k: v[again] for k, v in a.items()})
        copy = np.arange(len(first)) - first
        edge = np.ones(len(first), bool)
        edge[1:] = a["h"][1:] != a["h"][:-1]
        different = np.add.reduceat((copy == 0).astype(np.int64), np.flatnonzero(edge))[np.cumsum(edge) - 1] if len(first) else copy
        copies = np.bincount(first, minlength=len(first))[first]
        long, hot = a["left"].astype(np.int64) + a["right"] >= WINDOW, different > most
        # The fragments of an anchor meet, but for those of a hot one, whose strings meet one by one; its copies go apart.
        part = copy // run + np.where(hot, (a["g"] >> np.uint64(1)).view(np.int64) >> 1, 0)
        met, strings = np.flatnonzero(long & (~hot | (copies > 1))), np.flatnonzero(long & hot & (copy == 0))
        heads = np.flatnonzero(long & (copy % run == 0) & (copy > 0))  # each later run begins with the first copy
        rows = np.concatenate([met, first[heads], strings])
        part, many = np.concatenate([part[met], part[heads], part[strings]]), np.arange(len(rows)) >= len(met) + len(heads)
        out = pd.DataFrame({"doc": doc, "s": start, "e": end, "h": pd.array([None] * len(doc), "Int64"), "part": 0, "many": False})
        found = pd.DataFrame({"doc": a["doc"][rows], "s": (a["pos"] - a["left"])[rows], "e": (a["pos"] + a["right"])[rows], "h": pd.array(a["h"][rows].view(np.int64), "Int64"), "part": part, "many": many})
        return pd.concat([out, found], ignore_index=True)

    return meet


def _fragment_rows(own: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """The bytes of the wanted fragments: a row for each shard and flush."""
    schema = "shard int, doc binary, s binary, size binary, data binary"
    shard = F.pmod(F.xxhash64("h", "part"), F.lit(shards)).cast("int")
    per_doc = wanted.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("s", "e", shard.alias("shard")))).alias("parts"))
    joined = own.join(per_doc, own["id"] == per_doc["doc"]).select("id", "data", "parts")

    def flush(rows):
        shard = np.array([r[0] for r in rows])
        for k in np.unique(shard):
            mine = [rows[i] for i in np.flatnonzero(shard == k)]
            yield pa.record_batch({"shard": pa.array([int(k)], pa.int32()), "doc": [np.array([r[1] for r in mine], np.int64).tobytes()], "s": [np.array([r[2] for r in mine], np.int64).tobytes()], "size": [np.array([len(r[3]) for r in mine], np.int32).tobytes()], "data": [b"".join(r[3] for r in mine)]})

    def run(batches):
        rows = []
        for b in slices(batches, "data"):
            for i, t, parts in zip(b.column("id").to_pylist(), b.column("data").to_pylist(), b.column("parts").to_pylist()):
                rows += ((p["shard"], i, p["s"], t[p["s"] : p["e"]]) for p in parts)
                if len(rows) > 60_000:
                    yield from flush(rows)
                    rows = []
        if rows:
            yield from flush(rows)

    return joined.mapInArrow(run, schema)


def shard_repeats(doc: np.ndarray, s: np.ndarray, size: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the strings of WINDOW bytes in the fragments that also start earlier in one of them."""
    n = len(doc)
    t = np.zeros(len(data) + n, np.uint16)  # a 0 ends each fragment
    end = np.cumsum(size + 1)
    begin = end - size - 1
    inside = np.ones(len(t), bool)
    inside[end - 1] = False
    t[inside] = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
    sa = suffix_array(t)
    shared = common_prefixes(t, sa, 2 * WINDOW, begin)  # fragments are shorter than that
    fragment = np.repeat(np.arange(n), size + 1)
    left = end[fragment] - 1 - np.arange(len(t))
    whole = sa[left[sa] >= WINDOW]  # suffixes that begin with a string within one fragment
    if not len(whole):
        return doc[:0], s[:0], s[:0]
    # Those that share a string are neighbours, with none but such ones between.
    first = np.concatenate([[True], shared[whole[1:]] < WINDOW])
    at = np.flatnonzero(first)
    f = fragment[whole]
    ranked, number = np.unique(doc, return_inverse=True)
    start = s[f] + whole - begin[f]
    key = number[f] * _STEP + start
    least = np.repeat(np.minimum.reduceat(key, at), np.diff(at, append=len(whole)))
    later = key > least
    return merge_spans(doc[f[later]], start[later], start[later] + WINDOW)


def _strings_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """As ``_shard`` for strings of WINDOW bytes that are their own anchors: two of them share a string only if equal."""
    return _judge(pdf, False)


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    return _judge(pdf, True)


def _judge(pdf: pd.DataFrame, parts: bool) -> pd.DataFrame:
    # Rows come in any order; what is found does not depend on it.
    doc, s = (np.frombuffer(b"".join(pdf[k]), np.int64) for k in ("doc", "s"))
    size, data = np.frombuffer(b"".join(pdf["size"]), np.int32).astype(np.int64), b"".join(pdf["data"])
    begin = np.cumsum(size) - size
    first: dict[bytes, int] = {}
    order = np.lexsort((s, doc))
    copy_of = np.empty(len(order), np.int64)
    for k, a, n in zip(order.tolist(), begin[order].tolist(), size[order].tolist()):
        copy_of[k] = first.setdefault(data[a : a + n], k)
    copies = np.flatnonzero((doc != doc[copy_of]) | (s != s[copy_of]))
    own = np.fromiter(first.values(), np.int64, len(first))
    got = shard_repeats(doc[own], s[own], size[own], b"".join(first)) if parts else (doc[:0], s[:0], s[:0])
    got = merge_spans(*(np.concatenate([x, y]) for x, y in zip(got, (doc[copies], s[copies], s[copies] + size[copies]))))
    return pd.DataFrame(dict(zip(("doc", "s", "e"), got)))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", most: int = MOST_FRAGMENTS, run: int = RUN_COPIES) -> DataFrame:
    """(doc, spans): the spans to remove from each document that has any; they may overlap. A null id is NULL_ID here."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = 2 * shuffle_partitions(spark)

    def meet(rows: DataFrame, bytes_: int) -> DataFrame:
        buckets = int(max(least, -(-bytes_ // BUCKET_BYTES)))
        return durable(_anchor_rows(rows, buckets).groupBy("bucket").applyInPandas(_meeter(most, run), "doc long, s long, e long, h long, part long, many boolean"))

    def shards(wanted: DataFrame, judge) -> DataFrame:
        much = wanted.agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
        return durable(_fragment_rows(own, wanted, int(max(least, -(-much // SHARD_BYTES)))).groupBy("shard").applyInPandas(judge, "doc long, s long, e long"))

    met = meet(own, size)
    spans = met.filter("h IS NULL").select("doc", "s", "e")
    wanted = met.filter("h IS NOT NULL AND NOT many")
    width = F.col("e") - F.col("s")
    much, long = met.filter("h IS NOT NULL").agg(F.sum(F.when(~F.col("many"), width)), F.sum(F.when(F.col("many"), (width - WINDOW + 1) * 64))).first()
    if long:  # strings of lengthened anchors
        parts = met.filter("many").groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("parts"))
        strings = meet(own.join(parts, own["id"] == parts["doc"]).select("id", "data", "parts"), long)
        spans = spans.unionByName(strings.filter("h IS NULL").select("doc", "s", "e"))
        spans = spans.unionByName(shards(strings.filter("h IS NOT NULL"), _strings_shard))
    if much:
        spans = spans.unionByName(shards(wanted, _shard))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of runs removed."""
    if not spans:
        return data, 0
    one = np.zeros(len(spans), np.int64)
    _, s, e = merge_spans(one, np.array([p["s"] for p in spans]), np.array([p["e"] for p in spans]))
    at = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(data)]]).tolist()
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])), len(s)


def _with_spans(docs: DataFrame, id_col: str, text: str, keep: list[str], **limits: int) -> DataFrame:
    """(row, spans): the columns ``keep`` as one, and the spans to remove."""
    spans = repeated_spans(docs, id_col=id_col, text=text, **limits)
    own = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    return own.join(spans, own["id"] == spans["doc"], "left").select("row", "spans")


def substring_digests(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the digest of the bytes kept."""
    df = _with_spans(docs.select(F.col(id_col), F.col(text).alias("_text") if text != "_text" else F.col(text)), id_col, "_text", [id_col, "_text"], **limits)
    df = df.select(F.struct(F.col("row")[id_col].alias(id_col)).alias("row"), F.encode(F.coalesce(F.col("row._text"), F.lit("")), "UTF-8").alias("data"), "spans")

    def run(batches):
        for b in slices(batches, "data"):
            data = b.column("data").to_pylist()
            kept = [_cut(d, p) for d, p in zip(data, b.column("spans").to_pylist())]
            yield pa.record_batch(
                {
                    id_col: pc.struct_field(b.column("row"), id_col),
                    "n_bytes": pa.array([len(d) for d in data], pa.int64()),
                    "n_removed": pa.array([len(d) - len(k[0]) for d, k in zip(data, kept)], pa.int64()),
                    "n_spans": pa.array([k[1] for k in kept], pa.int64()),
                    "kept_sha256": [hashlib.sha256(k[0]).hexdigest() for k in kept],
                }
            )

    return df.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents without their repeated strings; the columns stay the same.

    Bytes of a character cut in two are dropped with it. A null text stays null.
    """
    df = _with_spans(docs, id_col, text, docs.columns)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(texts), 1000):  # few texts at a time as Python strings
            t, p = texts.slice(k, 1000).to_pylist(), spans.slice(k, 1000).to_pylist()
            out.append(pa.array([x if x is None or not y else _cut(x.encode(), y)[0].decode("utf-8", "ignore") for x, y in zip(t, p)], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    # Only texts and spans go to Python, and come back once; all else stays where it is.
    df = df.select("row", cut(F.col("row")[text], F.col("spans")).alias("clean"))
    new = {text: F.col("clean")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("clean").cast(dict(docs.dtypes)[n_chars])
    return df.select(*(new.get(n, F.col("row")[n]).alias(n) for n in docs.columns))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


#: All strings of 100 bytes (200 hexadecimal digits), grouped as they are: brute force without anchors or arrays.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS x FROM d, unnest(range(0, n - 99)) AS u(i)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS first FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS p FROM e),
k AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a, b) AS kept,
             sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id)
"""

QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES = {"op2_suffix_array_dedup": OP2_SQL}
