"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all neighbouring pairs at once by
binary search in the sorted pair keys, takes each word's lowest rank, and merges that pair wherever the
word has it. Words without a pair left leave the array. Only distinct words are merged: texts are put
together from a bounded cache of words.

The vocabulary file (a word-end BPE in the ``tokenizers`` JSON format) is a parameter; nothing is trained.

Defined results: a null text is an empty text with no ids; rows are independent of each other, so ties
and repeated rows need no rule; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import table

#: Fixed values of the format: letters and numbers among the first 256 code points, in lower case.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_NONE = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next one from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, *, cache_entries: int = 300_000, cache_base: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self._special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self.tokens = [""] * (max([*vocab.values(), *self._special.values()]) + 1)
        for token, i in [*vocab.items(), *self._special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.uint32)
        self._last = np.array([vocab[c + end] for c in letters], np.uint32)
        self._byte_of = {c: b for b, c in enumerate(letters)}
        self._size = len(self.tokens)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if self._size > 65_536:
            raise ValueError("pair keys are 32 bits wide: at most 65,536 tokens")
        key = np.array([vocab[a] * self._size + vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(key, kind="stable")
        self._keys, self._rank = key[order], order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)[order]
        self._path, self._library = path, None
        self._cache: dict = {i: i.to_bytes(4, "little") for i in self._special.values()}
        self._most, self._base = cache_entries, cache_base

    # -- words -----------------------------------------------------------------------------------

    @property
    def _rules(self):
        """The library's own rules, by which texts beyond Latin-1 are normalised and split; loaded when first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def _words(self, text: str) -> list:
        """The words of a text in lower case; those of texts beyond Latin-1 as bytes, special tokens as their ids."""
        if "<|" in text and self._split_special is not None:
            parts = self._split_special.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([self._special[p]] if p in self._special else self._words(p))]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = self._rules.normalizer.normalize_str(text)
            return [bytes(self._byte_of[c] for c in w) for w, _ in self._rules.pre_tokenizer.pre_tokenize_str(text)]
        return _WORD.findall(text.lower())

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by binary search; pairs that never merge have the rank _NONE."""
        key = left * np.uint32(self._size) + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE), self._merged[at]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin (one more entry at the end)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self._inner[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self._last[flat[ends]]
        wid = np.repeat(np.arange(len(words), dtype=np.int32), size)
        last = np.zeros(len(sym), bool)
        last[ends] = True
        rank, to = np.full(len(sym), _NONE), np.zeros(len(sym), np.uint32)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[last] = _NONE
        out_sym, out_wid = [], []
        while len(sym):
            edge = np.flatnonzero(last[:-1]) + 1
            edge = np.concatenate([[0], edge])
            best = np.minimum.reduceat(rank, edge)
            mine = np.repeat(best, np.diff(edge, append=len(sym)))
            gone = mine == _NONE
            out_sym.append(sym[gone])
            out_wid.append(wid[gone])
            pos = np.flatnonzero((rank == mine) & ~gone)
            if not len(pos):
                break
            # In a run of overlapping pairs (a a a) every other one counts, from the left.
            n = np.arange(len(pos))
            start = np.maximum.accumulate(np.where(np.diff(pos, prepend=-2) != 1, n, 0))
            pos = pos[(n - start) % 2 == 0]
            sym[pos] = to[pos]
            last[pos] = last[pos + 1]
            gone[pos + 1] = True
            keep = ~gone
            at = np.cumsum(keep)[pos] - 1
            sym, wid, last, rank, to = sym[keep], wid[keep], last[keep], rank[keep], to[keep]
            # Only the pairs beside a merge are new.
            new = np.concatenate([at, at[at > 0] - 1])
            rank[new] = _NONE
            new = new[~last[new]]
            rank[new], to[new] = self._pairs(sym[new], sym[new + 1])
        wid = np.concatenate(out_wid) if out_wid else np.zeros(0, np.int32)
        order = np.argsort(wid, kind="stable")
        sym = (np.concatenate(out_sym) if out_sym else np.zeros(0, np.uint32))[order]
        return sym.astype("<u4"), np.searchsorted(wid[order], np.arange(len(words) + 1))

    def _learn(self, words: list) -> None:
        """Put the ids of the words into the cache."""
        sym, at = self._merge([w.encode() if isinstance(w, str) else w for w in words])
        raw, at = sym.tobytes(), (at * 4).tolist()
        self._cache.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:]))))

    # -- texts -----------------------------------------------------------------------------------

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._cache) > self._most:  # the first entries hold the common words
            self._cache = dict(islice(self._cache.items(), self._base))
            self._cache.update((i, i.to_bytes(4, "little")) for i in self._special.values())
        lists = [self._words(t) if t else [] for t in texts]
        new = list(set().union(*lists).difference(self._cache))
        for k in range(0, len(new), 50_000):
            self._learn(new[k : k + 50_000])
        get = self._cache.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by one space: the format's rule where the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBPE:
    """One encoder for each Python worker and file."""
    return WordBPE(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that a part's texts take about ``most_bytes`` at most."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: n_tokens, the digest of its ids, and the digest of the text decoded from them."""

    def run(batches):
        bpe = encoder(path)
        for b in slices(batches, "text"):
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.record_batch(
                {
                    id_col: b.column("id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
                }
            )

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of the text's ids (array of int); a null text has none."""
    schema = docs.drop(ids).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe = encoder(path)
        for b in slices(batches, text):
            got = bpe.encode(b.column(text).to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
            names = [n for n in b.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(pa.array(at), values)], names=[*names, ids])

    return docs.drop(ids).mapInArrow(run, schema)


def vocabulary() -> str:
    """The word-end vocabulary the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
