"""Factorization of texts that grow: a stream of chunks per key, factors as soon as no later chunk can change them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.functions import kernel

OUTPUT = "key string, start long, length long, ref long"
STATE = "text binary, done long"


def settled_factors(text: bytes, done: int) -> list[tuple[int, int, int]]:
    """The factors from ``done`` on that end before the text does; the one at the end may still grow."""
    return [f for f in kernel.lz_factors(text, done) if f[0] + f[1] < len(text)] if done < len(text) else []


def _grow(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, done = state.get if state.exists else (b"", 0)
    rows = pd.concat(list(chunks)).sort_values("seq")
    text = bytes(text) + b"".join(bytes(x) for x in rows["chunk"])
    found = settled_factors(text, done)
    if found:
        done = found[-1][0] + found[-1][1]
    state.update((text, done))
    yield pd.DataFrame({"key": [key[0]] * len(found), "start": [f[0] for f in found], "length": [f[1] for f in found], "ref": [f[2] for f in found]}).astype({"start": "int64", "length": "int64", "ref": "int64"})


def factorize_stream(chunks: DataFrame) -> DataFrame:
    """(key string, seq long, chunk binary) as a stream to the settled factors of each key's text.

    Chunks of one trigger go in order of ``seq``. The state holds the key's text: a factor may copy from anywhere in it.
    """
    return chunks.groupBy("key").applyInPandasWithState(_grow, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
