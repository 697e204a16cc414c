"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1; for each bit a linear classifier over hashed byte n-grams of the
letters is fitted by ridge regression. A text gets the language whose codeword is nearest to the classifiers'
outputs, where the loss of each bit is weighted by how often its classifier was right on that language in a
part of the training sample kept apart. Texts about as near to the second codeword are flagged.

The classifiers are fitted on a bounded sample: about SAMPLE_PER_LANG documents of each language, drawn by a
hash of the id, and at most SAMPLE_ROWS in all. The sample reaches the driver as n-gram counts of BINS bins
at most per document, whatever the length of its text.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing
can be learned; a null id counts as not held out; ties between codewords go to the first language by name;
repeated rows get equal predictions; an empty table gives an empty result; extra columns are ignored by
``identify_languages`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import slices
from weft.llm.common import table

UNKNOWN = "und"
SAMPLE_PER_LANG = 300
SAMPLE_ROWS = 4000
BINS = 1 << 13
ORDERS = (2, 3, 4)
RIDGE = 1e-3
TEMPERATURE = 0.1
#: Texts whose two nearest codewords differ by less than this share of the largest possible loss are ambiguous.
MARGIN = 0.02

#: ASCII letters and bytes of longer UTF-8 sequences stay; all else is a break.
_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def _bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams of the (not empty) texts, a row for each place and a column for each order; where each text begins."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]])
    code = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    code = np.concatenate([code, np.full(max(ORDERS), 32, np.uint32)])
    n, out, roll = at[-1] + len(raw[-1]), [], np.zeros(len(code), np.uint32)
    for k in range(max(ORDERS)):
        roll[:n] = roll[:n] * np.uint32(0x01000193) + code[k : n + k] + np.uint32(1)
        if k + 1 in ORDERS:
            h = (roll[:n] ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BINS.bit_length() + 1))
    return np.stack(out, 1), at


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _features(rows: DataFrame) -> DataFrame:
    """(lang, h, text) to (lang, h, bins, counts)."""

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            texts = b.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            if not keep:
                continue
            bins, at = _bins([texts[i] for i in keep])
            got = [np.unique(x, return_counts=True) for x in np.split(bins, at[1:])]
            ids = pa.array(keep, pa.int64())
            yield pa.record_batch(
                {
                    "lang": b.column("lang").take(ids),
                    "h": b.column("h").take(ids),
                    "bins": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                    "counts": pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())),
                }
            )

    return rows.mapInArrow(run, "lang string, h long, bins array<int>, counts array<int>")


def code_matrix(languages: int) -> np.ndarray:
    """Codewords of +1 and -1: all splits in two for up to seven languages, else the best of several random codes."""
    if languages == 1:
        return np.ones((1, 1))
    if languages <= 7:
        bits = np.arange(1, 1 << (languages - 1))  # the first language is always on the side of 0
        return np.where((bits[None, :] >> np.arange(languages)[::-1, None]) & 1, 1.0, -1.0)
    width, rng, best = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(0), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, width))
        apart = np.min((width - code @ code.T)[~np.eye(languages, dtype=bool)])
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    bit_weight: np.ndarray  # languages x bits, rows sum to 1
    weight: np.ndarray  # bins x bits
    bias: np.ndarray  # bits

    def losses(self, texts: list[str]) -> np.ndarray:
        """Texts x languages: the weighted hinge losses of the outputs against each codeword, 0 to 2."""
        bins, at = _bins(texts)
        sums = sum(np.add.reduceat(self.weight[bins[:, k]], at, axis=0) for k in range(bins.shape[1]))
        # Where a text has n-grams f, its output is f.w / |f|; the norm is nearly that of the mean, so counts are scaled by their sum.
        out = np.clip(sums / (np.diff(at, append=len(bins))[:, None] * bins.shape[1]) + self.bias, -1, 1)
        return np.clip(1 - out @ (self.code * self.bit_weight).T, 0, 2)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """Fit on (language, bins, counts); None without rows."""
    if not sample:
        return None
    languages = sorted({x[0] for x in sample})
    x = np.zeros((len(sample), BINS), np.float32)
    for i, (_, bins, counts) in enumerate(sample):
        x[i, bins] = counts
    x /= x.sum(1, keepdims=True)
    scale = 1 / np.sqrt(x.mean(0) + 1e-7)  # rare n-grams weigh more
    x *= scale
    y = np.array([languages.index(s[0]) for s in sample])
    code = code_matrix(len(languages))

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = code[y[rows]].mean(0)
        k = x[rows] @ x[rows].T
        k[np.diag_indices_from(k)] += RIDGE * np.trace(k) / len(k) + 1e-6
        return x[rows].T @ np.linalg.solve(k, code[y[rows]] - mean).astype(np.float32), mean

    apart = np.arange(len(sample)) % 4 == 0
    right = np.ones_like(code)
    if apart.any() and not apart.all():
        w, mean = solve(~apart)
        said = np.sign(x[apart] @ w + mean)
        for k in range(len(languages)):
            if (own := y[apart] == k).any():
                right[k] = (said[own] == code[k]).mean(0)
    w, mean = solve(np.ones(len(sample), bool))
    right = np.maximum(right, 1e-3)
    return Model(languages, code, right / right.sum(1, keepdims=True), (w * scale[:, None]).astype(np.float32), mean)


def learn(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a sample of the labelled rows, drawn by a hash of the id."""
    rows = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    each = min(per_lang, most // len(counts)) or 1
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, each / n))))
    sample = rows.filter(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.xxhash64(id_col, text).alias("h"), F.col(text).alias("text"))
    got = sorted(_features(sample).collect(), key=lambda r: (r.h, r.lang))
    return fit([(r.lang, np.array(r.bins), np.array(r.counts)) for r in got])


def _predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """lang_pred, score and ambiguous of each text."""
    known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    lang, score, doubt = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if known:
        loss = model.losses([texts[i] for i in known])
        order = np.sort(loss, 1)
        p = np.exp(-(loss - order[:, :1]) / TEMPERATURE)
        for i, best, s, d in zip(known, loss.argmin(1).tolist(), (1 / p.sum(1)).tolist(), ((order[:, 1] - order[:, 0] < 2 * MARGIN) if loss.shape[1] > 1 else np.zeros(len(known), bool)).tolist()):
            lang[i], score[i], doubt[i] = model.languages[best], s, d
    return lang, score, doubt


def predicted(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """(lang_pred, score, ambiguous) of a text, from the text alone; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        out = ([], [], [])
        for part in slices([pa.record_batch({"text": texts})], "text", 500_000):
            for own, new in zip(out, _predict(part.column("text").to_pylist(), shared.value)):
                own += new
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["lang_pred", "score", "ambiguous"])

    return predict(text)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous; learned from the documents not held out."""
    model = learn(docs.filter(~held_out(F.col(id_col))), id_col=id_col, text=text, lang=lang)
    own = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predicted(docs, model, F.col(text)).alias("p"))
    return own.select(id_col, "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a language that is not in doubt; the columns stay the same."""
    model = learn(docs.filter(~held_out(F.col(id_col))), id_col=id_col, text=text, lang=lang)
    own = docs.select(F.struct(*docs.columns).alias("row"), predicted(docs, model, F.col(text)).alias("p"))
    return own.filter((F.col("p.lang_pred") != UNKNOWN) & ~F.col("p.ambiguous")).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
