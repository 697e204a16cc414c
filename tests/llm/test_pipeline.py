"""The pipeline against a brute-force version of its stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import bpe, quality

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu", "lo"], "bb": ["sch", "ver", "ung", "ein", "ach"]}


def documents():
    rng = random.Random(31)

    def line(lang, n):
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 6))) for _ in range(n))

    out = []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        out.append((i, "\n".join(line(lang, rng.randint(8, 30)) for _ in range(rng.randint(3, 8))), lang, f"h{i % 2}"))
    footer = line("aa", 9).capitalize()
    out = [(i, t + "\n" + footer if i % 4 == 0 else t, *x) for i, t, *x in out]
    passage = line("bb", 60)
    out += [(200 + k, out[k][1] + "\n" + passage, out[k][2], "h0") for k in range(4)]  # near or far copies with a passage
    out += [(210 + k, out[10][1].replace(out[10][1].split()[5 + k], "kakaka", 1), out[10][2], "h1") for k in range(3)]
    out += [(220, None, "aa", "h0"), (221, "12 34", None, "h0"), (222, line("aa", 20), "aa", "h0"), (223, out[3][1], "aa", "h1")]
    return out


def brute_quality(rows):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    lines = lambda t: [x for x in t.split("\n") if words(x)]
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, t, _, h in rows:
        hosts[h].add(t)
        for x in lines(t):
            holders[h, normal(x)].add(t)
    frequent = {k for k, v in holders.items() if len(v) > quality.MIN_LINE_DOCS and 100 * len(v) > quality.LINE_DOCS_PERCENT * len(hosts[k[0]])}
    out = []
    for i, t, lang, h in rows:
        w = words(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        mine = {normal(x): len(words(x)) for x in lines(t)}
        left = sum(n for x, n in mine.items() if (h, x) not in frequent)
        if len(w) < 50 or 100 * len(repeated) > 50 * len(w) or 100 * left < quality.MIN_LEFT_PERCENT * sum(mine.values()):
            continue
        out.append((i, "\n".join(x for x in t.split("\n") if (h, normal(x)) not in frequent), lang, h))
    return out


def brute_near(rows):
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return [r for r in rows if top(r[0]) == r[0]]


def brute_substrings(rows):
    seen, out = set(), []
    for i, t, lang, h in sorted(rows):
        b = t.encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out.append((i, bytes(c for c, x in zip(b, cut) if not x).decode("utf-8", "ignore"), lang, h))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    base, out = tmp_path_factory.mktemp("stages"), [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(base)).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def rows_of(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "near-dedup", "suffix-array dedup", "best-fit packing"]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_stage_keeps_texts_with_letters(stages):
    assert rows_of(stages[1]) == sorted(r for r in documents() if r[0] not in (220, 221))


def test_quality_stage(stages):
    assert rows_of(stages[2]) == sorted(brute_quality(rows_of(stages[1])))
    assert any("\n" in r[1] for r in rows_of(stages[2]))


def test_near_stage(stages):
    got = rows_of(stages[3])
    assert got == sorted(brute_near(rows_of(stages[2]))) and 223 not in {r[0] for r in got}


def test_substring_stage(stages):
    got = rows_of(stages[4])
    assert got == sorted(brute_substrings(rows_of(stages[3])))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    ids = {r[0]: [*lib.encode(r[1], add_special_tokens=False).ids, 1] for r in rows_of(stages[4])}
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    bins = defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(n for _, n in b) <= 4096
    assert len(bins) == -(-sum(map(len, ids.values())) // 4096)


def test_run_applies_all(spark, tmp_path, stages):
    stages[0].write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(got) == key(stages[5])


def test_run_writes_between_stages(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    read = []

    def stage(spark, docs, sf_dir):
        read.append({f.rsplit("/", 2)[1].split("-")[0] for f in docs.inputFiles()})
        return docs.withColumn("id", docs["id"] + 1)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert sorted(r["id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [3, 4, 5]
    assert read == [{"documents.parquet"}, {"weft"}, {"weft"}]
