"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, fingerprint, html, langid, minhash, packing, quality, sharding, substrings, urls

WORDS = "the quick brown fox jumps over lazy dogs while seven green birds sing about rivers and mountains".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    base = prose(rng, 120)
    near = base.replace("fox", "cat", 1)
    rows = [(i, prose(rng, rng.randint(1, 200)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(40, base, "en", "s0"), (41, base, "en", None), (42, near, None, "s0"), (43, None, "en", "s0"), (44, "", "en", "s0"), (45, " \n\t ", None, None)]
    rows += [(46, "123 456 !!", "en", "s1"), (47, "héé " * 3000 + "ß", "de", "s1"), (48, base + "\n" + base, "de", "s2"), (49, "one", "de", "s2"), (50, "One", "de", "s2"), (None, "null id text here", "en", "s0")]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, data):
    clash = ["_w", "_h", "row", "text_", "kept", "n_words", "data", "spans", "shard", "lang_pred", "ids", "id", "tie", "_part", "_text", "label"]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in clash}).repartition(3)


OPERATORS = {
    "sharding": lambda d: sharding.shard_documents(d, shards=4),
    "substrings": substrings.substring_digests,
    "langid": langid.identify_languages,
    "quality": quality.judge_quality,
    "fingerprint": fingerprint.fingerprint_documents,
    "minhash": lambda d: minhash.near_duplicates(d, shingle=2),
    "bpe": lambda d: bpe.encode_digests(d, bpe.vocabulary()),
    "packing": lambda d: packing.pack_documents(d, bpe.vocabulary(), capacity=256),
}
FILTERS = {"quality": quality.clean_documents, "langid": langid.keep_identified, "minhash": minhash.drop_near_duplicates, "substrings": substrings.remove_repeats, "bpe": lambda d: bpe.encode_documents(d, bpe.vocabulary(), ids="ids").drop("ids")}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_per_document(docs, data, name):
    got = OPERATORS[name](docs)
    assert len(set(got.columns)) == len(got.columns)
    ids = [r[0] for r in got.select("doc_id").collect()]
    if name == "packing":
        assert set(ids) == {r[0] for r in data}
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in data), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(docs, name):
    got = FILTERS[name](docs)
    assert [c for c in got.columns] == [c for c in docs.columns if name != "bpe" or c != "ids"]
    assert 0 < got.count() <= docs.count()
    assert FILTERS[name](docs.filter("false")).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "no host", "<p>a"), (3, "http://WWW.example.com/en/x", ""), (4, "http://a.net/es/1", "<article>x</article>"), (None, "http://b.org", "<div class='comments'>c</div><p>t &lt; u</p>"), (3, "http://WWW.example.com/en/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "s", "text", "template", "id")})
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert {(1, "", "", None, "block"), (2, "", "", None, "block"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "a.net", "/es/1", "net/es/", "block")} < got
    assert urls.judge_urls(pages).count() == 6 and urls.judge_urls(pages.filter("false")).count() == 0
    text = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_main_text(pages).collect()}
    assert text == {(1, "", 0), (2, "a", 1), (3, "", 0), (4, "x", 1), (None, "t < u", 5)}
    assert html.extract_main_text(pages.filter("false")).count() == 0


def test_shards(docs):
    got = sharding.shard_documents(docs, shards=4).collect()
    n = sorted(sum(r["shard"] == k for r in got) for k in range(4))
    assert n[-1] - n[0] <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    null = next(r for r in got if r["doc_id"] == 43)
    assert (null["size"], null["text_crc32"]) == (16, 0)


def test_languages(docs):
    got = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    for i in (43, 44, 45, 46):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[47]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())


def test_near_duplicates(docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, shingle=2).collect()}
    assert [got[i]["component_id"] for i in (40, 41, 42)] == [40, 40, 40]
    assert [got[i]["n_shingles"] for i in (43, 44, 45, 49)] == [0, 0, 0, 1]
    assert got[50]["component_id"] == 49 and got[45]["kept"]
    assert minhash.drop_near_duplicates(docs).filter("doc_id IN (40, 41, 42)").count() == 1


def test_fingerprints(docs, data):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    order = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in data})
    text = dict(order)
    for i in range(44, 50):
        t, nxt = text[i], text[i + 1]
        c = len(t) // 4
        edited = t[: len(t) - c] + nxt[:c]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[40]["fingerprint"] == got[41]["fingerprint"] and got[40]["near_next"] == 1.0
    assert got[43]["fingerprint"] == "" and got[43]["near_next"] == 1.0


def test_merge_and_containment(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(900))), " ".join(map(str, range(300))))], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(fingerprint.containment(F.col("sb"), F.col("sa")), fingerprint.containment(F.col("sa"), F.col("sb")), F.size(fingerprint.merged(F.col("sa"), F.col("sb"))), F.size("sa")).first()
    assert r[0] == 1.0 and abs(r[1] - 1 / 3) < 0.15 and r[2] == r[3]


def test_encoded_documents_round_trip(docs):
    own = docs.select("doc_id", "text")
    coder = bpe.encoder(bpe.vocabulary())
    for r in bpe.encode_documents(own, bpe.vocabulary()).collect():
        assert r["ids"] == [int.from_bytes(coder.encode([r["text"]])[0][k : k + 4], "little") for k in range(0, len(coder.encode([r["text"]])[0]), 4)]
