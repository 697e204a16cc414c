"""Operators, sources and streams on small inputs."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from weft.errors import InvalidInputError
from weft.functions import kernel, sequences, statistics
from weft.operators import analytics, batch, factorize, planning
from weft.plans import registry
from weft.sources import factorfile, fasta
from weft.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    data = [(i, "".join(rng.choices("abcé \n"[: rng.randint(1, 6)], k=rng.randint(0, 300)))) for i in range(30)] + [(30, None), (31, ""), (32, "x" * 30_000)]
    return spark.createDataFrame(data, "id long, text string").repartition(3)


def test_factor_rows_count_and_reconstruct(texts):
    f = factorize.factorize(texts, "id", "text").cache()
    counts = {r["id"]: r["n_factors"] for r in factorize.count_factors(texts, "text").collect()}
    seen = {r["id"]: r["n"] for r in f.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v for k, v in counts.items() if v} == seen
    assert counts[30] is None and counts[31] == 0
    assert factorize.reconstruct(texts.filter("text IS NOT NULL"), f, "id", "text").filter("NOT ok").count() == 0
    assert f.filter("ref + length > start AND ref <> start").count() == 0


def test_partitions_do_not_matter(texts):
    want = rows(factorize.factorize(texts, "id", "text"), "id", "start")
    for n in (1, 4, 16):
        assert rows(factorize.factorize(texts, "id", "text", partitions=n), "id", "start") == want


def test_with_info(spark):
    df = spark.createDataFrame([(1, "abracadabra")], "id int, text string")
    r = factorize.factorize_with_info(df, "id", "text").first()
    assert r["n_factors"] == 8 and r["factors"][7]["ref"] == 0 and r["input_size"] == 11
    assert r["alphabet"]["size"] == 5 and r["alphabet"]["total_length"] == 11


def test_reference_text_and_dna(spark):
    t = spark.createDataFrame([(1, "world hello")], "id int, text string")
    got = factorize.factorize_with_reference(t, "hello world", "id", "text")
    assert rows(got.select("start", "length", "ref", "target_start"), "start") == [(12, 5, 6, 0), (17, 1, 5, 5), (18, 5, 0, 6)]
    d = spark.createDataFrame([(1, "gatcgatc")], "id int, seq string")
    assert rows(factorize.factorize_dna_with_reference(d, "ATCGATCGATCG", "id", "seq").select("start", "length", "ref", "is_rc"), "start") == [(13, 8, 3, False)]
    with pytest.raises(ValueError):
        factorize.factorize_dna_with_reference(d, "", "id", "seq")


def test_multiple_sequences_flag_sentinels(spark):
    df = spark.createDataFrame([("f", 0, "ATCG"), ("f", 1, "gcta"), ("f", 2, "")], "file string, k int, seq string")
    for with_rc in (True, False):
        f = factorize.factorize_multiple(df, "file", "k", "seq", with_rc=with_rc)
        assert [tuple(r) for r in f.filter("is_sentinel").select("start", "length", "ref", "seq_idx").collect()] == [(4, 1, 4, 0)]
        assert f.agg(F.sum("length")).first()[0] == 9
    got = rows(analytics.per_sequence_counts(f, "file"), F.col("seq_idx").asc_nulls_last())
    assert [r[1] for r in got] == [0, 1, None] and got[2][2] == got[0][2] + got[1][2]
    assert rows(analytics.sequence_boundaries(f, "file"), "seq_idx") == [("f", 0, 0, 4), ("f", 1, 5, 9)]
    n = factorize.count_factors_multiple(df, "file", "k", "seq", with_rc=False).first()["n_factors"]
    assert n == f.count()


def test_prepare_limits_and_errors(spark):
    many = spark.createDataFrame([("g", i, "ATCG") for i in range(126)], "grp string, k int, seq string")
    with pytest.raises(Exception, match="Too many sequences"):
        sequences.prepare_sequences(many, "grp", "k", "seq", with_rc=True).collect()
    assert sequences.prepare_sequences(many, "grp", "k", "seq", with_rc=False).first()["n_sequences"] == 126
    bad = spark.createDataFrame([("g", 0, "ATCGN")], "grp string, k int, seq string")
    with pytest.raises(Exception, match="Invalid nucleotide"):
        sequences.prepare_sequences(bad, "grp", "k", "seq", with_rc=True).collect()
    two = spark.createDataFrame([("g", 0, "ATCG"), ("g", 1, "GCTA")], "grp string, k int, seq string")
    r = sequences.prepare_sequences(two, "grp", "k", "seq", with_rc=False).first()
    assert (r["prepared_length"], r["sentinel_positions"]) == (9, [4])


def test_types_and_validation(spark):
    df = spark.createDataFrame([("ATCGATCG",), ("ACDEFGHIKLMNPQRSTVWY",), ("Hello World",), ("",)], "s string")
    assert [r[0] for r in df.select(sequences.sequence_type(F.col("s"))).collect()] == ["dna", "protein", "text", "text"]
    raw = spark.createDataFrame([(bytearray(b"\x80\x81\x82"),), (bytearray(b"ATCG"),)], "b binary")
    assert [r[0] for r in raw.select(sequences.binary_type(F.col("b"))).collect()] == ["binary", "dna"]
    for bad in ("", "a\0b", "é"):
        with pytest.raises(Exception, match="Input"):
            spark.createDataFrame([(bad,)], "s string").select(sequences.validate_text(F.col("s"))).collect()
    ok = spark.createDataFrame([("ab\0",)], "s string")
    assert ok.select(sequences.validate_text(F.col("s"))).first()[0] == "ab\0"


def test_reference_bit(spark):
    df = spark.createDataFrame([(5, True), (5, False), (0, True)], "ref long, rc boolean").withColumn("p", sequences.pack_ref(F.col("ref"), F.col("rc")))
    assert df.filter(sequences.is_rc(F.col("p")) != F.col("rc")).count() == 0
    assert df.filter(sequences.rc_ref(F.col("p")) != F.col("ref")).count() == 0


def test_alphabet(spark):
    df = spark.createDataFrame([(1, "ATCGATCG"), (2, "a.a$b")], "id int, text string")
    assert rows(sequences.alphabet_profile(df, "id", "text").filter("id = 1"), "id") == [(1, 4, 2.0, 8)]
    assert rows(sequences.alphabet_top(df, "id", "text").filter("id = 1"), "rank") == [(1, 1, "A", 2), (1, 2, "T", 2), (1, 3, "C", 2), (1, 4, "G", 2)]
    assert rows(sequences.alphabet_top(df, "id", "text").filter("id = 2"), "rank") == [(2, 1, "a", 2), (2, 2, ".", 1), (2, 3, "$", 1), (2, 4, "b", 1)]


def test_fasta_policies(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">a one\nATcg\n\nNN at\n>b\n>a again\nGG\r\n")
    got = rows(fasta.read_fasta(spark, str(p)).select("seq_idx", "seq_id", "header", "seq", "n_removed"), "seq_idx")
    assert got == [(0, "a", "a one", "ATCGAT", 2), (2, "a", "a again", "GG", 0)]
    assert fasta.read_fasta(spark, str(p), empty="keep").count() == 3
    assert rows(fasta.read_fasta(spark, str(p), duplicates="last").select("seq_idx", "seq"), "seq_idx") == [(0, "GG")]
    with pytest.raises(Exception, match="invalid nucleotide"):
        fasta.read_fasta(spark, str(p), ambiguous="strict").collect()
    for text, what in (("ACGT\n>a\nA", "before the first header"), (">\nA", "empty header"), ("\n", "no record")):
        p.write_text(text)
        with pytest.raises(Exception, match=what):
            fasta.read_fasta(spark, str(p)).collect()
    checked = batch.checked(spark.createDataFrame([("f", ">a\nA"), ("g", "A")], "file string, text string"), "file", "text")
    assert rows(checked.select("file", "ok"), "file") == [("f", True), ("g", False)]


def test_fasta_round_trip(spark, tmp_path):
    rng = random.Random(5)
    recs = spark.createDataFrame([("f", i, f"s{i}", f"s{i} x", "".join(rng.choices("ACGT", k=n)), 0) for i, n in enumerate((1, 79, 80, 81, 200))], "file string, seq_idx int, seq_id string, header string, seq string, n_removed int")
    fasta.write_fasta(recs, str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r["seq_id"], r["seq"]) for r in back.collect()) == sorted((r["seq_id"], r["seq"]) for r in recs.collect())
    assert rows(fasta.file_types(recs), "file") == [("f", "dna")]
    with pytest.raises(Exception, match="not a protein"):
        fasta.proteins(recs.withColumn("seq", F.lit("ACB"))).collect()


def test_factor_file_format():
    data = struct.pack("<6Q", 0, 3, 1, 3, 2, 2) + struct.pack("<8s5Q", factorfile.MAGIC, 2, 0, 0, 48, 5)
    assert [f[:3] for f in factorfile.decode(data)] == [(0, 3, 1), (3, 2, 2)]
    assert factorfile.encode([(0, 3, 1), (3, 2, 2)]) == data
    full = factorfile.encode([(0, 3, 1, True), (3, 1, 3)], ["a", "b"], [1])
    assert factorfile.read_footer(full) == {"num_factors": 2, "num_sequences": 2, "num_sentinels": 1, "total_length": 4, "names": ["a", "b"], "sentinels": [1]}
    assert list(factorfile.decode(full))[0] == (0, 3, 1, True)
    for bad in (b"x" * 23, data.replace(b"v2", b"v3"), data[24:]):
        with pytest.raises(InvalidInputError):
            factorfile.read_footer(bad)


def test_batch_writes_and_skips(spark, tmp_path):
    for n in ("one", "two"):
        (tmp_path / f"{n}.fasta").write_text(f">{n}\nATGCATTTAACACA\n>x\nGATTACA\n")
    out, paths = f"file://{tmp_path}/out", [str(tmp_path / "one.fasta"), str(tmp_path / "two.fasta")]
    done = batch.run_batch(spark, paths, out)
    assert done.count() == 4
    meta = factorfile.read_metadata(spark, f"{out}/*/*.bin")
    assert rows(meta.select("num_sentinels", "total_length", "error").distinct(), "num_sentinels") == [(1, 22, None)]
    back = factorfile.read_factors(spark, f"{out}/with_reverse_complement/one.bin")
    want = list(kernel.rc_factors(["ATGCATTTAACACA", "GATTACA"]))
    assert rows(back.select("start", "length", "ref", "is_rc"), "start") == want
    assert back.filter("is_sentinel").count() == 1
    (tmp_path / "out/with_reverse_complement/two.bin").write_bytes(b"broken")
    assert batch.run_batch(spark, paths, out, skip=True).count() == 1
    lst = tmp_path / "list.txt"
    lst.write_text("# no\n\n a.fasta \n")
    assert rows(batch.read_file_list(spark, str(lst)), "file") == [("a.fasta",)]


def test_complexity_and_shuffle(spark, tmp_path):
    rng = random.Random(7)
    seq = "ATCG" * 40
    recs = spark.createDataFrame([("f", 0, "s", "s h", seq), ("f", 1, "r", "r h", "".join(rng.choices("ACGT", k=160)))], "file string, seq_idx int, seq_id string, header string, seq string")
    t = batch.complexity_table(recs)
    assert t.columns == ["sequence_id", "header", "length", "complexity_w_rc", "complexity_no_rc"]
    batch.write_complexity_tsv(t, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    s = {r["seq_id"]: r["ratio"] for r in batch.shuffle_analysis(recs).collect()}
    assert s["s"] < 0.5
    mixed = analytics.shuffle_texts(recs, "seq_id", "seq", 1)
    assert all(sorted(a["seq"]) == sorted(b["seq"]) for a, b in zip(recs.orderBy("seq_idx").collect(), mixed.orderBy("seq_idx").collect()))


def test_strand_grid(spark):
    f = spark.createDataFrame([(0, 4, 0, False), (0, 4, 0, True), (0, 2, 0, True)], "start long, length long, ref long, is_rc boolean")
    got = {(r["y_bin"], r["x_bin"]): r for r in analytics.strand_bias_grid(f, 4, 2).collect()}
    assert {k: v["forward"] for k, v in got.items() if v["forward"]} == {(0, 0): 2, (1, 1): 2}
    assert {k: v["rc"] for k, v in got.items() if v["rc"]} == {(0, 0): 2, (0, 1): 2, (1, 0): 2}
    assert got[(0, 0)]["bias"] == pytest.approx(math.log2(0.5 / (1 / 3)), abs=1e-6)


def test_registered_grid_holds_long_items(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd", k=n)) for n in (40, 700, 512)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["strand_bias_grid"](spark, str(tmp_path)).collect()
    assert sum(r["forward"] + r["rc"] for r in got) == pytest.approx(sum(map(len, texts)), abs=1e-3)
    assert max(r["x_bin"] for r in got) == 699 // 64


def test_significance(spark):
    real = spark.createDataFrame([(x,) for x in (50, 60, 70, 80, 90)], "length long")
    control = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5] * 20], "length long")
    curve = analytics.significance_curve(real, control).cache()
    assert [r["s0"] for r in curve.orderBy("length").collect()] == pytest.approx([1, 0.8, 0.6, 0.4, 0.2])
    assert {r["rarity"] for r in analytics.rarity_scores(real, curve).collect()} == {0.0}
    assert analytics.length_threshold(curve, 2.0).first()["l_star"] == 5
    some = spark.createDataFrame([(0,), (1,), (5,), (6,)], "length long")
    gap = curve.filter("length IN (1, 3, 5)")
    mid = spark.createDataFrame([(2,), (4,)], "length long")
    assert {r["length"]: round(r["rarity"], 9) for r in analytics.rarity_scores(mid, gap).collect()} == {2: 0.8, 4: 0.4}
    assert {r["length"]: r["rarity"] for r in analytics.rarity_scores(some, curve).collect()} == pytest.approx({0: 1.0, 1: 1.0, 5: 0.2, 6: 0.0})


def test_shuffled_controls_take_all_items(spark, tmp_path):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "".join(rng.choices("ab", k=60)) + "abcabd" * (i + 1)) for i in range(5)], "item_id long, text string")
    df.write.parquet(str(tmp_path / "benchmark.parquet"))

    def lengths(text):
        out, i = [], 0
        while i < len(text):
            n = 1
            while i + n < len(text) and text.find(text[i : i + n + 1], 0, i) >= 0:
                n += 1
            out.append(n)
            i += n
        return out

    real = {r["item_id"]: lengths(r["text"]) for r in df.collect()}
    control = [n for r in analytics.shuffle_texts(df, "item_id", "text", registry.SEED).collect() for n in lengths(r["text"])]
    tail = {n: sum(x >= n for x in control) / len(control) for n in control}
    n_real = sum(map(len, real.values()))
    ask = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    curve = ask("significance_curve")
    assert {r["length"]: r["s0"] for r in curve} == pytest.approx(tail) == {r["length"]: r["s0"] for r in ask("significance_tail")}
    assert all(r["expected_fp"] == pytest.approx(n_real * r["s0_upper"], abs=1e-5) for r in curve)
    assert ask("length_threshold")[0]["l_star"] == min((r["length"] for r in curve if r["expected_fp"] <= registry.THRESHOLD), default=None)
    assert {r["length"]: r["p_any_ge"] for r in ask("p_any_ge")} == pytest.approx({n: 1 - math.exp(-n_real * s) for n, s in tail.items()})
    rare = ask("rarity_scores")
    assert sorted((r["id"], r["length"]) for r in rare) == sorted((i, n) for i, x in real.items() for n in x)
    assert all(r["rarity"] == pytest.approx(tail.get(r["length"], 0 if r["length"] > max(tail) else r["rarity"])) for r in rare)


def test_clopper_pearson():
    up = statistics.clopper_pearson_upper
    assert up(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100)) and up(100, 100) == 1.0
    assert 0.08 < up(5, 100) < 0.15 and 0.55 < up(50, 100) < 0.65
    # The bound solves P(X <= k) = alpha.
    for k, n in ((1, 10), (7, 20), (300, 1000)):
        p = up(k, n, 0.05)
        assert sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    with pytest.raises(ValueError):
        up(2, 1)


def test_heatmap_counts(spark):
    f = spark.createDataFrame([(i * 10, 1 + i % 9, 0, i % 3 == 0) for i in range(100)], "start long, length long, ref long, is_rc boolean")
    h = analytics.space_scale_heatmap(f, bin_bp=100)
    assert h.agg(F.sum("n")).first()[0] == 100 and h.filter("weighted < n").count() == 0


def test_estimates(spark):
    df = spark.createDataFrame([(1000,), (500_000,), (5_000_000,), (50_000_000,)], "size long")
    assert [r[0] for r in df.select(planning.thread_decision(F.col("size"), 16)).collect()] == [1, 4, 8, 16]
    gb = spark.createDataFrame([(1.0,), (3.0,), (128.0,), (129.0,), (200.0,)], "gb double")
    assert [r[0] for r in gb.select(planning.cluster_memory(F.col("gb"))).collect()] == [2, 4, 128, 192, 256]
    e = planning.estimate_from_trends(df, "size", {"time": {"slope": 1.0, "intercept": 0.0}}, threads=4).first()
    assert e["seconds"] == pytest.approx(1000 * 0.4 / 1000)
    t = spark.createDataFrame([(10.0, 30.0), (100.0, 300.0), (1000.0, 3000.0)], "x double, y double")
    r = planning.fit_trend(t, "x", "y").first()
    assert (r["slope"], 10 ** r["intercept"], r["r_squared"]) == pytest.approx((1, 3, 1))


def test_stream_settles_to_the_whole_parse(spark, tmp_path):
    rng = random.Random(9)
    text = "".join(rng.choices("abc", k=400))
    schema = "key string, seq long, chunk binary"
    src = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([("k", k * 2 + j, bytearray(text[k * 100 + j * 50 : k * 100 + j * 50 + 50].encode())) for j in range(2)], schema).coalesce(1).write.mode("append").parquet(str(src))
        df = spark.readStream.schema(schema).parquet(str(src))
        q = incremental.factorize_stream(df).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("start", "length", "ref"), "start")
    want = [f for f in kernel.lz_factors(text.encode()) if f[0] + f[1] < len(text)]
    assert got == want


def test_sql_names(spark):
    sequences.register_sql(spark)
    assert spark.sql("SELECT revcomp('AACG'), sanitize_dna('xaN'), sequence_type('ACGT'), lz_count('abracadabra'), dna_rc_count('ATGCAT')").first()[:] == ("CGTT", "A", "dna", 8, 4)
    assert spark.sql("SELECT * FROM dna_rc_factors('ATGCAT')").count() == 4


def test_registered_complexity_and_trend_equal_brute_force(spark, tmp_path):
    rng = random.Random(14)
    data = [(i, "".join(rng.choices("abcé "[: rng.randint(2, 5)], k=rng.randint(1, 400))), rng.choice(["en", "de"])) for i in range(40)] + [(40, "", "en"), (41, None, "de")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def count(t):
        n, i = 0, 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t.find(t[i : i + k + 1], 0, i) >= 0:
                k += 1
            n, i = n + 1, i + k
        return n

    got = {r["lang"]: r for r in registry.QUERIES["lz_complexity_by_lang"](spark, str(tmp_path)).collect()}
    line = {r["lang"]: r for r in registry.QUERIES["trend_fit"](spark, str(tmp_path)).collect()}
    for lang in ("en", "de"):
        own = [t.encode() for _, t, x in data if x == lang and t is not None]
        assert (got[lang]["n_factors"], got[lang]["total_length"]) == (sum(map(count, own)), sum(map(len, own)))
        x, y = ([math.log10(f(t)) for t in own if t] for f in (len, count))
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        assert (line[lang]["slope"], line[lang]["intercept"]) == pytest.approx((slope, my - slope * mx), abs=2e-6)
