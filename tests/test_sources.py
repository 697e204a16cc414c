"""Sources, chunked parses, reference files and the command line."""

import random

import pytest

from pyspark.sql import functions as F

from weft.__main__ import main
from weft.functions import kernel
from weft.operators import batch, chunked, factorize
from weft.sources import datasource, factorfile, fasta, texts


def test_chunked_equals_sequential(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcd"[: rng.randint(1, 4)], k=rng.choice([0, 1, 50, 400])))) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string")
    key = ["id", "factor_idx", "start", "length", "ref", "is_rc"]
    want = sorted(map(tuple, factorize.factorize(df, "id", "text").select(*key).collect()))
    for n in (7, 64, 1000):
        assert sorted(map(tuple, chunked.factorize_chunked(df, "id", "text", chunk_bytes=n).select(*key).collect())) == want


def test_files_as_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"abracadabra")
    df = texts.read_files(spark, str(tmp_path / "t.txt"))
    f = factorize.factorize(df, "file", "data")
    assert f.count() == 8 and texts.file_sizes(spark, str(tmp_path / "t.txt")).first()["size"] == 11
    texts.write_factor_text(f.withColumn("file", F.lit("t")), "file", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).orderBy(F.split("value", "\t")[0].cast("int")).first()["value"] == "0\t1\t0\tfalse"
    (tmp_path / "x.fa").write_text(">a b\nACG\n>c\nT T\n")
    assert texts.nucleotide_counts(spark, str(tmp_path / "x.fa")).first()["n_nucleotides"] == 5
    (tmp_path / "trends.json").write_text('{"a": {"slope": 1}}')
    assert texts.load_trends(spark, str(tmp_path / "trends.json")) == {"a": {"slope": 1}}


def test_data_source(spark, tmp_path):
    data = [(0, 1, 0, False), (1, 1, 1, False), (2, 2, 0, True)]
    (tmp_path / "a.bin").write_bytes(factorfile.encode(data, ["x"], [1]))
    datasource.register(spark)
    got = spark.read.format("lzfactors").load(f"file://{tmp_path}")
    assert [tuple(r) for r in got.select("start", "length", "ref", "is_rc", "is_sentinel").orderBy("start").collect()] == [(*f, k == 1) for k, f in enumerate(data)]


def test_reference_files(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">r1\nATCGATCG\n>r2\nTTTA\n")
    (tmp_path / "t.fa").write_text(">t1\nGATC\n>t2\nTAAA\n")
    r, t = (fasta.read_fasta(spark, str(tmp_path / n)) for n in ("r.fa", "t.fa"))
    got = batch.factorize_with_reference_files(r, t)
    want = list(kernel.rc_factors(["ATCGATCG", "TTTA", "GATC", "TAAA"], 14))
    assert [tuple(x) for x in got.select("start", "length", "ref", "is_rc").orderBy("start").collect()] == want
    assert got.agg(F.min("target_start")).first()[0] == 0
    assert [x["start"] for x in got.filter("is_sentinel").collect()] == [18]


def test_command_line(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">s\nATGCATTTAACACA\n")
    main(["factorize", str(tmp_path / "s.fa"), "--out", f"file://{tmp_path}/out", "--mode", "with_reverse_complement"])
    assert factorfile.read_factors(spark, f"{tmp_path}/out/*/s.bin").count() == len(list(kernel.rc_factors(["ATGCATTTAACACA"])))
    main(["complexity", str(tmp_path / "s.fa"), "--out", str(tmp_path / "c")])
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).first()["length"] == "14"


def test_chunked_with_reverse_complements(spark):
    rng = random.Random(13)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT"[: rng.randint(2, 4)], k=rng.choice([1, 50, 300])))) for i in range(8)], "id int, seq string")
    key = ["id", "factor_idx", "start", "length", "ref", "is_rc"]
    for mode in ("reference", "exact"):
        want = sorted(map(tuple, factorize.factorize_dna_rc(df, "id", "seq", mode=mode).select(*key).collect()))
        got = chunked.factorize_chunked(df, "id", "seq", chunk_bytes=29, tasks=3, with_rc=True, mode=mode)
        assert sorted(map(tuple, got.select(*key).collect())) == want


def test_batch_of_equal_stems_and_bad_files(spark, tmp_path):
    for folder, text in (("a", ">s1 x\nATGCATTTAACACA\n>s2\nGATTACA\n"), ("b", ">t1\nACGTACGTAA\n"), ("c", "ACGT\n>late\nA\n"), ("d", ">only\nNNN\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.fa").write_text(text)
    out = f"file://{tmp_path}/out"
    paths = [str(tmp_path / n / "x.fa") for n in "abcd"] + [str(tmp_path / "no.fa")]
    got = {(r["mode"], r["file"].rsplit("/", 2)[-2]): r for r in batch.run_batch(spark, paths, out).collect()}
    assert len(got) == 10 and {k[1] for k, r in got.items() if r["error"]} == {"c", "d", tmp_path.name}
    rc = [got[batch.WITH_RC, n] for n in "ab"]
    assert len({r["output"] for r in rc}) == 2 and [r["n_factors"] for r in rc] == [len(list(kernel.rc_factors(x))) for x in (["ATGCATTTAACACA", "GATTACA"], ["ACGTACGTAA"])]
    meta = {r["file"].rsplit("/", 1)[-1]: r for r in factorfile.read_metadata(spark, f"{out}/{batch.WITH_RC}/*.bin").collect()}
    a, b = (meta[r["output"].rsplit("/", 1)[-1]] for r in rc)
    assert (a["names"], a["num_sequences"], a["num_sentinels"], a["total_length"]) == (["s1", "s2"], 2, 1, 22)
    assert (b["names"], b["num_sequences"], b["num_sentinels"], b["total_length"]) == (["t1"], 1, 0, 10)
    mark = factorfile.read_factors(spark, rc[0]["output"]).filter("is_sentinel").first()
    assert (mark["factor_idx"], mark["start"], mark["length"]) == (a["sentinels"][0], 14, 1)
    again = batch.run_batch(spark, paths, out, skip=True)
    assert again.filter("error IS NULL").count() == 0 and again.count() == 6


def test_batch_per_sequence(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s 1\nATGCATTTAACACA\n>s 2\nGATTACA\n>t\nACGT\n")
    got = batch.run_batch(spark, [str(tmp_path / "x.fa")], f"file://{tmp_path}/out", modes=batch.WITHOUT_RC, per_sequence=True).collect()
    want = {"s-0": "ATGCATTTAACACA", "s-1": "GATTACA", "t": "ACGT"}
    assert {r["output"].rsplit("/", 1)[-1]: r["n_factors"] for r in got} == {f"{k}.bin": len(list(kernel.lz_factors(v.encode()))) for k, v in want.items()}
    meta = factorfile.read_metadata(spark, f"{tmp_path}/out/*/x/*.bin")
    assert sorted((r["names"], r["num_sequences"], r["total_length"]) for r in meta.collect()) == [(["s"], 1, 7), (["s"], 1, 14), (["t"], 1, 4)]


def test_reference_files_are_written(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">r1\nATCGATCG\n>r2\nTTTA\n")
    (tmp_path / "t.fa").write_text(">t1\nGATC\n")
    r, t = (fasta.read_fasta(spark, str(tmp_path / n)) for n in ("r.fa", "t.fa"))
    batch.write_reference_batch(r, t, f"file://{tmp_path}/o", "both")
    m = factorfile.read_metadata(spark, f"{tmp_path}/o/both.bin").first()
    assert (m["names"], m["num_sequences"], m["total_length"]) == (["r1", "r2", "t1"], 3, 4)
    text = spark.createDataFrame([("w", "world hello")], "id string, text string")
    batch.write_with_reference(text, "hello world", "id", "text", f"file://{tmp_path}/w")
    m = factorfile.read_metadata(spark, f"{tmp_path}/w/w.bin").first()
    assert (m["num_factors"], m["num_sequences"], m["names"], m["total_length"]) == (3, 2, [], 11)


def test_fasta_by_type(spark, tmp_path):
    (tmp_path / "d.fa").write_text(">a\nACGTACGT\n")
    (tmp_path / "p.fa").write_text(">p\nMKLV\n")
    got = {r["type"]: r for r in fasta.read_fasta_auto(spark, [str(tmp_path / "d.fa"), str(tmp_path / "p.fa")]).collect()}
    assert [f["length"] for f in got["dna"]["factors"]] == [1, 1, 1, 1, 4] and got["protein"]["factors"] is None and got["protein"]["seq"] == "MKLV"
    (tmp_path / "p.fa").write_text(">p\nMK1V\n")
    with pytest.raises(Exception, match="cannot tell"):
        fasta.read_fasta_auto(spark, str(tmp_path / "p.fa")).collect()


def test_data_source_writes(spark, tmp_path):
    datasource.register(spark)
    df = spark.createDataFrame([(0, 1, 0, False), (1, 1, 1, False), (2, 2, 0, True)], "start long, length long, ref long, is_rc boolean").coalesce(1)
    df.write.format("lzfactors").mode("append").save(f"file://{tmp_path}/f")
    back = spark.read.format("lzfactors").load(f"file://{tmp_path}/f")
    assert [tuple(r) for r in back.select("start", "length", "ref", "is_rc").orderBy("start").collect()] == [tuple(r) for r in df.collect()]


def test_plot_data_from_the_command_line(spark, tmp_path):
    (tmp_path / "s.bin").write_bytes(factorfile.encode([(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 2, 0, True)], ["a", "b"], [1]))
    for task, n in (("cumulative", 3), ("ccdf", 2), ("segments", 3), ("strand-bias", None), ("space-scale", None)):
        assert main([task, str(tmp_path / "s.bin"), "--out", str(tmp_path / task), "--bins", "5"]) == 0
        got = spark.read.csv(str(tmp_path / task), sep="\t", header=True).count()
        assert got == n if n else got > 0
    main(["segments", str(tmp_path / "s.bin"), "--out", str(tmp_path / "one"), "--sequence", "1"])
    assert spark.read.csv(str(tmp_path / "one"), sep="\t", header=True).count() == 2
