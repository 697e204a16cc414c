"""Batches of FASTA files: modes, skipping of finished outputs, errors as data, shuffled controls, complexity tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import sequences
from weft.operators import analytics, factorize
from weft.sources import factorfile, fasta

WITH_RC, WITHOUT_RC = "with_reverse_complement", "without_reverse_complement"
MODES = {WITH_RC: (WITH_RC,), WITHOUT_RC: (WITHOUT_RC,), "both": (WITH_RC, WITHOUT_RC)}


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file): the lines of a list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("file")).filter("file <> '' AND NOT startswith(file, '#')")


def stem(file: Column) -> Column:
    """The name of a file without its folder, compression and last extension."""
    name = F.regexp_replace(F.regexp_extract(file, r"([^/]+)$", 1), r"(?i)(\.gz|\.gzip)$", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_names(files: DataFrame) -> DataFrame:
    """(file, name): what each file's outputs are called: its stem, or where several of ``files`` share one the stem and
    a digest of the whole path, so that no two of them meet in one output."""
    own = files.select("file").distinct().withColumn("stem", stem(F.col("file")))
    shared = own.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") > 1, F.concat_ws("-", "stem", F.substring(F.md5("file"), 1, 12))).otherwise(F.col("stem"))
    return own.join(shared, "stem").select("file", name.alias("name"))


def pending(wanted: DataFrame, spark: SparkSession, done: str | None) -> DataFrame:
    """(file, mode) rows of ``wanted`` without a valid, non-empty factor file <done>/<mode>/<name>.bin."""
    if done is None:
        return wanted
    try:
        have = factorfile.read_metadata(spark, f"{done}/*/*.bin").filter("error IS NULL AND num_factors > 0")
    except AnalysisException:  # nothing there yet
        return wanted
    have = have.select(F.regexp_extract("file", r"([^/]+)/[^/]+\.bin$", 1).alias("mode"), F.regexp_extract("file", r"([^/]+)\.bin$", 1).alias("name"))
    names = output_names(wanted)
    safe = sequences.sanitize_filename(F.col("name"))
    return wanted.join(names.select("file", safe.alias("name")), "file").join(have, ["mode", "name"], "left_anti").drop("name")


def factorize_files(records: DataFrame, modes: str = "both", *, rc_mode: str = "reference") -> DataFrame:
    """The factors of each file's joined records in each mode: (file, mode, factor_idx, ...)."""
    out = None
    for mode in MODES[modes]:
        one = factorize.factorize_multiple(records, "file", "seq_idx", "seq", with_rc=mode == WITH_RC, mode=rc_mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def complexity_table(records: DataFrame, *, rc_mode: str = "reference", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, sequence_id, header, length, complexity_w_rc, complexity_no_rc): both factor counts of each record."""
    df = factorize.count_factors_dna_rc(records, "seq", out="complexity_w_rc", mode=rc_mode)
    df = factorize.count_factors(df, "seq", out="complexity_no_rc")
    return df.select(*keep, F.col("seq_id").alias("sequence_id"), "header", F.length("seq").cast("long").alias("length"), "complexity_w_rc", "complexity_no_rc")


def write_complexity_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, sep="\t", header=True)


def shuffle_analysis(records: DataFrame, *, seed: int = 0, rc_mode: str = "reference") -> DataFrame:
    """(seq_id, original, shuffled, ratio): factor counts of each record and of a shuffled copy."""
    counts = factorize.count_factors_dna_rc(records, "seq", out="original", mode=rc_mode)
    control = factorize.count_factors_dna_rc(analytics.shuffle_texts(records, "seq_id", "seq", seed), "seq", out="shuffled", mode=rc_mode)
    return counts.select("file", "seq_idx", "seq_id", "original").join(control.select("file", "seq_idx", "shuffled"), ["file", "seq_idx"]).select("file", "seq_id", "original", "shuffled", (F.col("original") / F.col("shuffled")).alias("ratio"))


def checked(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, ok, error): whether each file parses, as data instead of a failed job."""
    body = F.concat(F.lit("\n"), F.col(text))
    before = F.trim(F.regexp_replace(F.get(F.split(body, "\n[ \t]*>"), F.lit(0)), r"\s+", "")) != ""
    error = F.when(before, "sequence data before the first header").when(~body.rlike("\n[ \t]*>"), "no record").when(body.rlike("\n[ \t]*>[ \t]*(\n|$)"), "empty header")
    return files.select(F.col(file).alias("file"), error.isNull().alias("ok"), error.alias("error"))


def _split(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """The files that parse (file, text), those that do not (file, error), and paths without a file, with an error."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        found = hadoop.getFileSystem(conf).globStatus(hadoop)
        there.append(p) if found else missing.append((p, "no such file"))
    files = fasta.read_whole(spark, there) if there else spark.createDataFrame([], "file string, text string")
    state = checked(files, "file", "text")
    good = files.join(state.filter("ok").select("file"), "file", "left_semi")
    return good, state.filter("NOT ok").select("file", "error"), missing


def _headers(records: DataFrame) -> DataFrame:
    """(file, names, n_sequences): the ids of each file's records, in order."""
    x = F.sort_array(F.collect_list(F.struct("seq_idx", "seq_id")))
    return records.groupBy("file").agg(x.alias("x")).select("file", F.transform("x", lambda r: r["seq_id"]).alias("names"), F.size("x").cast("long").alias("n_sequences"))


def run_batch(spark: SparkSession, paths: list[str], out: str, *, modes: str = "both", skip: bool = False, per_sequence: bool = False, rc_mode: str = "reference") -> DataFrame:
    """Factorize files into <out>/<mode>/<name>.bin; a row per file and mode: (mode, file, name, output, n_factors, error).

    Files that cannot be read as FASTA, and paths without a file, are rows with an error; the others are written. A
    file's records are joined by sentinels, and its footer holds their ids and sentinel factors. ``per_sequence``
    factorizes each record by itself into <out>/<mode>/<name>/<seq_id>.bin (<seq_id>-<place> where ids meet).
    ``skip`` leaves out what has a valid output.
    """
    good, bad, missing = _split(spark, paths)
    records = fasta.parse_fasta(good, "file", "text")
    empty = good.select("file").join(records.select("file").distinct(), "file", "left_anti").select("file", F.lit("no record with a nucleotide").alias("error"))
    bad = bad.unionByName(empty).unionByName(spark.createDataFrame(missing, "file string, error string"))
    wanted = records.select("file").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, MODES[modes]))))
    todo = pending(wanted, spark, out if skip and not per_sequence else None)
    names = output_names(wanted)
    errors = bad.withColumn("mode", F.explode(F.array(*map(F.lit, MODES[modes]))))
    found = errors.select("mode", "file", stem(F.col("file")).alias("name"), F.lit(None).cast("string").alias("output"), F.lit(0).cast("long").alias("n_factors"), "error")
    found = spark.createDataFrame(found.collect(), found.schema)  # a row per file that failed
    for mode in MODES[modes]:
        own = records.join(todo.filter(F.col("mode") == mode).select("file"), "file", "left_semi").join(names, "file")
        if per_sequence:
            done = _write_each(own, f"{out}/{mode}", mode == WITH_RC, rc_mode)
        else:
            factors = factorize.factorize_multiple(own, "name", "seq_idx", "seq", with_rc=mode == WITH_RC, mode=rc_mode)
            done = factorfile.write_factors(factors, "name", f"{out}/{mode}", headers=_headers(own.withColumn("file", F.col("name"))).withColumnRenamed("file", "name"))
        one = done.withColumnRenamed("file", "output").join(names, "name").select(F.lit(mode).alias("mode"), "file", "name", "output", "n_factors", F.lit(None).cast("string").alias("error"))
        found = found.unionByName(one)
    return found


def _write_each(records: DataFrame, out: str, with_rc: bool, rc_mode: str) -> DataFrame:
    """(name, file, n_factors): a factor file of each record, in a folder for each ``name``."""
    spark = records.sparkSession
    again = F.count(F.lit(1)).over(Window.partitionBy("name", F.lower(sequences.sanitize_filename(F.col("seq_id"))))) > 1
    own = records.withColumn("leaf", F.when(again, F.concat_ws("-", "seq_id", "seq_idx")).otherwise(F.col("seq_id")))
    done = None
    for (name,) in own.select("name").distinct().collect():  # a folder per file
        mine = own.filter(F.col("name") == name)
        factors = factorize.factorize_dna_rc(mine, "leaf", "seq", mode=rc_mode) if with_rc else factorize.factorize(mine, "leaf", "seq")
        headers = mine.select("leaf", F.array("seq_id").alias("names"), F.lit(1).cast("long").alias("n_sequences"))
        one = factorfile.write_factors(factors, "leaf", f"{out}/{name}", headers=headers).select(F.lit(name).alias("name"), "file", "n_factors")
        done = one if done is None else done.unionByName(one)
    return spark.createDataFrame([], "name string, file string, n_factors long") if done is None else done


def complexity_batch(spark: SparkSession, paths: list[str], out: str, *, rc_mode: str = "reference") -> DataFrame:
    """The complexity table of each file as tab-separated text in <out>/complexity/name=<name>; (file, name, error)."""
    good, bad, missing = _split(spark, paths)
    records = fasta.parse_fasta(good, "file", "text")
    names = output_names(records)
    table = complexity_table(records.join(names, "file"), rc_mode=rc_mode, keep=("name", "seq_idx"))
    table.repartition("name").sortWithinPartitions("name", "seq_idx").drop("seq_idx").write.mode("overwrite").partitionBy("name").csv(f"{out}/complexity", sep="\t", header=True)
    failed = bad.unionByName(spark.createDataFrame(missing, "file string, error string")).select("file", stem(F.col("file")).alias("name"), "error")
    return names.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def write_reference_batch(reference: DataFrame, target: DataFrame, out: str, name: str, *, with_rc: bool = True, rc_mode: str = "reference") -> DataFrame:
    """Write the factors of ``factorize_with_reference_files`` into <out>/<name>.bin, with the ids of all records."""
    got = factorize_with_reference_files(reference, target, with_rc=with_rc, rc_mode=rc_mode).withColumn("name", F.lit(name))
    both = reference.select(F.lit(0).alias("side"), "file", "seq_idx", "seq_id").unionByName(target.select(F.lit(1).alias("side"), "file", "seq_idx", "seq_id"))
    ids = both.select(F.lit(name).alias("file"), F.struct("side", "file", "seq_idx").alias("seq_idx"), "seq_id")
    return factorfile.write_factors(got, "name", out, headers=_headers(ids).withColumnRenamed("file", "name"))


def write_with_reference(targets: DataFrame, reference: str | bytes, id_col: str, text: str, out: str, *, dna: bool = False, rc_mode: str = "reference") -> DataFrame:
    """Write each target's factors after one reference into <out>/<id>.bin; footers tell two sequences, without names."""
    got = factorize.factorize_dna_with_reference(targets, reference, id_col, text, mode=rc_mode) if dna else factorize.factorize_with_reference(targets, reference, id_col, text)
    headers = targets.select(id_col, F.array().cast("array<string>").alias("names"), F.lit(2).cast("long").alias("n_sequences"))
    return factorfile.write_factors(got, id_col, out, headers=headers)


def factorize_with_reference_files(reference: DataFrame, target: DataFrame, *, with_rc: bool = True, rc_mode: str = "reference") -> DataFrame:
    """The factors of all target records after all reference records, as one joined text.

    Targets may copy from references and from earlier targets. Starts are absolute; sentinels are flagged, and
    ``target_start`` counts from the first target.
    """
    first = reference.count()
    ordered = lambda df, side: df.select(F.lit("all").alias("joined"), F.struct(F.lit(side).alias("side"), "file", "seq_idx").alias("place"), "seq")
    both = ordered(reference, 0).unionByName(ordered(target, 1))
    got = factorize.factorize_multiple(both, "joined", "place", "seq", with_rc=with_rc, mode=rc_mode, start_sequence=first)
    offset = reference.agg(F.coalesce(F.sum(F.length("seq") + 1), F.lit(0))).first()[0]
    return got.drop("joined").withColumn("target_start", F.col("start") - offset)
