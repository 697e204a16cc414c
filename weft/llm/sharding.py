"""Sharding by balanced label propagation.

Documents that share a link key are neighbours. Every document starts in a hashed shard; in each round the
linked documents of a key are drawn towards the shard that holds most of them. What may move from one shard
to another is a quota worked out from the shard-by-shard table of wishes (at most shards x shards rows on
the driver), so that no shard grows beyond its capacity; within a quota a hash of the document and the round
chooses. Keys with more documents than a share of a shard are split into sub-keys first, so no key gathers in
one task or outgrows a shard.

At the end the documents, in order of shard and key, are cut into runs whose counts differ by one at most;
keys at the edges of runs may be cut by that.

Defined results: a null text counts 16 bytes and has the checksum 0; null texts are each other's neighbours;
repeated rows are placed each by itself; ties go by hashes, then id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import drop_durable, durable, table

SHARDS = 40
ROUNDS = 5
#: A key with more documents than this share of a shard is split.
GROUP_SHARE = 8
#: How far over its even share a shard may grow while labels move.
SLACK = 0.25
#: Cells of a shard that are numbered apart from each other.
CELLS = 256


def move_quotas(held: np.ndarray, wish: np.ndarray, cap: float) -> np.ndarray:
    """The share of each wish (from, to) that may be granted so that no shard ends beyond ``cap``.

    A shard that would is given less from all others alike; that leaves more in those, hence the repeats.
    """
    share = np.ones_like(wish, dtype=float)
    for _ in range(200):
        moved = share * wish
        into = moved.sum(0)
        over = held + into - moved.sum(1) - cap
        tight = (over > 1e-6 * cap) & (into > 0)
        if not tight.any():
            break
        share[:, tight] *= np.clip(1 - over[tight] / into[tight], 0, 1)
    return share


def propagate_labels(rows: DataFrame, shards: int, *, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``rows`` (id, key, sub, linked, shard, ...) after the rounds of label propagation."""
    spark = rows.sparkSession
    names = rows.columns
    for turn in range(rounds):
        linked = rows.filter("linked")
        target = (
            linked.groupBy("key", "sub", "shard")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key", "sub")
            .agg(F.max(F.struct("n", F.xxhash64("key", "sub", "shard").alias("h"), "shard")).alias("best"))
            .select("key", "sub", F.col("best.shard").alias("target"))
        )
        wishes = rows.join(target, ["key", "sub"], "left").withColumn("target", F.coalesce("target", "shard"))
        counts = np.zeros((shards, shards))
        for a, b, n in wishes.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[a, b] = n
        held, wish = counts.sum(1), counts * (1 - np.eye(shards))
        if not wish.sum():
            break
        share = move_quotas(held, wish, held.sum() / shards * (1 + slack))
        granted = spark.createDataFrame([(int(a), int(b), float(share[a, b])) for a, b in zip(*np.nonzero(wish))], "shard int, target int, share double")
        draw = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        # At most shards x shards rows.
        moved = wishes.join(F.broadcast(granted), ["shard", "target"], "left").withColumn("shard", F.when(draw < F.col("share"), F.col("target")).otherwise(F.col("shard")))
        after = durable(moved.select(*names))
        if turn:
            drop_durable(rows)
        rows = after
    return rows


def even_runs(rows: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """``rows`` with the final shard and slot: runs in order of shard, cell and ``order``, of counts at most one apart."""
    spark = rows.sparkSession
    half, edge = CELLS // 2, CELLS // 4
    hashed = F.pmod(F.xxhash64("key", "sub"), F.lit(half)).cast("int")
    # Linked documents lie in the middle of a shard, so the ends of runs mostly fall between unlinked ones.
    cell = F.when(F.col("linked"), hashed + edge).when(hashed < edge, hashed).otherwise(hashed + half)
    rows = rows.withColumn("cell", cell)
    cells = sorted(map(tuple, rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).collect()))
    starts, total = [], 0
    for shard, cell, n in cells:
        starts.append((shard, cell, total))
        total += n
    base, more = divmod(total, shards)
    at = F.col("first") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order)) - 1
    # At most shards x CELLS rows.
    df = rows.join(F.broadcast(spark.createDataFrame(starts, "shard int, cell int, first long")), ["shard", "cell"]).withColumn("at", at.cast("long"))
    long, size = F.lit(more * (base + 1)), F.lit(max(base, 1))
    early = F.col("at") < long
    return df.withColumns(
        {
            "shard": F.when(early, F.expr(f"at div {base + 1}")).otherwise(more + F.floor((F.col("at") - long) / size)).cast("int"),
            "slot": F.when(early, F.col("at") % (base + 1)).otherwise((F.col("at") - long) % size).cast("long"),
        }
    ).drop("at", "first", "cell")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text: str = "text", link: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``link`` names the column whose equal values link documents; by default it is the text.
    """
    t = F.col(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).alias("crc"),
        F.xxhash64(F.col(link or text)).alias("key"),
    )
    rows = durable(rows)
    most = max(1, rows.count() // (shards * GROUP_SHARE))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Each sub-key draws its members by their hash; copies of one id stay together.
    sub = F.coalesce(F.pmod(F.xxhash64("id", F.lit("sub")), F.ceil(F.col("n") / most)), F.lit(0)).cast("int")
    rows = rows.join(groups, "key", "left").select(
        "id", "size", "crc", "key", sub.alias("sub"), F.col("n").isNotNull().alias("linked"), F.pmod(F.xxhash64("id", F.lit("start")), F.lit(shards)).cast("int").alias("shard")
    )
    rows = propagate_labels(durable(rows), shards, rounds=rounds)
    df = even_runs(rows, shards, ["key", "sub", "id", "crc"])
    return df.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
