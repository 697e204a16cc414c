"""Near-duplicate detection by min-max hashing.

A document's set holds its distinct word shingles. Under each permutation both the least and the greatest
hash are kept, so the signature has two unbiased values for each evaluation; runs of least and runs of
greatest values make the bands. Documents with equal sets are one node. Nodes that share a band are compared
with leaders of the band, not with each other, and sets are compared in full before a link counts:

1. each node with the least leader of all its bands;
2. where a band still spans several components, each of its nodes with the band's leader;
3. the nodes of bands that still do with each other. Tokens that no other of these nodes has match nothing: a node
   with so many of them that it cannot be similar to any is left out. What a band or a chain of bands connects of the
   others is a cluster; it is dealt to blocks of bounded size, and two blocks at a time are compared as a matrix product.

So no candidate of the bands is left out, and only links leave a task.

With 44 bands of 6 values a pair of similarity 0.8 shares a band but for about 1.5 in a million.

Defined results: null, empty and blank texts have the empty set and link with nothing; documents with fewer
words than a shingle have one shingle, the whole sequence; repeated rows are linked with each other, rows of one
id with different texts go each by its text; the least
id of a component stands for it (a null id stands for nothing and is never the least); an empty table gives an
empty result; extra columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import slices
from weft.llm.common import durable, table

BANDS, ROWS = 44, 6
PERCENT = 80
#: Rounds with leaders of bands.
LEADER_ROUNDS = 2
#: Nodes of one block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 4_000_000
_WORD_CACHE = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (constants as in the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, len(words) if k < n else n, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:count], x[count:] | np.uint64(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each set (none empty) and band: even bands of least values, odd bands of greatest."""
    flip, times = _permutations(-(-bands // 2) * rows)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), bands), np.uint64)
    for j in range(bands // 2 + bands % 2):
        low, high = np.full(len(sets), 2 * j, np.uint64), np.full(len(sets), 2 * j + 1, np.uint64)
        for k in range(j * rows, (j + 1) * rows):
            v = (((flat ^ flip[k]) * times[k]) >> np.uint64(32)).astype(np.uint32)
            low = _mix(low * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at))
            high = _mix(high * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(v, at))
        out[:, 2 * j] = low
        if 2 * j + 1 < bands:
            out[:, 2 * j + 1] = high
    return out


def signatures(docs: DataFrame, n: int, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text) to (id, n_shingles, set_hash, bands); the hash and bands of an empty set are null."""

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            sets = [shingle_set(t, n) for t in b.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            found = iter(band_hashes(full, bands, rows).view(np.int64)) if full else iter(())
            yield pa.record_batch(
                {
                    "id": b.column("id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_hash": pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "bands": pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
            )
        _hashes.clear()  # workers live on into stages that need their memory

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_shingles long, set_hash binary, bands array<long>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(node, text) to (node, the sorted set as bytes)."""

    def run(batches):
        for b in slices(batches, "text"):
            yield pa.record_batch({"node": b.column("node"), "set": pa.array([shingle_set(t, n).tobytes() for t in b.column("text").to_pylist()], pa.binary())})
        _hashes.clear()

    return texts.mapInArrow(run, f"node {dict(texts.dtypes)['node']}, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the pairs whose full sets are similar enough."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _roots(up: DataFrame, max_rounds: int) -> DataFrame:
    """(node, up: its least neighbour) to (node, up: the root its pointers lead to, which is the least node of its tree).

    Only two nodes can point at each other: the smaller is a root. From the first step on no pointer leads to a larger
    node, and every step doubles the pointers' reach.
    """
    up = durable(up)
    for _ in range(max_rounds):
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        far = F.when(F.col("far") == F.col("node"), F.least("node", "up")).otherwise(F.least("up", "far"))
        new = durable(up.join(jump, "up").select("node", F.col("up").alias("old"), far.alias("up")))
        up = new.select("node", "up")
        if new.filter("up <> old").isEmpty():
            return up
    raise RuntimeError(f"pointers of components did not settle in {max_rounds} rounds")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, label): the least node reachable, for every node that has a link.

    Each round points every node to its least neighbour, follows the pointers to their roots and carries the links over
    to these. At least half of the nodes that still have links go in a round, so rounds grow with the logarithm of the
    number of nodes, however long a chain is. Rounds are written out.
    """
    edges, labels = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select("b", "a"))
        roots = _roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), max_rounds)
        if labels is None:
            labels = roots.withColumnRenamed("up", "label")
        else:
            moved = labels.join(roots.select(F.col("node").alias("label"), "up"), "label", "left")
            labels = durable(moved.select("node", F.coalesce("up", "label").alias("label")))
        x, y = roots.select(F.col("node").alias("a"), F.col("up").alias("x")), roots.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = edges.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = durable(left.distinct())
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components between the nodes of two blocks (x and y; one block: x alone), one for each two components."""
    x, y = pdf[pdf["side"] != 2], pdf[pdf["side"] != 1]
    size = pdf["set"].map(len).to_numpy() // 8
    token = np.unique(np.frombuffer(b"".join(pdf["set"]), np.int64), return_inverse=True)[1]
    row = np.repeat(np.arange(len(pdf)), size)
    shared = np.zeros((len(x), len(y)), np.float32)
    at_x, at_y = (np.flatnonzero((pdf["side"] != k).to_numpy()) for k in (2, 1))
    for k in range(0, int(token.max(initial=-1)) + 1, 4096):
        mine = (token >= k) & (token < k + 4096)
        m = np.zeros((len(pdf), 4096), np.float32)
        m[row[mine], token[mine] - k] = 1
        shared += m[at_x] @ m[at_y].T
    total = size[at_x][:, None] + size[at_y][None, :] - shared
    label_x, label_y = x["label"].to_numpy(), y["label"].to_numpy()
    i, j = np.nonzero((100 * shared >= percent * total) & (label_x[:, None] != label_y[None, :]))
    found = pd.DataFrame({"a": x["node"].to_numpy()[i], "b": y["node"].to_numpy()[j], "la": label_x[i], "lb": label_y[j]})
    return found.drop_duplicates(["la", "lb"])[["a", "b"]]


def _able(own: DataFrame, percent: int) -> DataFrame:
    """(node, set) to the nodes of which enough tokens are shared with others to be similar to any: (node)."""
    kind = dict(own.dtypes)["node"]

    def run(batches):
        for b in slices(batches, "set"):
            sets = [np.frombuffer(x, np.int64) for x in b.column("set").to_pylist()]
            size = np.array([len(x) for x in sets])
            of = np.repeat(np.arange(len(sets)), size)
            yield pa.record_batch({"node": b.column("node").take(pa.array(of)), "size": pa.array(size[of], pa.int32()), "token": pa.array(np.concatenate(sets))})

    tokens = own.mapInArrow(run, f"node {kind}, size int, token long")
    # Tokens of one node alone, counted for it.
    lone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("size").alias("size")).filter("n = 1").groupBy("node", "size").agg(F.count(F.lit(1)).alias("lone"))
    never = lone.filter(100 * (F.col("size") - F.col("lone")) < percent * F.col("size")).select("node")
    return own.select("node").join(never, "node", "left_anti")


class _Links:
    """Links found so far, pairs compared so far, and the components they make."""

    def __init__(self, sets: DataFrame, percent: int):
        self._sets, self._percent = sets, percent
        self.links = self.seen = self.labels = None

    def compare(self, pairs: DataFrame) -> None:
        """Compare those (a, b, a < b) of the pairs that were not compared before."""
        pairs = durable(pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti"))
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        self.add(_linked(pairs, self._sets, self._percent))

    def add(self, links: DataFrame) -> None:
        new = durable(links)
        if not new.isEmpty():
            self.links = new if self.links is None else self.links.unionByName(new)
            self.labels = components(self.links)

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (node, ...) with the component of each."""
        if self.labels is None:
            return nodes.withColumn("label", F.col("node"))
        return nodes.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def near(self) -> Column:
        """Whether the node and its leader can be similar, by size."""
        return 100 * F.least("size", "lead.size") >= self._percent * F.greatest("size", "lead.size")


def _pair() -> tuple[Column, Column]:
    return F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")


def _compare_bands(found: _Links, own: DataFrame, rounds: int) -> DataFrame:
    """Compare the nodes (node, size, keys) with leaders of their bands; (key, node, label) of bands that still span
    several components."""
    if rounds:
        state = own.select("node", "size", F.explode("keys").alias("key"))
        lead = state.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"))
        least = state.join(lead, "key").filter("node <> lead.node").filter(found.near()).groupBy("node", "size").agg(F.min("lead").alias("lead"))
        found.compare(least.select(*_pair()).distinct())
    for turn in range(max(1, rounds)):
        state = found.labelled(own).select("node", "size", "label", F.explode("keys").alias("key"))
        lead = state.groupBy("key").agg(F.min(F.struct("node", "size", "label")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        left = state.join(lead.select("key", "lead"), "key")
        if turn + 1 < rounds:
            found.compare(left.filter("label <> lead.label").filter(found.near()).select(*_pair()).distinct())
    return left.select("key", "node", "label")


def _cluster_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that stand in different components although bands (key, node, label) connect them."""
    able = durable(_able(sets.join(left.select("node").distinct(), "node", "left_semi").filter(F.octet_length("set") > 0), percent).distinct())
    left = durable(left.join(able, "node"))
    lead = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead")).filter("lo <> hi")
    edges = left.join(lead.select("key", "lead"), "key").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    clusters = components(edges).withColumnRenamed("label", "cluster")
    nodes = left.select("node", "label").distinct().join(clusters, "node").join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    blocks = nodes.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    nodes = nodes.drop("bytes").distinct().join(blocks, "cluster")
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    met = nodes.select("cluster", "node", "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"))
    # A node stands in its own block's pair once, on both sides.
    kind = dict(left.dtypes)["node"]
    return met.join(sets, "node").groupBy("cluster", "x", "y").applyInPandas(lambda pdf: _block_links(pdf, percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, shingle: int, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, rounds: int = LEADER_ROUNDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    signed = durable(signatures(own, shingle, bands=bands, rows=rows))
    # Documents with equal sets are one node, named by their least id.
    nodes = durable(signed.filter("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("set_hash").agg(F.min("id").alias("node")))
    of_node = signed.join(nodes.select(F.col("node").alias("id"), "set_hash"), ["id", "set_hash"]).dropDuplicates(["id", "set_hash"])
    banded = of_node.select(F.col("id").alias("node"), F.col("n_shingles").cast("int").alias("size"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    # A node's bands that it shares, at most as many as there are bands.
    candidates = durable(banded.join(shared, "key").groupBy("node", "size").agg(F.collect_list("key").alias("keys")))
    texts = own.join(candidates.select(F.col("node").alias("id")).distinct(), "id").select(F.col("id").alias("node"), "text")
    sets = durable(_sets(texts, shingle).dropDuplicates(["node", "set"]))

    found = _Links(sets, percent)
    left = durable(_compare_bands(found, candidates, rounds))
    if not left.isEmpty():
        found.add(_cluster_links(left, sets, percent))
    out = signed.join(nodes, "set_hash", "left")
    out = out.withColumn("label", F.col("node")) if found.labels is None else out.join(found.labels, "node", "left")
    component = F.coalesce("label", "node", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component; the columns stay the same."""
    kept = near_duplicates(docs, shingle=shingle, percent=percent, id_col=id_col, text=text).filter("kept").select(F.struct(F.col(id_col)).alias("kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col)).alias("id"))
    return rows.join(kept, F.col("id") == F.col("kept"), "left_semi").select("row.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: All pairs by shared shingles, then everything reachable: brute force without hashing.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS x FROM d),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id,
       n.doc_id <= coalesce(min(r.b), n.doc_id) AS kept
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles
"""

QUERIES = {"op7_minhash": op7_minhash}
ORACLES = {"op7_minhash": OP7_SQL}
