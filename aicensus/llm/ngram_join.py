"""Near-duplicates: an N-gram Jaccard self-join with an LSH forest reduced to bands of one fixed depth.

Texts are sets of word shingles. Equal word sequences are folded to one node first, so copies cost nothing
more. Each node has ``trees`` MinHash signatures. Two nodes are candidates when the prefix of one depth is equal in
some tree; there are no tries and no descent. The depth is the same for all nodes: the longest up to ``max_depth`` at
which a pair at the threshold is found with the target recall. Candidates are verified on the exact sets.

Hot prefixes: the nodes under one prefix are dealt into blocks of bounded size and each pair of blocks is one
cell of work, so no task holds an unbounded group. Prefixes of several trees with the same nodes are one
group. A pair is verified only in the first tree whose prefix it shares, and a cell reports a number of
links and one edge per node, never pairs. Classes are the connected components of the edges, found by
propagating the smallest label with pointer jumps; each round is stored.

Defined results: a text of fewer than ``shingle`` words is one shingle; a text without words (null, empty) is a class of its
own without links; rows that repeat are copies of each other; the class id is the smallest id of a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored, words

BLOCK_NODES = 512
BLOCK_SHINGLES = 2_000_000


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold shares one of the tries with the target recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


class WordHashes(dict):
    """Word to 64-bit hash; cleared when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(found: list[bytes], hashes: WordHashes, length: int) -> np.ndarray:
    """The distinct shingles of a word list as sorted 64-bit hashes."""
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(length, len(each))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for j in range(n):
        total = mix(total + each[j:len(each) - n + 1 + j])
    return np.unique(total)


class Forest:
    """Prefixes of MinHash signatures, one per tree."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factor = (rng.integers(0, 1 << 31, trees * depth, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.shift = rng.integers(0, 1 << 32, trees * depth, np.uint32)[:, None]

    def prefixes(self, keys: np.ndarray, part: int = 1024) -> np.ndarray:
        short = (keys >> np.uint64(32)).astype(np.uint32)
        lowest = np.full(self.trees * self.depth, np.uint32(0xFFFFFFFF))
        for i in range(0, len(short), part):
            np.minimum(lowest, (self.factor * short[None, i:i + part] + self.shift).min(axis=1), out=lowest)
        levels = lowest.astype(np.uint64).reshape(self.trees, self.depth)
        total = np.arange(self.trees, dtype=np.uint64)
        for level in range(self.depth):
            total = mix(total + levels[:, level] + np.uint64(level + 1))
        return total.view(np.int64)


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def features(docs: DataFrame, id_col: str, text_col: str, forest: Forest, length: int) -> DataFrame:
    """doc_id, text_key, words digest, number of shingles, prefixes of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            digests, sizes, prefixes = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                keys = shingles(found, hashes, length)
                digests.append(blake2b(b" ".join(found), digest_size=16).digest())
                sizes.append(len(keys))
                prefixes.append(forest.prefixes(keys) if len(keys) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "n", "prefixes"])

    return docs.select(id_col, text_col, text_key(F.col(text_col)).alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key string, node binary, n long, prefixes array<long>")


def cells(nodes: DataFrame) -> DataFrame:
    """For each node of a prefix that others share: tree, prefix, cell (i, j), and the node's block."""
    tries = nodes.select("node", "n", F.posexplode("prefixes").alias("tree", "prefix"))
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    groups = tries.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("size"), mark(1).alias("m1"), mark(2).alias("m2"))
    groups = groups.filter("nodes > 1").groupBy("nodes", "size", "m1", "m2").agg(
        F.min(F.struct("tree", "prefix")).alias("at")).select("at.tree", "at.prefix", "nodes", "size")
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("size") / BLOCK_SHINGLES))
    placed = tries.drop("n").join(groups, ["tree", "prefix"]).withColumn("blocks", blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    return placed.select("tree", "prefix", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")


def verified(rows: list[dict], threshold: float, length: int, hashes: WordHashes) -> tuple[dict, dict]:
    """Links (weight of linked nodes) and root of every linked node of one cell."""
    rows = list({r["node"]: r for r in rows}.values())
    if len(rows) < 2:
        return {}, {}
    tree, i, j = rows[0]["tree"], rows[0]["i"], rows[0]["j"]
    rows.sort(key=lambda r: (r["block"], r["node"]))
    split = sum(r["block"] == i for r in rows)
    sets = [shingles(words(r["text"]), hashes, length) for r in rows]
    sizes = np.array([len(s) for s in sets])
    prefixes = np.array([r["prefixes"] for r in rows])
    root = list(range(len(rows)))
    links: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in range(len(rows) if i == j else split):
        others = np.arange(x + 1 if i == j else split, len(rows))
        low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[low >= threshold * high]
        if len(others):  # only pairs that meet here first
            same = prefixes[others] == prefixes[x]
            others = others[same.argmax(axis=1) == tree]
        if not len(others):
            continue
        keys = np.concatenate([sets[y] for y in others])
        place = np.minimum(np.searchsorted(sets[x], keys), len(sets[x]) - 1)
        both = np.add.reduceat((sets[x][place] == keys).astype(np.int64), np.cumsum([0, *sizes[others][:-1]]))
        union = sizes[others] + sizes[x] - both
        for y in others[both >= threshold * union].tolist():
            links[x] = links.get(x, 0) + rows[y]["weight"]
            links[y] = links.get(y, 0) + rows[x]["weight"]
            root[max(find(x), find(y))] = min(find(x), find(y))
    return ({rows[x]["node"]: n for x, n in links.items()}, {rows[x]["node"]: rows[find(x)]["node"] for x in links})


def linked(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, threshold: float, length: int) -> DataFrame:
    """node, links, root: one row per node and cell in which the node has links."""
    place = cells(nodes).join(nodes.select(
        "node", "weight", "prefixes", F.struct(F.col("first_id").alias("id"), "text_key").alias("key")), "node")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key")).alias("key"),
                        F.col(text_col).alias("text"))
    work = texts.join(place, "key").drop("key")
    cell = ["tree", "prefix", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group = WordHashes(), []

        def close() -> pa.RecordBatch:
            links, roots = verified(group, threshold, length, hashes)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(links), pa.binary()), pa.array(list(links.values()), pa.int64()),
                 pa.array([roots[x] for x in links], pa.binary())], names=["node", "links", "root"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if group and any(row[c] != group[0][c] for c in cell):
                    yield close()
                    group = []
                group.append(row)
        if group:
            yield close()

    return work.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "node binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of (a, b) edges."""
    both = stored(edges.union(edges.select("b", "a")).distinct(), "join-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select(
        "node", F.least("node", "label").alias("label")), "join-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(lower.join(jump, "label", "left").select(
            "node", F.least("label", "next").alias("label"), "old"), "join-labels")
        labels = new.drop("old")
        if new.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5,
                    threshold: float = 0.8, trees: int = 32, max_depth: int = 8, recall: float = 0.9999) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id, n_links (other rows at the threshold or above), class_size,
    stays (one row of each class, the smallest id; repeated rows share the mark)."""
    ship_package(docs.sparkSession)
    forest = Forest(trees, prefix_depth(trees, max_depth, threshold, recall))
    rows = stored(features(docs, id_col, text_col, forest, shingle), "join-features")
    nodes = stored(rows.filter("n > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("weight"),
        F.any_value("n").alias("n"), F.any_value("prefixes").alias("prefixes")).select(
        "node", F.col("first.doc_id").alias("first_id"), "first.text_key", "weight", "n", "prefixes"), "join-nodes")
    found = stored(linked(docs, nodes, id_col, text_col, threshold, shingle), "join-links")
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.drop("prefixes", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(
        labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min(F.struct("first_id", "text_key")).alias("keep"), F.sum("weight").alias("class_size"))
    named = named.join(classes, "label").select(
        "node", F.col("keep.first_id").alias("class_id"), "keep", "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = rows.drop("prefixes").join(named, "node", "left")
    own = F.col("n") == 0
    return joined.select(
        "doc_id", "text_key", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (own | F.struct(F.col("doc_id").alias("first_id"), "text_key").eqNullSafe(F.col("keep"))).alias("stays"))


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each class, with all its columns; of rows that repeat its id and text, any one stays."""
    key = lambda i, k: F.struct(i.alias("id"), k.alias("text_key"))
    kept = near_duplicates(docs, id_col, text_col, **options).filter("stays").select(
        key(F.col("doc_id"), F.col("text_key")).alias("_class_key"))
    keyed = docs.withColumn("_class_key", key(F.col(id_col), text_key(F.col(text_col))))
    return keyed.join(kept, "_class_key", "left_semi").dropDuplicates(["_class_key"]).select(*docs.columns)
