"""Near-duplicates: SuperMinHash signatures, banding, exact verification, grouping by union-find.

A text is the set of its word shingles; texts with equal sets are folded to one node. A SuperMinHash signature gives
every element one correlated permutation of the positions: at step j an element offers ``j + r`` to the position that its
permutation names, so a position filled at step j is final after that step, and the steps end as soon as all positions
are filled. Nodes whose signatures agree in all rows of a band share a bucket.

Verification has two rounds, both on the exact sets. First each node meets the hub (smallest node) of its buckets;
the components of these links are found. Then only buckets that still hold several components are opened, and every pair
of nodes of different components in them is checked. Pairs inside one component cannot change the result, so a group of
near copies costs its size, not its square. Work is dealt into cells of bounded size whatever the size of a bucket.

Defined results: a text with fewer words than a shingle is one shingle; a text without words (null, empty, blank) has no
shingles and is linked with nothing; equal sets are linked; a component's id is its smallest known row id, null if all are
null; ``kept`` marks the rows whose id is the component's (a null id where all are null); repeated rows stay repeated. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored
from .ngram_join import WordHashes, components, mix, shingles

BLOCK_NODES = 512
BLOCK_SHINGLES = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def blank_words(text: str | None) -> list[bytes]:
    """The words between blanks as UTF-8 bytes, A-Z folded; None has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class SuperMinHash:
    """Signatures of sets of 64-bit keys; ``size`` is 256 at most."""

    def __init__(self, size: int, seed: int = 7):
        self.size = size
        self.steps = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def signatures(self, sets: list[np.ndarray], part: int = 32_768) -> np.ndarray:
        """One row a set; a value is step * 2^32 + rank, an empty set has the largest value everywhere."""
        out = np.full((len(sets), self.size), EMPTY)
        start = 0
        while start < len(sets):  # as many sets as fit one part; a longer set is a part-wise fold of its own
            end, total = start + 1, len(sets[start])
            while end < len(sets) and total + len(sets[end]) <= part:
                total += len(sets[end])
                end += 1
            if total > part:
                for i in range(0, total, part):
                    self._fold(out[start:end], sets[start][i:i + part], np.zeros(len(sets[start][i:i + part]), np.int64))
            elif total:
                sizes = [len(s) for s in sets[start:end]]
                self._fold(out[start:end], np.concatenate(sets[start:end]), np.repeat(np.arange(end - start), sizes))
            start = end
        return out

    def _fold(self, lowest: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> None:
        size, flat, places = self.size, lowest.reshape(-1), None
        open_sets = np.zeros(len(lowest), bool)
        open_sets[owner] = True
        for j in range(size):
            if j:  # a set whose positions are all filled below this step is done
                open_sets &= lowest.max(axis=1) >= np.uint64(j << 32)
                stay = open_sets[owner]
                if not stay.any():
                    return
                if not stay.all():
                    keys, owner = keys[stay], owner[stay]
                    places = places[stay] if j > 1 else places
                    first = first[stay] if j == 1 else first
            drawn = mix(keys + self.steps[j])
            other = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                first = position = other
            else:
                line = np.arange(len(keys))
                if j == 1:  # permutations are only laid out for sets that need a second step
                    places = np.tile(np.arange(size, dtype=np.uint8), (len(keys), 1))
                    places[line, first], places[:, 0] = 0, first
                position = places[line, other].astype(np.int64)
                places[line, other] = places[:, j]
                places[:, j] = position
            np.minimum.at(flat, owner * size + position, (drawn >> np.uint64(32)) | np.uint64(j << 32))


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of the key."""
    rows = signatures.reshape(len(signatures), bands, -1)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        total = mix(total + rows[:, :, i] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1))
    return total.view(np.int64)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def features(docs: DataFrame, id_col: str, text_col: str, length: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, digest of the set, its size, band keys of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hasher = WordHashes(), SuperMinHash(bands * rows)
        for batch in batches:
            sets = [shingles(blank_words(t.as_py()), hashes, length) for t in batch.column(1)]
            keys = band_keys(hasher.signatures(sets), bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([k if len(s) else None for s, k in zip(sets, keys)], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "n", "bands"])

    return docs.select(id_col, text_col, text_key(F.col(text_col)).alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key binary, node binary, n long, bands array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, n, hub of every bucket with several nodes; buckets of the same nodes count once."""
    every = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    mark = F.bit_xor(F.xxhash64("node", F.lit(5)))
    groups = every.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("size"), mark.alias("mark"), F.min(F.struct("node", "n")).alias("hub")
    ).filter("nodes > 1").groupBy("nodes", "size", "mark", "hub").agg(F.min("bucket").alias("bucket"))
    return every.join(groups.select("bucket", "hub"), "bucket")


def blocks_of(nodes: Column, size: Column) -> Column:
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def dealt(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(3)), blocks).cast("int")


def star_cells(shared: DataFrame, percent: int) -> DataFrame:
    """cell, side, node, label: every hub with a block of the nodes that share a bucket with it."""
    fits = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    spokes = shared.filter(fits & (F.col("node") != F.col("hub.node"))).select(F.col("hub.node").alias("hub"), "node", "n").distinct()
    sizes = spokes.groupBy("hub").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    cell = lambda block: F.struct(F.lit(0).alias("kind"), F.col("hub").alias("at"), F.lit(0).alias("i"), block.alias("j"))
    right = spokes.join(sizes, "hub").select(
        cell(dealt("node", F.col("blocks"))).alias("cell"), F.lit(1).alias("side"), "node", F.col("node").alias("label"))
    left = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        cell(F.col("block")).alias("cell"), F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub").alias("label"))
    return left.unionByName(right)


def open_cells(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, side, node, label for all pairs of different components that share a bucket.

    A bucket's largest component is set against the others, and the others against each other, block by block.
    """
    named = shared.select("bucket", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("size"))
    whole = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("nodes").alias("all_nodes"), F.sum("size").alias("all_size"),
        F.max(F.struct("nodes", "size", "label")).alias("major")).filter("labels > 1")
    rest = blocks_of(F.col("all_nodes") - F.col("major.nodes"), F.col("all_size") - F.col("major.size"))
    whole = whole.select("bucket", F.col("major.label").alias("major"), (blocks_of(F.col("all_nodes"), F.col("all_size")) == 1).alias("one"),
                         blocks_of(F.col("major.nodes"), F.col("major.size")).alias("major_blocks"), rest.alias("minor_blocks"))
    rows = named.join(whole, "bucket").withColumn("is_major", F.col("label") == F.col("major")).withColumn(
        "block", dealt("node", F.when(F.col("is_major"), F.col("major_blocks")).otherwise(F.col("minor_blocks"))))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    block, zero = F.col("block"), F.lit(0)
    against_major = F.transform(upto("major_blocks"), lambda b: place(2, b, block, F.lit(1)))
    each_other = F.transform(upto("minor_blocks"), lambda o: place(
        3, F.least(block, o), F.greatest(block, o), F.when(o == block, 2).when(block < o, 0).otherwise(1)))
    places = F.when(F.col("one"), F.array(place(1, zero, zero, F.lit(2)))).when(
        F.col("is_major"), F.transform(upto("minor_blocks"), lambda j: place(2, block, j, F.lit(0)))).otherwise(
        F.concat(against_major, each_other))
    return rows.select("bucket", "node", "label", F.explode(places).alias("p")).select(
        F.struct("p.kind", F.to_binary(F.hex("bucket"), F.lit("hex")).alias("at"), "p.i", "p.j").alias("cell"),
        "p.side", "node", "label")


def cell_links(rows: list[tuple], percent: int, length: int, hashes: WordHashes) -> list[tuple]:
    """(node, root) of every node that a link of this cell joins; rows are (side, node, label, text)."""
    rows = sorted({(side, node): (side, node, label, text) for side, node, label, text in rows}.values(), key=lambda r: r[:2])
    sides = np.array([r[0] for r in rows])
    keys = [shingles(blank_words(r[3]), hashes, length) for r in rows]
    sizes = np.array([len(k) for k in keys])
    root, by_label = list(range(len(rows))), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, r in enumerate(rows):  # nodes of one component are one set from the start
        root[x] = by_label.setdefault(r[2], x)
    touched = set()
    for x in np.flatnonzero(sides != 1).tolist():
        others = np.flatnonzero(sides == 1) if sides[x] == 0 else np.arange(x + 1, len(rows))
        low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        home = find(x)
        others = np.array([y for y in others[100 * low >= percent * high].tolist() if find(y) != home], np.int64)
        if not len(others):
            continue
        every = np.concatenate([keys[y] for y in others])
        place = np.minimum(np.searchsorted(keys[x], every), len(keys[x]) - 1)
        both = np.add.reduceat((keys[x][place] == every).astype(np.int64), np.cumsum([0, *sizes[others][:-1]]))
        for y in others[100 * both >= percent * (sizes[others] + sizes[x] - both)].tolist():
            touched.update((x, y))
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return [(rows[x][2], rows[find(x)][2]) for x in touched if rows[x][2] != rows[find(x)][2]]


def links(docs: DataFrame, nodes: DataFrame, cells: DataFrame, id_col: str, text_col: str, percent: int, length: int) -> DataFrame:
    """(a, b): labels that a verified link joins."""
    texts = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key")).alias("key"),
                        F.col(text_col).alias("text"))
    work = texts.join(cells.join(nodes.select("node", "key"), "node"), "key").select("cell", "side", "node", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, at = WordHashes(), [], None

        def close() -> pa.RecordBatch:
            found = cell_links(group, percent, length, hashes)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                cell, *row = (c[i].as_py() for c in batch.columns)
                if cell != at and group:
                    yield close()
                    group = []
                at = cell
                group.append(tuple(row))
        if group:
            yield close()

    return work.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80,
                bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their sets. A pair at 80 shares one of 32 bands of 6
    with a probability of 0.99994.
    """
    ship_package(docs.sparkSession)
    every = stored(features(docs, id_col, text_col, shingle, bands, rows), "super-features")
    nodes = stored(every.filter("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").alias("id"), "text_key")).alias("key"), F.min("doc_id").alias("first_id"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "super-nodes")
    shared = stored(shared_buckets(nodes), "super-buckets")
    verify = lambda cells: links(docs, nodes, cells, id_col, text_col, percent, shingle)
    labels = components(stored(verify(star_cells(shared, percent)), "super-stars"))
    wider = components(stored(verify(open_cells(shared, labels)), "super-links"))
    named = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(
        wider.select(F.col("node").alias("label"), F.col("label").alias("wide")), "label", "left").withColumn(
        "label", F.coalesce("wide", "label"))
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = named.select("node", "label").join(ids, "label").select("node", "component_id")
    joined = every.select("doc_id", "n", "node").join(found, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
