"""Container-image layers to the effective file tree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package, stored
from .corpus import open_root

OPAQUE_MARKER = ".wh..wh..opq"
WHITEOUT_PREFIX = ".wh."


def plain_path(path: Column) -> Column:
    """Back slashes turned, empty and '.' segments dropped, no leading or trailing slash."""
    plain = F.regexp_replace(F.concat(F.lit("/"), F.translate(path, "\\", "/")), r"/(?:\.?/)+", "/")
    return F.regexp_replace(plain, r"^/|/\.?$", "")


def fold_parents(plain: Column) -> Column:
    """Resolve '..' segments, clamped at the root; paths without one pass through."""
    folded = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.concat(F.lit("/"), plain, F.lit("/")).contains("/../"), F.array_join(folded, "/")).otherwise(plain)


def clean_path(path: Column) -> Column:
    """Root-relative slash path: back slashes turned, '.' and '..' resolved, clamped at the root."""
    return fold_parents(plain_path(path))


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )


def cleaned(entries: DataFrame) -> DataFrame:
    """The entries with clean paths, in two steps, so that the second reads the first's result instead of repeating it."""
    return entries.withColumn("path", plain_path(F.col("path"))).withColumn("path", fold_parents(F.col("path")))


def _marked(entries: DataFrame) -> DataFrame:
    base = F.substring_index("path", "/", -1)
    return (
        cleaned(entries)
        .filter(F.col("path") != "")
        .withColumn("_base", base)
        .withColumn("_dir", F.regexp_replace(F.expr("substring(path, 1, length(path) - length(_base))"), "/$", ""))
        .withColumn(
            "_role",
            F.when(F.col("_base") == OPAQUE_MARKER, "opaque")
            .when(F.col("_base").startswith(WHITEOUT_PREFIX), "whiteout")
            .when(F.col("type") == "file", "file"),
        )
    )


def visible_versions(entries: DataFrame, whiteout_hides_subtree: bool = False) -> DataFrame:
    """(image, path, layer_idx, entry_seq) of every file the squashed image shows.

    ``entries``: image, layer_idx (0 = base), entry_seq (order in the layer), path, type.
    Whiteouts and opaque markers act on lower layers only; inside a layer the first entry
    of a path wins.

    Only the highest layer of a marker and only the topmost version of a file can matter, so
    files and whiteouts are reduced by one partial aggregate and opaque markers by another.
    The join left is an equi-join with at most one match per (file, directory), and no path
    however often rewritten becomes one window.
    """
    # Files, whiteouts and opaque markers are read apart below; paths are cleaned once.
    named = stored(_marked(entries.select("image", "layer_idx", "entry_seq", "path", "type")).filter("_role IS NOT NULL"), "layer-paths")
    bare = F.expr(f"substring(_base, {len(WHITEOUT_PREFIX) + 1})")
    target = F.when(bare.isin("", ".", ".."), clean_path(F.concat_ws("/", "_dir", bare))).when(
        F.col("_dir") == "", bare
    ).otherwise(F.concat_ws("/", "_dir", bare))
    is_file, is_whiteout = F.col("_role") == "file", F.col("_role") == "whiteout"
    # A whiteout is keyed by the path it hides, so files meet it in their own aggregate.
    visible = (
        named.filter(is_file | is_whiteout)
        .groupBy("image", F.when(is_whiteout, target).otherwise(F.col("path")).alias("path"))
        .agg(
            F.max(F.when(is_file, F.struct("layer_idx", (-F.col("entry_seq")).alias("neg_seq")))).alias("top"),
            F.max(F.when(is_whiteout, F.col("layer_idx"))).alias("removed_in"),
        )
        .filter("top IS NOT NULL AND (removed_in IS NULL OR removed_in <= top.layer_idx)")
        .select("image", "path", "top.layer_idx", (-F.col("top.neg_seq")).alias("entry_seq"))
    )
    opaque = (
        named.filter("_role = 'opaque'")
        .groupBy("image", F.col("_dir").alias("dir"))
        .agg(F.max("layer_idx").alias("hidden_in"))
    )
    if whiteout_hides_subtree:
        subtree = named.filter(is_whiteout).groupBy("image", target.alias("dir")).agg(
            F.max("layer_idx").alias("hidden_in"))
        opaque = opaque.unionByName(subtree).groupBy("image", "dir").agg(F.max("hidden_in").alias("hidden_in"))
    hidden = (
        # Only images with an opaque directory below which something could be hidden list their files' ancestors.
        visible.join(opaque.groupBy("image").agg(F.max("hidden_in").alias("_any")), "image").filter("_any > layer_idx")
        .select("image", "path", "layer_idx", F.explode(ancestors(F.col("path"))).alias("dir"))
        .join(opaque, ["image", "dir"])
        .filter(F.col("hidden_in") > F.col("layer_idx"))
        .select("image", "path")
        .distinct()
    )
    return visible.join(hidden, ["image", "path"], "left_anti")


# A handle tells where a payload lies: a file, the first byte and the number of bytes.
HANDLE = ["blob", "offset", "length"]


def pack_payloads(entries: DataFrame, payload: str = "content") -> DataFrame:
    """The entries with handles in place of payloads, which each task writes one after the other into a blob of its own.

    Narrow: a payload is written once and crosses no shuffle. A repeated task writes a new blob; only the handles of the
    attempt that succeeded are stored. A null payload has a null handle. Layers that are files already need no packing.
    """
    ship_package(entries.sparkSession)
    folder = shared_folder(entries.sparkSession, "payloads")
    kept = [f for f in entries.schema.fields if f.name != payload]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = uuid.uuid4().hex, 0
        system, base = open_root(folder)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                rows = []
                for raw in batch.column(len(kept)):
                    raw = raw.as_py()
                    rows.append((name, at, len(raw)) if raw is not None else (None, None, None))
                    if raw:
                        out.write(raw)
                        at += len(raw)
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(kept)], *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64())))],
                    names=[*(f.name for f in kept), *HANDLE])

    packed = entries.select(*(f.name for f in kept), payload).mapInArrow(run, f"{shape}, blob string, offset bigint, length bigint")
    return stored(packed.withColumn("blob", F.concat(F.lit(f"{folder}/"), "blob")), "entries")


def fetch_payloads(rows: DataFrame, payload: str = "content") -> DataFrame:
    """The rows with the payloads that their handles name, read in the order in which they lie."""
    ship_package(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name not in HANDLE]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = source = None
        for batch in batches:
            start, held, out = 0, 0, []
            for i, (name, offset, length) in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(kept):]))):
                if name is not None and name != blob:
                    if source is not None:
                        source.close()
                    root, _, file = name.rpartition("/")
                    system, base = open_root(root)
                    blob, source = name, system.open_input_file(f"{base}/{file}")
                out.append(None if name is None else source.read_at(length, offset))
                held += length or 0
                if held >= 32 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(out)) for c in batch.columns[:len(kept)]), pa.array(out, pa.binary())],
                                                     names=[*(f.name for f in kept), payload])
                    start, held, out = i + 1, 0, []

    placed = rows.select(*(f.name for f in kept), *HANDLE).repartitionByRange("blob", "offset").sortWithinPartitions("blob", "offset")
    return placed.mapInArrow(run, f"{shape}, `{payload}` binary")


def squash_layers(entries: DataFrame, whiteout_hides_subtree: bool = False, payload: str = "content") -> DataFrame:
    """The visible entries with all their columns, paths cleaned.

    Entries that hold a payload are packed first, and the payloads of the visible ones fetched when these are known, so
    that no payload crosses a shuffle. Entries with handles instead keep them; see ``fetch_payloads``.
    """
    inline = payload in entries.columns
    rows = pack_payloads(entries, payload) if inline else entries
    keep = visible_versions(rows, whiteout_hides_subtree)
    named = cleaned(rows).filter("type = 'file'")
    found = named.join(keep, ["image", "path", "layer_idx", "entry_seq"], "left_semi")
    return fetch_payloads(found, payload).select(*entries.columns) if inline else found
