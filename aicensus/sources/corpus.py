"""Corpora read in three steps: list and prune, choose by path, read ranges.

``list_corpus`` is a Python data source. The driver walks only ``fan_out`` levels of folders; each folder below is a task that
walks on, so listing grows with the cluster. Ignored folders and folders that a user's glob names are never opened, and
filters on ``scan_id`` or on the beginning of ``path`` reach the walk. Nothing is read yet: rows are path, size and time.

``read_listed`` opens the files that are left. Formats whose facts stand in a header of known extent are read to the end of
that header only, whatever the file's size; all others whole. A file that cannot be read is a row with ``error``.

``line_pieces`` and ``find_literals`` read files of any size as many ranges, so that no file is one row or one task. A piece
holds the lines that begin in its range, whole; a literal belongs to the range it begins in.

Paths are opened with the file systems of Arrow, which executors reach without the JVM; local paths must be shared by all
executors.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from ..functions.text import glob_regex
from ..operators.artifacts import gguf_header_size
from ..session import ship_package, stored
from .files import IGNORED_DIRS

LISTING = "scan_id string, path string, size bigint, mod_time timestamp"
ROW_MAX = (1 << 31) - 1024  # bytes that one row can hold
BATCH_BYTES = 32 << 20
TASK_BYTES = 8 << 20  # the least that a task is dealt, however small the ranges are
HEAD = 1 << 16


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI; ``file:/x`` is accepted as Spark writes it."""
    if re.match(r"^file:/", root):
        root = re.sub(r"^file:/+", "/", root)
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/") or "/"


# ── listing ──────────────────────────────────────────────────────────────────


@dataclass
class Pruning:
    """What a walk leaves out. ``scan_id`` fixes the scan; without it, the first path segment is the scan."""

    scan_id: str | None = None
    ignored: tuple[str, ...] = tuple(IGNORED_DIRS)
    globs: tuple[str, ...] = ()
    scans: frozenset[str] | None = None
    prefixes: tuple[str, ...] = ()
    _regex: re.Pattern | None = field(default=None, repr=False)

    def split(self, relative: str) -> tuple[str, str]:
        """Scan and path of a file; a file at the root is a scan of its own unless ``scan_id`` is set."""
        if self.scan_id is not None:
            return self.scan_id, relative
        scan, _, path = relative.partition("/")
        return scan, path or scan

    def _left_out(self, path: str) -> bool:
        if self._regex is None:
            self._regex = re.compile("|".join(f"(?:{glob_regex(g)})" for g in self.globs) or r"(?!)")
        return self._regex.match(path) is not None

    def enters(self, relative: str) -> bool:
        """Whether a folder can hold a file that is wanted."""
        scan, path = (self.scan_id, relative) if self.scan_id is not None else (relative.partition("/")[0], relative.partition("/")[2])
        if self.scans is not None and scan not in self.scans:
            return False
        if path and (posixpath.basename(path) in self.ignored or self._left_out(path)):
            return False
        below = f"{path}/" if path else ""
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def keeps(self, scan: str, path: str) -> bool:
        return (self.scans is None or scan in self.scans) and not self._left_out(path) and all(path.startswith(p) for p in self.prefixes)


class Folder(InputPartition):
    """Folders that one task walks (with all below), or only lists (their own files)."""

    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class CorpusReader(DataSourceReader):
    def __init__(self, root: str, pruning: Pruning, fan_out: int):
        self.root, self.pruning, self.fan_out = root, pruning, fan_out

    def pushFilters(self, filters):
        """Scans and path beginnings cut the walk; the walk applies them fully, so Spark need not."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("scan_id",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("scan_id",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.pruning.prefixes += (f.value,)
            else:
                yield f

    def _only(self, scans: set) -> None:
        kept = self.pruning.scans
        self.pruning.scans = frozenset(scans) if kept is None else kept & scans

    def _listed(self, system: fs.FileSystem, base: str, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
        """Files of a folder, and the relative paths of the folders to enter."""
        files, folders = [], []
        for info in system.get_file_info(fs.FileSelector(posixpath.join(base, folder) if folder else base, recursive=False)):
            if info.type == fs.FileType.File:
                files.append(info)
            elif info.type == fs.FileType.Directory:
                below = posixpath.join(folder, info.base_name)
                if self.pruning.enters(below):
                    folders.append(below)
        return files, folders

    def partitions(self):
        system, base = open_root(self.root)
        level, out = [""], []
        for _ in range(self.fan_out):
            below: list[str] = []
            for folder in level:
                out.append(Folder(folder, False))
                below += self._listed(system, base, folder)[1]
            level = below
        return [*out, *(Folder(f, True) for f in level)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = open_root(self.root)
        todo = [partition.folder]
        while todo:
            files, folders = self._listed(system, base, todo.pop())
            if partition.deep:
                todo += folders
            rows = []
            for info in files:
                scan, path = self.pruning.split(posixpath.relpath(info.path, base))
                if self.pruning.keeps(scan, path):
                    rows.append((scan, path, info.size, info.mtime))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.timestamp("us", "UTC"))], names=["scan_id", "path", "size", "mod_time"])


class CorpusSource(DataSource):
    """``spark.read.format("corpus")`` with the options root, scan_id, globs (JSON list) and fan_out."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> CorpusReader:
        pruning = Pruning(self.options.get("scan_id"), globs=tuple(json.loads(self.options.get("globs", "[]"))))
        return CorpusReader(self.options["root"], pruning, int(self.options.get("fan_out", "1")))


def list_corpus(spark: SparkSession, root: str, scan_id: str | None = None, user_globs: tuple[str, ...] = (), fan_out: int = 1) -> DataFrame:
    """scan_id, path, size, mod_time of every file that is not pruned. No file is opened.

    ``fan_out`` is the number of folder levels that the driver walks to find tasks.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
    reader = spark.read.format("corpus").option("root", root).option("globs", json.dumps(list(user_globs))).option("fan_out", str(fan_out))
    return (reader if scan_id is None else reader.option("scan_id", scan_id)).load()


# ── reading ──────────────────────────────────────────────────────────────────


def safetensors_end(head: bytes, size: int) -> int | None:
    return min(size, 8 + int.from_bytes(head[:8], "little")) if len(head) >= 8 else None


# Formats whose facts stand in a header of known extent: its end, or None where more bytes are needed to tell.
HEADERS: dict[str, Callable[[bytes, int], int | None]] = {".gguf": gguf_header_size, ".safetensors": safetensors_end}


def read_header(source: pa.NativeFile, size: int, end_of: Callable[[bytes, int], int | None]) -> bytes:
    """The bytes up to the end of the header; blocks double until the end is known."""
    head, want = b"", HEAD
    while True:
        head += source.read_at(max(0, min(want, size) - len(head)), len(head))
        end = len(head) if len(head) >= size else end_of(head, size)
        if end is not None and end <= len(head):
            return head[:end]
        want = 2 * want if end is None else end


class Opener:
    """Opens listed files; the one opened last stays open, as ranges of a file follow each other."""

    def __init__(self, root: str, scan_is_folder: bool):
        self.system, self.base = open_root(root)
        self.scan_is_folder = scan_is_folder
        self.path, self.file = None, None

    def __call__(self, scan: str, path: str) -> pa.NativeFile:
        # A file at the root of a corpus of several scans is a scan of its own.
        path = posixpath.join(scan, path) if self.scan_is_folder and scan != path else path
        if path != self.path:
            self.close()
            self.file = self.system.open_input_file(posixpath.join(self.base, path))
            self.path = path
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def spread(rows: DataFrame, size: Column, task_bytes: int) -> DataFrame:
    """The rows stored once, so that a corpus is walked once, and dealt over as many tasks as their bytes need.

    Neighbours stay together, so that a task reads a file's ranges one after the other.
    """
    kept = stored(rows, "listing")
    total = kept.agg(F.sum(size)).first()[0] or 0
    order = [c for c in ("scan_id", "path", "start") if c in rows.columns]
    return kept.repartitionByRange(max(1, -(-int(total) // task_bytes)), *order).sortWithinPartitions(*order)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


READ = "scan_id string, path string, size bigint, mod_time timestamp, content binary, partial boolean, error string"
_READ = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mod_time", pa.timestamp("us", "UTC")),
                   ("content", pa.binary()), ("partial", pa.bool_()), ("error", pa.string())])


def read_listed(listing: DataFrame, root: str, *, scan_id: str | None = None, task_bytes: int = 256 << 20) -> DataFrame:
    """The listed files with ``content``; ``partial`` where only the header was read, ``error`` where nothing was.

    A file too large for one row is an error here; ``line_pieces`` and ``find_literals`` read such files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, rows, held = Opener(root, scan_id is None), [], 0
        for batch in batches:
            for scan, path, size, time in zip(*(c.to_pylist() for c in batch.columns)):
                content = error = None
                end_of = HEADERS.get(posixpath.splitext(path)[1].lower())
                try:
                    source = open_file(scan, path)
                    size = source.size()
                    if end_of:
                        content = read_header(source, size, end_of)
                    elif size > ROW_MAX:
                        error = f"{size} bytes do not fit one row"
                    else:
                        content = source.read_at(size, 0)
                except OSError as failed:
                    error = f"{type(failed).__name__}: {failed}"
                rows.append((scan, path, size, time, content, content is not None and len(content) < size, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield arrow_rows(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield arrow_rows(rows, _READ)

    ship_package(listing.sparkSession)
    return spread(listing, F.col("size"), task_bytes).select("scan_id", "path", "size", "mod_time").mapInArrow(run, READ)


def unreadable(read: DataFrame) -> DataFrame:
    """Unknown rows of the files that could not be read."""
    return read.filter("error IS NOT NULL").select("scan_id", "path", F.lit("reader").alias("detector_id"), F.col("error").alias("reason"))


# ── ranges of files of any size ──────────────────────────────────────────────


def ranges(listing: DataFrame, range_bytes: int) -> DataFrame:
    """One row per range of a file: scan_id, path, size, start, stop. An empty file has no range."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))
    return listing.filter("size > 0").select("scan_id", "path", "size", F.explode(starts).alias("start")).withColumn(
        "stop", F.least(F.col("start") + range_bytes, F.col("size")))


def line_after(source: pa.NativeFile, at: int, stop: int) -> int | None:
    """The first beginning of a line in [at, stop)."""
    if at == 0:
        return 0 if stop else None
    at -= 1  # the line end before a range makes its first byte a beginning
    while at < stop - 1:
        found = source.read_at(min(HEAD, stop - 1 - at), at)
        if not found:
            return None
        cut = found.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(found)
    return None


def count_ends(source: pa.NativeFile, start: int, stop: int) -> int:
    """The line ends in [start, stop), read block by block."""
    return sum(source.read_at(min(1 << 20, stop - at), at).count(b"\n") for at in range(start, stop, 1 << 20))


_CUT = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                  ("line_ends", pa.int64()), ("error", pa.string())])


def line_cuts(listing: DataFrame, root: str, *, scan_id: str | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Where pieces of whole lines begin and end: scan_id, path, size, start, stop, first_line, error.

    A line belongs to the range it begins in, so a range in which none begins has no row. ``first_line`` counts from 1: the line
    ends of the earlier pieces of a file, a window that the number of its ranges bounds. Contents are read but not kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = Opener(root, scan_id is None)
        for batch in batches:
            rows = []
            for scan, path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    source = open_file(scan, path)
                    first = line_after(source, start, stop)
                    if first is None:
                        continue
                    end = line_after(source, stop, size) if stop < size else size
                    end = size if end is None else end
                    rows.append((scan, path, size, first, end, count_ends(source, first, end), None))
                except OSError as failed:
                    rows.append((scan, path, size, start, start, 0, f"{type(failed).__name__}: {failed}"))
            if rows:
                yield arrow_rows(rows, _CUT)

    ship_package(listing.sparkSession)
    parts = spread(ranges(listing, range_bytes), F.col("stop") - F.col("start"), max(4 * range_bytes, TASK_BYTES)).select(
        "scan_id", "path", "size", "start", "stop").mapInArrow(
        run, "scan_id string, path string, size bigint, start bigint, stop bigint, line_ends bigint, error string")
    earlier = W.partitionBy("scan_id", "path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("first_line", F.coalesce(F.sum("line_ends").over(earlier), F.lit(0)) + 1).drop("line_ends")


def text_before(source: pa.NativeFile, at: int, want: int) -> bytes:
    """The bytes before a position that hold ``want`` bytes after folding white space, or all there are."""
    back = min(at, 2 * want)
    while True:
        raw = source.read_at(back, at - back)
        if back == at or len(re.sub(rb"[ \t\n\r\f\v]+", b" ", raw)) >= want + 1:
            return raw
        back = min(at, 2 * back)


def line_pieces(cuts: DataFrame, root: str, *, scan_id: str | None = None, before_bytes: int = 256, task_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``line_cuts``, with any further columns, and their ``content`` and ``before``, the text in front of it.

    Content is read where it is used and crosses no shuffle; the cuts are dealt by the bytes they stand for, so a large
    file is many tasks. Lines longer than a row are an ``error``.
    """
    cuts = spread(cuts, F.col("stop") - F.col("start"), task_bytes)
    kept = [f for f in cuts.schema.fields if f.name != "error"]
    at = {f.name: i for i, f in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = Opener(root, scan_id is None)
        for batch in batches:
            begin, held, read = 0, 0, []
            for i in range(batch.num_rows):
                scan, path, start, stop = (batch.column(at[c])[i].as_py() for c in ("scan_id", "path", "start", "stop"))
                content = before = None
                error = batch.column(len(kept))[i].as_py()
                try:
                    if error is None and stop - start > ROW_MAX:
                        error = f"lines of {stop - start} bytes do not fit one row"
                    elif error is None:
                        source = open_file(scan, path)
                        content = source.read_at(stop - start, start)
                        before = text_before(source, start, before_bytes) if start else b""
                except OSError as failed:
                    error = f"{type(failed).__name__}: {failed}"
                read.append((content, before, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = zip(zip(*read), (pa.binary(), pa.binary(), pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(begin, len(read)) for c in batch.columns[:len(kept)]), *(pa.array(v, t) for v, t in columns)],
                        names=[*at, "content", "before", "error"])
                    begin, held, read = i + 1, 0, []

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return cuts.select(*at, "error").mapInArrow(run, f"{shape}, content binary, before binary, error string")


def find_literals(listing: DataFrame, root: str, literals: list[str], *, scan_id: str | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """scan_id, path, literal, at: every place (offset from 0) where a literal stands, overlapping ones too.

    Ranges are read with as many bytes behind them as the longest literal needs; a place belongs to the range it lies in.
    A file that cannot be read gives one row a range with a null literal.
    """
    wanted = [(text, text.encode()) for text in dict.fromkeys(literals) if text]
    reach = max((len(raw) for _, raw in wanted), default=1) - 1
    shape = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("literal", pa.string()), ("at", pa.int64())])

    def places(raw: bytes, offset: int, part: bytes, stop: int) -> Iterator[int]:
        found = raw.find(part)
        while 0 <= found < stop - offset:
            yield offset + found
            found = raw.find(part, found + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = Opener(root, scan_id is None)
        for batch in batches:
            rows: list[tuple] = []
            for scan, path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    source, found = open_file(scan, path), []
                    for at in range(start, stop, 8 << 20):
                        end = min(stop, at + (8 << 20))
                        raw = source.read_at(end - at + reach, at)
                        found += [(scan, path, text, p) for text, part in wanted for p in places(raw, at, part, end)]
                except OSError:
                    found = [(scan, path, None, None)]
                rows += found
                if len(rows) >= 10_000:
                    yield arrow_rows(rows, shape)
                    rows = []
            if rows:
                yield arrow_rows(rows, shape)

    ship_package(listing.sparkSession)
    return spread(ranges(listing, range_bytes), F.col("stop") - F.col("start"), max(4 * range_bytes, TASK_BYTES)).select(
        "scan_id", "path", "start", "stop").mapInArrow(run, "scan_id string, path string, literal string, at bigint")
