"""The ``files`` table: reading corpora, ignore rules, content and classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, glob_regex

# Directories never scanned.
IGNORED_DIRS = [
    ".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache",
]

# Language of a file by lower-case extension.
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".cs": "csharp",
    ".kt": "kotlin", ".kts": "kotlin",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
}

# Magic registry (id, 1-based offset, hex bytes), first match wins.
MAGICS = [
    ("gguf", 1, "47475546"),
    ("hdf5", 1, "894844460D0A1A0A"),
    ("tflite", 5, "54464C33"),
    ("zip", 1, "504B0304"),
    ("onnx-protobuf", 1, "08"),
    ("pickle", 1, "80"),
]


def hex_literal(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def read_corpus(
    spark: SparkSession, root: str, scan_id: str | Column | None = None, glob: str | None = None
) -> DataFrame:
    """Read a directory tree as ``files`` rows. ``scan_id`` defaults to the first path segment."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    # Stored paths are URIs ("file:/data/x"); the root is found in them as given.
    bare_root = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/"))
    df = raw.withColumn("_rel", F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*?{bare_root}/", ""))
    if scan_id is None:
        df = df.withColumn("scan_id", F.substring_index("_rel", "/", 1)).withColumn(
            "_rel", F.regexp_replace("_rel", r"^[^/]*/", "")
        )
    else:
        df = df.withColumn("scan_id", F.lit(scan_id) if isinstance(scan_id, str) else scan_id)
    return df.select(
        "scan_id",
        F.col("_rel").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mod_time"),
        "content",
    )


def drop_ignored(files: DataFrame, user_globs: tuple[str, ...] = ()) -> DataFrame:
    """Drop files under the ignored directories, and under or matching the user's globs.

    Only ``path`` is touched; a binary file source still reads what it then drops.
    """
    names = "|".join(n.replace(".", r"\.") for n in IGNORED_DIRS)
    out = files.filter(~F.col("path").rlike(rf"(?:^|/)(?:{names})/"))
    for g in user_globs:
        body = glob_regex(g).removeprefix("^").removesuffix("$")
        # A glob that matches a directory prunes everything below it.
        out = out.filter(~F.col("path").rlike(f"^{body}(?:/.*)?$"))
    return out


def cap_content(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Whole content, or at most ``max_bytes`` of it where the caller asks for that.

    ``truncated`` tells that bytes were left out (see ``truncations``); SHA-256 only for whole files. A file of which
    the reader took the header only (``partial``) is not cut off, but has no SHA-256 either.
    """
    whole = ~F.col("partial") if "partial" in files.columns else F.lit(True)
    if max_bytes is None:
        return files.withColumn("truncated", F.lit(False)).withColumn("sha256", F.when(whole, F.sha2("content", 256))).drop("partial")
    over = F.length("content") > max_bytes
    return (
        files.withColumn("truncated", over)
        .withColumn("sha256", F.when(whole & ~over, F.sha2("content", 256)))
        .withColumn("content", F.substring("content", 1, max_bytes)).drop("partial")
    )


def truncations(files: DataFrame) -> DataFrame:
    """Unknown rows of files read in part, so that none looks fully scanned."""
    return files.filter("truncated").select(
        "scan_id", "path", F.lit("reader").alias("detector_id"),
        F.concat(F.lit("read "), F.length("content").cast("string"), F.lit(" of "), F.col("size").cast("string"),
                 F.lit(" bytes")).alias("reason"))


def language_of(path: Column) -> Column:
    """Language by extension; '' when unknown. A literal map, no join needed."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def has_bytes_at(content: Column, offset: int, digits: str) -> Column:
    return F.substring(content, offset, len(digits) // 2) == hex_literal(digits)


def magic_of(content: Column) -> Column:
    """First registry entry whose bytes sit at its offset; '' if none."""
    out = F.lit("")
    for name, offset, digits in reversed(MAGICS):
        out = F.when(has_bytes_at(content, offset, digits), F.lit(name)).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    return F.contains(content, hex_literal("00"))


def classify(files: DataFrame) -> DataFrame:
    """Add ``language``, ``magic_id`` and ``is_binary``; all narrow."""
    return (
        files.withColumn("language", language_of(F.col("path")))
        .withColumn("magic_id", magic_of(F.col("content")))
        .withColumn("is_binary", is_binary(F.col("content")))
    )


def prepare(
    files: DataFrame, max_bytes: int | None = None, user_globs: tuple[str, ...] = ()
) -> DataFrame:
    return classify(cap_content(drop_ignored(files, user_globs), max_bytes))


def from_text(
    df: DataFrame, scan_id: Column, path: Column, text: Column
) -> DataFrame:
    """Any table with text as a ``files`` table."""
    content = F.encode(text, "UTF-8")
    return df.select(
        scan_id.alias("scan_id"),
        path.alias("path"),
        F.length(content).cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"),
        content.alias("content"),
    )


def text_of(content: Column) -> Column:
    """Content as text; bytes that are not UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def split_failures(results: DataFrame, detector_id: str) -> tuple[DataFrame, DataFrame]:
    """Split a job's output with an ``error`` column into (good rows, unknowns)."""
    good = results.filter(F.col("error").isNull()).drop("error")
    bad = results.filter(F.col("error").isNotNull()).select(
        "scan_id", "path", F.lit(detector_id).alias("detector_id"), F.col("error").alias("reason")
    )
    return good, bad
