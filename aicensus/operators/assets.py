"""Whole-file classifiers: prompts and datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, extension, strip
from ..sources.files import has_bytes_at, text_of
from ..sources.routing import routed

# Prompt evidence.
SYSTEM_MARKERS = ["you are a", "your task is", "###instruction", "### instruction"]
CHAT_MARKERS = [
    "add_generation_prompt", "bos_token", "eos_token",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "[inst]", "<<sys>>",
]
CHAT_ROLE = r"""\brole\b["']?\s*(?:==|!=|=|:|\bin\b)\s*[\[("']*\s*(?:system|user|assistant)\b"""
PROMPT_EXTENSIONS = [
    "", ".prompt", ".txt", ".md", ".jinja", ".jinja2", ".j2", ".yaml", ".yml", ".json", ".toml", ".tmpl",
]

# Dataset evidence.
STRONG_FIELDS = [
    "prompt", "completion", "instruction", "chosen", "rejected", "messages", "conversations",
    "embedding", "embeddings",
]
MODERATE_FIELDS = [
    "text", "label", "labels", "target", "question", "answer", "context", "document", "query",
    "passage", "response", "input", "output", "feature", "features", "tokens", "conversation", "summary",
]
DATASET_DIRS = ["data", "dataset", "datasets", "corpus", "corpora", "training"]
DATASET_NAMES = [
    "train", "test", "valid", "validation", "eval", "dev", "dataset", "corpus", "training", "holdout",
]


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def has_word(lower: Column, word: str) -> Column:
    return lower.rlike(rf"(?<![a-z0-9_]){word}(?![a-z0-9_])")


def has_template_syntax(text: Column) -> Column:
    return text.contains("{{") | text.contains("{%")


def chat_shaped(lower: Column) -> Column:
    """Special tokens, a role bound to a chat role, or the message-loop shape."""
    return (
        contains_any(lower, CHAT_MARKERS)
        | lower.rlike(CHAT_ROLE)
        | has_word(lower, "assistant")
        | (has_word(lower, "messages") & has_word(lower, "role"))
    )


def named_as_prompt(path: Column) -> Column:
    low = F.lower(path)
    return (extension(path) == ".prompt") | basename(low).contains("prompt") | low.rlike("(?:^|/)prompts?/")


def prompt_columns(text: Column, path: Column) -> dict[str, Column]:
    """Confidence (null = not a prompt), method and format of one file."""
    low = F.lower(text)
    template = has_template_syntax(text)
    confirmed = contains_any(low, SYSTEM_MARKERS) | (template & chat_shaped(low))
    named = named_as_prompt(path)
    usable = extension(path).isin(PROMPT_EXTENSIONS) & ~text.contains("\x00")
    return {
        "confidence": F.when(usable & confirmed, 0.8).when(usable & named, 0.6),
        "method": F.when(confirmed, "config-analysis").otherwise("filename"),
        "format": F.when(template, "prompt-template").otherwise("prompt"),
    }


def prompt_findings(files: DataFrame) -> DataFrame:
    rows = routed(files, "prompt/file").withColumn("_text", text_of(F.col("content")))
    cols = prompt_columns(F.col("_text"), F.col("path"))
    return rows.withColumns({f"_{k}": v for k, v in cols.items()}).filter("_confidence IS NOT NULL").select(
        "scan_id", "path", F.lit("prompt").alias("kind"), basename(F.col("path")).alias("name"),
        F.struct(F.col("_format").alias("format"), F.lit(None).cast("bigint").alias("size_bytes"),
                 F.lit(None).cast("string").alias("url")).alias("data"),
        F.lit("prompt/file").alias("detector_id"), F.col("_method").alias("method"),
        F.col("_confidence").alias("confidence"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def first_line(content: Column) -> Column:
    """First line, byte-order mark dropped, trimmed."""
    return strip(F.regexp_replace(F.substring_index(text_of(content), "\n", 1), "^﻿", ""))


def csv_fields(line: Column) -> Column:
    """Column names of a CSV header line; fewer than two is no header. One pass over the line."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:[^",]|"[^"]*(?:"|$))*+),'), F.lit(1))
    names = F.transform(cells, lambda c: F.regexp_replace(strip(c), '^"|"$', ""))
    return F.when((line != "") & (F.size(names) >= 2), names)


def jsonl_fields(line: Column) -> Column:
    return F.when(line.startswith("{"), F.json_object_keys(line))


def field_signal(names: Column) -> Column:
    """At least one strong or two moderate field names."""
    keys = F.transform(names, lambda n: F.regexp_replace(F.lower(strip(n)), r"[_\-. ]", ""))
    strong = F.size(F.filter(keys, lambda k: k.isin(STRONG_FIELDS)))
    moderate = F.size(F.filter(keys, lambda k: k.isin(MODERATE_FIELDS)))
    return F.coalesce((strong >= 1) | (moderate >= 2), F.lit(False))


def name_signal(path: Column) -> Column:
    """Filed under a dataset directory, or named exactly like a dataset split."""
    low = F.lower(path)
    stem = F.regexp_replace(basename(low), r"\.[^.]*$", "")
    return low.rlike(rf"(?:^|/)(?:{'|'.join(DATASET_DIRS)})/") | stem.isin(DATASET_NAMES)


def dataset_columns(content: Column, path: Column) -> dict[str, Column]:
    """Confidence (null = not a dataset), method and format of one file."""
    ext = extension(path)
    named = name_signal(path)
    line = first_line(content)
    fields = F.when(ext == ".csv", field_signal(csv_fields(line))).when(
        ext == ".jsonl", field_signal(jsonl_fields(line))
    ).otherwise(False)
    magic = F.when(ext == ".parquet", has_bytes_at(content, 1, "50415231")).when(
        ext == ".arrow", has_bytes_at(content, 1, "4152524F5731")
    ).otherwise(False)
    return {
        "confidence": F.when((fields | magic) & named, 0.85).when(fields, 0.75).when(magic, 0.7).when(named, 0.65),
        "method": F.when(fields, "source-code-analysis").when(magic, "binary-analysis").otherwise("filename"),
        "format": F.expr("substring(_ext, 2)"),
    }


def dataset_findings(files: DataFrame) -> DataFrame:
    rows = routed(files, "dataset/file").withColumn("_ext", extension(F.col("path")))
    cols = dataset_columns(F.col("content"), F.col("path"))
    return rows.withColumns({f"_{k}": v for k, v in cols.items()}).filter("_confidence IS NOT NULL").select(
        "scan_id", "path", F.lit("dataset").alias("kind"), basename(F.col("path")).alias("name"),
        F.struct(F.col("_format").alias("format"), F.col("size").alias("size_bytes"),
                 F.lit(None).cast("string").alias("url")).alias("data"),
        F.lit("dataset/file").alias("detector_id"), F.col("_method").alias("method"),
        F.col("_confidence").alias("confidence"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def parent_name(path: Column, fallback: str = "model") -> Column:
    """Name of the enclosing directory, or the fallback at the root."""
    name = basename(dirname(path))
    return F.when(name.isin("", "."), F.lit(fallback)).otherwise(name)
