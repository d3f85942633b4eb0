"""Queries over files on disk: documents written as files, then listed, read in ranges and scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..plans import pipeline
from ..session import shared_folder
from ..sources import corpus
from .derive import table
from .detection import DOC_RULES, _load, _plain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


def text_corpus(spark, sf) -> tuple:
    """The documents as text files below source and language: the folder, and its listing without one language."""
    folder = shared_folder(spark, "corpus")
    table(spark, sf, "documents").select("text", "source", "lang").write.partitionBy("source", "lang").text(folder)
    return folder, corpus.list_corpus(spark, folder, user_globs=("lang=de/**",)).filter(F.col("path").endswith(".txt"))


_KEPT = "FROM documents WHERE lang <> 'de'"


@query("SELECT 'source=' || source AS scan_id, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, "
       f"CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines {_KEPT} GROUP BY source")
def corpus_ranges(spark, sf):
    """Every file read in ranges of 64 KiB as pieces of whole lines: bytes, and lines counted across the pieces."""
    folder, listing = text_corpus(spark, sf)
    pieces = corpus.line_pieces(corpus.line_cuts(listing, folder, range_bytes=1 << 16), folder)
    ends = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"))).cast("bigint")
    files = pieces.groupBy("scan_id", "path").agg(
        F.sum(F.length("content")).alias("bytes"), F.max(F.col("first_line") + ends - 1).alias("lines"))
    return files.groupBy("scan_id").agg(F.sum("bytes").cast("bigint").alias("bytes"), F.sum("lines").cast("bigint").alias("lines"))


@query("SELECT scan_id, rule_id, matched, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT 'source=' || source AS scan_id, '{r['id']}' AS rule_id, unnest(regexp_extract_all(text, '{_plain(r['pattern'])}', 0)) AS matched {_KEPT}"
    for r in DOC_RULES if r["id"] != "docs/token") + ") GROUP BY ALL")
def piece_matches(spark, sf):
    """Single-line rules over files read in ranges of 8 KiB, so that lines lie on every border."""
    folder, listing = text_corpus(spark, sf)
    loaded = _load(spark, [r for r in DOC_RULES if r["id"] != "docs/token"])
    found, _ = rules.match_pieces(spark, corpus.line_cuts(listing, folder, range_bytes=1 << 13), folder, loaded)
    return found.groupBy("scan_id", "rule_id", "matched").agg(F.count("*").alias("n"))


_LITERALS = ["tion", "@", "Apache-2.0"]


@query("SELECT 'source=' || source AS scan_id, literal, CAST(sum((length(text) - length(replace(text, literal, ''))) // length(literal)) AS BIGINT) AS n "
       f"FROM documents, (VALUES {', '.join(f'({x!r})' for x in _LITERALS)}) v(literal) WHERE lang <> 'de' AND contains(text, literal) GROUP BY ALL")
def literal_places(spark, sf):
    """Literals in ranges of 1000 bytes, many of them across a border."""
    folder, listing = text_corpus(spark, sf)
    found = corpus.find_literals(listing, folder, _LITERALS, range_bytes=1000)
    return found.groupBy("scan_id", "literal").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'source=' || source AS scan_id, 'dataset/file' AS detector_id, 'csv' AS format, 0.75::DOUBLE AS confidence "
       "FROM documents WHERE lang <> 'de'")
def corpus_detection(spark, sf):
    """A folder of CSV files with the fields of a training set through the whole detection."""
    folder = shared_folder(spark, "corpus")
    table(spark, sf, "documents").selectExpr("doc_id AS prompt", "n_chars AS completion", "source", "lang").write.option("header", True).partitionBy(
        "source", "lang").csv(folder)
    found, _ = pipeline.detect_corpus(spark, folder, [], user_globs=("lang=de/**",))
    return found.select("scan_id", "detector_id", F.col("data.format").alias("format"), "confidence").distinct()
