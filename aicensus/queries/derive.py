"""Inventory inputs derived from the driver tables, one SQL text for Spark and DuckDB.

``IDIV(a, b)`` stands for integer division, the one operation the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINDINGS, conform
from ..session import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Rows of a driver table that one task turns into files, of a table whose rows become files of a megabyte, and into findings.
ROWS_PER_TASK, LARGE_ROWS_PER_TASK, FINDINGS_PER_TASK = 10_000, 250, 100_000


def spread(rows: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt evenly over tasks that grow in number with them.

    A Parquet file of a few megabytes is one task, whatever is made of its rows. The rows are stored again in as many files as
    that takes: filters on what is made of them would be moved in front of a shuffle, into the one task.
    """
    tasks = -(-rows.count() // per_task)
    return stored(rows.repartition(tasks), "spread") if tasks > 1 else rows


def spark_sql(text: str) -> str:
    return re.sub(r"IDIV\(([^,()]+), ([0-9]+)\)", r"((\1) div \2)", text)


def duck_sql(text: str) -> str:
    return re.sub(r"IDIV\(([^,()]+), ([0-9]+)\)", r"((\1) // \2)", text)


def pick(expr: str, values: list[str]) -> str:
    """CASE over expr modulo the number of values; values are string literals."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {arms} END"


_KIND = pick("o_orderkey", [
    "hosted-llm", "embedding-model", "framework", "library", "vector-db", "library", "hosted-llm",
    "local-model-file", "infra", "service", "dataset"])
_HOSTED = pick("IDIV(o_orderkey, 11)", [" GPT-4.1-2026-01-14 ", "gpt-4.1", "Claude-Opus", "text-embedding-3"])
_PACKAGE = pick("IDIV(o_orderkey, 11)", [
    "chromadb", "LLaMa_Index", "OpenAI-SDK", "openai", "Haystack-AI", "weaviate-ts-client"])
_OTHER = pick("IDIV(o_orderkey, 11)", ["models/Tiny.gguf/", "Data/Train.jsonl", "Ollama", "Triton"])

# Flat findings from orders: every column is one expression over a row.
FLAT = {
    "scan_id": "concat('scan-', CAST(o_custkey % 400 AS VARCHAR(10)))",
    "finding_seq": "o_orderkey",
    "kind": _KIND,
    "name": f"CASE WHEN o_orderkey % 11 IN (0, 1, 6) THEN {_HOSTED} "
            f"WHEN o_orderkey % 11 IN (2, 3, 4, 5) THEN {_PACKAGE} ELSE {_OTHER} END",
    "provider": pick("IDIV(o_orderkey, 7)", ["", "OpenAI", " Hugging Face ", "openai", ""]),
    "ecosystem": f"CASE WHEN o_orderkey % 11 IN (2, 3, 4, 5) THEN "
                 f"{pick('IDIV(o_orderkey, 13)', ['', 'pypi', 'npm', 'pypi'])} ELSE '' END",
    "version": "CASE WHEN IDIV(o_orderkey, 17) % 3 = 0 THEN '' ELSE "
               "concat('1.', CAST(o_orderkey % 4 AS VARCHAR(10)), '.0') END",
    "grp": "CASE WHEN o_orderkey % 9 = 0 THEN concat('org', CAST(o_orderkey % 4 AS VARCHAR(10))) ELSE '' END",
    "url": "CASE WHEN o_orderkey % 13 = 0 THEN concat('https://dl/', CAST(o_orderkey % 5 AS VARCHAR(10))) ELSE '' END",
    "sha": "CASE WHEN o_orderkey % 11 = 7 AND o_orderkey % 2 = 0 THEN "
           "concat('ABCDEF0', CAST(IDIV(o_orderkey, 11) % 3 AS VARCHAR(10))) ELSE '' END",
    "arch": pick("IDIV(o_orderkey, 5)", ["llama", "", "", "", "bert", ""]),
    "params": "CAST((IDIV(o_orderkey, 5) % 3) * 1000 AS BIGINT)",
    "endpoint": "CASE WHEN o_orderkey % 11 IN (8, 9) THEN CAST(8000 + o_orderkey % 3 AS VARCHAR(10)) ELSE '' END",
    "risk": "CASE WHEN o_orderkey % 8 = 0 THEN " + pick("IDIV(o_orderkey, 8)", [
        "RISK-PICKLE-IMPORT", "RISK-KERAS-LAMBDA", "RISK-GGUF-TEMPLATE", "RISK-UNSAFE-LOAD", "Odd Risk #7"])
        + " ELSE '' END",
    "detail": "concat('d', CAST(IDIV(o_orderkey, 16) % 4 AS VARCHAR(10)))",
    "path": "concat('src/f', CAST(o_custkey % 30 AS VARCHAR(10)), '.py')",
    "line": "CAST(o_orderkey % 12 AS INT)",
    "col": "CAST(IDIV(o_orderkey, 3) % 3 AS INT)",
    "detector_id": "concat(" + pick("o_orderkey", ["rules/a/b", "det/1", "det/2", "rules/a/c"]) + ", '')",
    "method": "CASE WHEN o_orderkey % 97 = 0 THEN 'hash-comparison' ELSE "
              + pick("IDIV(o_orderkey, 3)", ["source-code-analysis", "manifest-analysis", "config-analysis"]) + " END",
    "confidence": "CAST(30 + o_orderkey % 60 AS DOUBLE) / 100",
    "snippet": "concat('line ', CAST(o_orderkey % 12 AS VARCHAR(10)))",
    "f_model": "CASE WHEN o_orderkey % 11 IN (0, 3, 5) THEN "
               + pick("IDIV(o_orderkey, 2)", ["gpt-4.1", "claude-opus", "", "nope"]) + " ELSE '' END",
    "f_temp": "CASE WHEN o_orderkey % 2 = 0 THEN concat('0.', CAST(o_orderkey % 5 AS VARCHAR(10))) ELSE '' END",
    "rel_uses": "o_orderkey % 11 IN (3, 5)",
    "rel_name": "o_orderkey % 5 = 0",
    "rel_ref": "o_orderkey % 7 = 0",
}


def flat_findings(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders"), FINDINGS_PER_TASK).selectExpr(*[f"{spark_sql(e)} AS {n}" for n, e in FLAT.items()])


FLAT_SQL = "SELECT " + ",\n".join(f"{duck_sql(e)} AS {n}" for n, e in FLAT.items()) + " FROM orders"


def _rel(kind: str, target_kind: str | None, name: str | None, from_field: str | None, ref: str | None):
    s = lambda v: F.lit(v).cast("string")
    return F.struct(s(kind).alias("type"), s(target_kind).alias("target_kind"), s(name).alias("name"),
                    s(from_field).alias("from_field"), s(ref).alias("local_ref"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """The flat findings as rows of the findings schema."""
    f = flat_findings(spark, sf)
    null = lambda t: F.lit(None).cast(t)
    relations = F.filter(F.array(
        F.when(F.col("rel_uses"), _rel("uses", "hosted-llm", None, "model", None)),
        F.when(F.col("rel_name"), _rel("depends-on", "vector-db", "chroma", None, None)),
        F.when(F.col("rel_ref"), _rel("contains", None, None, None, "a/b")),
    ), lambda r: r.isNotNull())
    fields = F.map_filter(
        F.create_map(F.lit("model"), F.col("f_model"), F.lit("param.temperature"), F.col("f_temp")),
        lambda k, v: v != "")
    full = f.withColumns({
        "group": F.col("grp"), "download_location": F.col("url"),
        "hashes": F.when(F.col("sha") != "", F.array(F.struct(F.lit("sha-256").alias("alg"), F.col("sha").alias("hex")))),
        "model": F.struct(null("string").alias("task"), F.col("arch").alias("architecture"),
                          F.col("params").alias("param_count"), null("string").alias("quantization"),
                          null("bigint").alias("context_length"), null("string").alias("format"),
                          null("string").alias("base_model")),
        "infra": F.struct(F.col("endpoint").alias("endpoint"), null("string").alias("region"),
                          null("string").alias("deployment")),
        "risks": F.when(F.col("risk") != "", F.array(F.struct(
            F.col("risk").alias("id"), F.array("detail").alias("detail")))),
        "fields": fields, "relations": relations, "symbol": null("string"),
        "end_line": F.col("line"), "end_col": F.col("col"),
    })
    return conform(full, FINDINGS)


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """One scan per distinct scan id of the findings, with a target path."""
    return flat_findings(spark, sf).select("scan_id").distinct().select(
        "scan_id", F.lit("dir").alias("kind"), F.concat(F.lit("/srv/Repos/"), F.upper("scan_id"), F.lit("/")).alias("target"))
