"""Table schemas. Every table starts with ``scan_id``: one job inventories many scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = (
    "scan_id string, path string, size bigint, mod_time timestamp, content binary"
)

RULES = (
    "id string, layer_seq int, disable boolean, kind string, provider string, "
    "languages array<string>, keywords array<string>, pattern string, regions array<string>, "
    "claim struct<name:string,group:string,version:string>, "
    "relations array<struct<type:string,target_kind:string,name:string,from_field:string,local_ref:string>>, "
    "within_lines int, param_names array<string>, risk string, confidence double"
)

RELATION_CLAIM = (
    "struct<type:string,target_kind:string,name:string,from_field:string,local_ref:string>"
)

FINDINGS = (
    "scan_id string, finding_seq bigint, kind string, name string, group string, version string, "
    "provider string, ecosystem string, download_location string, "
    "licenses array<struct<spdx_id:string,name:string,expression:string>>, "
    "hashes array<struct<alg:string,hex:string>>, "
    "model struct<task:string,architecture:string,param_count:bigint,quantization:string,"
    "context_length:bigint,format:string,base_model:string>, "
    "data struct<format:string,size_bytes:bigint,url:string>, "
    "infra struct<endpoint:string,region:string,deployment:string>, "
    "risks array<struct<id:string,detail:array<string>>>, "
    "path string, line int, col int, end_line int, end_col int, "
    "detector_id string, method string, confidence double, snippet string, symbol string, "
    f"fields map<string,string>, relations array<{RELATION_CLAIM}>"
)

UNKNOWNS = "scan_id string, path string, detector_id string, reason string"

ADVISORIES = (
    "id string, aliases array<string>, ecosystem string, package string, summary string, "
    "severity array<struct<type:string,score:string>>, db_severity string, "
    "ranges array<struct<type:string,events:array<map<string,string>>>>"
)

CONTROLS = (
    "framework string, framework_name string, framework_version string, control string, ord int, "
    "title string, evidence_of string, gap_if string, manual boolean"
)

# The enumerations of the data model.
KINDS = [
    "hosted-llm", "local-model-file", "embedding-model", "framework", "library", "vector-db",
    "prompt", "dataset", "ai-config", "infra", "service", "rag-pipeline", "application",
]
METHODS = [
    "source-code-analysis", "ast-fingerprint", "manifest-analysis", "binary-analysis",
    "hash-comparison", "config-analysis", "filename", "attestation",
]
RELATION_TYPES = [
    "uses", "depends-on", "served-by", "queries", "embeds-with", "prompted-by", "trained-on",
    "derived-from", "configures", "contains",
]


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str = FINDINGS) -> DataFrame:
    """Project ``df`` to a table schema, filling absent columns with typed nulls."""
    have = set(df.columns)
    cols: list[Column] = []
    for field in struct_type(ddl).fields:
        if field.name in have:
            cols.append(F.col(f"`{field.name}`").cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def check_enums(findings: DataFrame) -> DataFrame:
    """Fail the job on a row outside the enumerations; narrow, no extra pass over the data."""
    bad = ~F.col("kind").isin(KINDS) | ~F.col("method").isin(METHODS)
    return findings.withColumn(
        "kind",
        F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("bad finding"), "kind", "method")).cast("string"))
        .otherwise(F.col("kind")),
    )
