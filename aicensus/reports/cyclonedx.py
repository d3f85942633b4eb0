"""CycloneDX as rows: components, evidence, properties, model cards, dependencies, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import ID_PREFIX
from ..functions.text import confidence_number, confidence_text, is_set
from ..operators.risks import risk_description
from .tables import KEYS

MODEL_KINDS = ["hosted-llm", "local-model-file", "embedding-model"]


def component_type(kind: Column) -> Column:
    """The coarser CycloneDX type; the exact kind stays a property."""
    return (
        F.when(kind.isin(MODEL_KINDS), "machine-learning-model")
        .when(kind.isin("framework", "library"), kind)
        .when(kind.isin("prompt", "dataset", "ai-config"), "data")
        .otherwise("application")
    )


def data_type(kind: Column) -> Column:
    return F.when(kind == "dataset", "dataset").when(kind == "ai-config", "configuration").when(kind == "prompt", "other")


def components(component_rows: DataFrame) -> DataFrame:
    return component_rows.select(
        "scan_id", F.col("component_id").alias("bom_ref"), component_type(F.col("kind")).alias("type"),
        "name", "group", "version", "purl", data_type(F.col("kind")).alias("data_type"),
        F.when(data_type(F.col("kind")).isNotNull() & (F.col("data_url.p") == "known"), F.col("data_url.v")).alias("data_url"),
        F.col("download_location").alias("distribution_url"),
    )


def hashes(hash_rows: DataFrame) -> DataFrame:
    """SHA-256 digests only."""
    return hash_rows.filter(F.lower("alg").isin("sha-256", "sha256")).select(
        "scan_id", F.col("component_id").alias("bom_ref"), F.lit("SHA-256").alias("alg"), F.col("hex").alias("content")
    )


def licenses(license_rows: DataFrame) -> DataFrame:
    """Expression before SPDX id before name."""
    form = F.when(is_set(F.col("expression")), "expression").when(is_set(F.col("spdx_id")), "id").when(
        is_set(F.col("name")), "name")
    value = F.when(form == "expression", F.col("expression")).when(form == "id", F.col("spdx_id")).otherwise(F.col("name"))
    return license_rows.select(
        "scan_id", F.col("component_id").alias("bom_ref"), form.alias("form"), value.alias("value")
    ).filter("form IS NOT NULL")


def evidence_occurrences(occ: DataFrame) -> DataFrame:
    return occ.select(
        "scan_id", F.col("component_id").alias("bom_ref"), F.col("path").alias("location"),
        F.when(F.col("line") > 0, F.col("line")).alias("line"), "symbol", F.col("snippet").alias("additional_context"),
    )


def evidence_identity(claims: DataFrame) -> DataFrame:
    """Contested identity. config-analysis has no technique of its own and becomes 'other'."""
    config = F.col("method") == "config-analysis"
    return claims.select(
        "scan_id", F.col("component_id").alias("bom_ref"), "field", F.col("value").alias("concluded_value"),
        confidence_number(F.col("confidence")).alias("confidence"),
        F.when(config, "other").otherwise(F.col("method")).alias("technique"),
        F.when(config, F.col("method")).alias("method_value"),
    )


def _property(rows: DataFrame, name: Column | str, value: Column) -> DataFrame:
    label = F.lit(ID_PREFIX + name) if isinstance(name, str) else F.concat(F.lit(ID_PREFIX), name)
    return rows.select("scan_id", F.col("component_id").alias("bom_ref"), label.alias("name"), value.alias("value")).filter(
        "value IS NOT NULL")


def properties(component_rows: DataFrame, edge_rows: DataFrame, params: DataFrame, risk_rows: DataFrame,
               details: DataFrame) -> DataFrame:
    """Property rows. Present ordered by (name, value) within a component; repeats are kept."""
    known = lambda c: F.when(F.col(f"{c}.p") == "known", F.col(f"{c}.v").cast("string"))
    provider = F.when(is_set(F.col("provider")), F.col("provider"))
    pair = lambda n, v: F.struct(F.lit(ID_PREFIX + n).alias("name"), v.cast("string").alias("value"))
    own = F.array(
        pair("kind", F.col("kind")), pair("confidence", confidence_text(F.col("confidence"))),
        pair("model.provider", F.when(F.col("kind").isin(MODEL_KINDS), provider)),
        pair("provider", F.when(~F.col("kind").isin(MODEL_KINDS), provider)),
        pair("model.paramCount", known("model_param_count")), pair("model.quantization", known("model_quantization")),
        pair("model.contextLength", known("model_context_length")), pair("model.format", known("model_format")),
        pair("model.baseModel", known("model_base_model")), pair("dataset.types", known("data_format")),
        pair("dataset.size", known("data_size_bytes")), pair("service.endpoint", known("infra_endpoint")),
    )
    given = F.coalesce("properties", F.array().cast("array<struct<name:string,value:string>>"))
    scalar = component_rows.select(
        "scan_id", F.col("component_id").alias("bom_ref"), F.explode(F.concat(own, given)).alias("p")
    ).select("scan_id", "bom_ref", "p.name", "p.value").filter("value IS NOT NULL")
    bound = F.concat(F.col("value"), F.lit(" @ "), "path", F.lit(":"), F.col("line").cast("string"))
    edges = edge_rows.filter(~F.col("type").isin("depends-on", "trained-on")).select(
        "scan_id", F.col("from_id").alias("component_id"), "type",
        F.concat("to_id", F.lit("@"), confidence_text(F.col("confidence"))).alias("_v"),
    )
    pickled = details.filter("risk_id = 'RISK-PICKLE-IMPORT'").groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_set("detail")), "|").alias("_v"))
    parts = [
        scalar,
        _property(params, F.concat(F.lit("param."), "param"), bound),
        _property(edges, F.concat(F.lit("rel."), "type"), F.col("_v")),
        _property(risk_rows.filter("risk_id = 'RISK-PICKLE-IMPORT'"), "pickle.risk", F.col("severity")),
        _property(pickled, "pickle.imports", F.col("_v")),
    ]
    return reduce(DataFrame.unionByName, parts)


def trained_on(edge_rows: DataFrame) -> DataFrame:
    """Datasets a model was trained on, one row each."""
    return edge_rows.filter("type = 'trained-on'").select(
        "scan_id", F.col("from_id").alias("bom_ref"), F.col("to_id").alias("dataset_ref"))


def model_cards(component_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Cards of models with a known task or architecture, or with training data."""
    data = trained_on(edge_rows).groupBy("scan_id", F.col("bom_ref").alias("component_id")).agg(
        F.count("*").alias("datasets"))
    known = lambda c: F.when(F.col(f"{c}.p") == "known", F.col(f"{c}.v"))
    return (
        component_rows.filter(F.col("kind").isin(MODEL_KINDS))
        .join(data, KEYS, "left")
        .select("scan_id", F.col("component_id").alias("bom_ref"), known("model_task").alias("task"),
                known("model_architecture").alias("architecture"), F.coalesce("datasets", F.lit(0)).alias("datasets"))
        .filter("task IS NOT NULL OR architecture IS NOT NULL OR datasets > 0")
    )


def dependencies(edge_rows: DataFrame) -> DataFrame:
    """(ref, depends_on) pairs; flat, because a root may depend on everything."""
    return edge_rows.filter("type = 'depends-on'").select(
        "scan_id", F.col("from_id").alias("ref"), F.col("to_id").alias("depends_on")).distinct()


def scoring_method(vector: Column) -> Column:
    return (
        F.when(vector.startswith("CVSS:3.1/"), "CVSSv31").when(vector.startswith("CVSS:3.0/"), "CVSSv3")
        .when(vector.startswith("CVSS:2.0/") | vector.startswith("AV:"), "CVSSv2")
        .when(vector.startswith("CVSS:4.0/"), "CVSSv4").otherwise("other")
    )


def vulnerabilities(risk_rows: DataFrame, details: DataFrame, vulns: DataFrame | None = None) -> DataFrame:
    """Artifact risks and CVEs in one table. Present ordered by (affects, id)."""
    symbols = details.groupBy(*KEYS, "risk_id").agg(F.array_join(F.array_sort(F.collect_set("detail")), "|").alias("symbols"))
    place = F.when(F.col("line") > 0, F.concat_ws(":", "path", F.col("line").cast("string"))).otherwise(F.col("path"))
    out = risk_rows.join(symbols, [*KEYS, "risk_id"], "left").select(
        "scan_id", F.col("component_id").alias("affects"), F.col("risk_id").alias("id"), F.lit("risk").alias("source"),
        "severity", F.lit("other").alias("method"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("vector"), risk_description(F.col("risk_id")).alias("description"),
        place.alias("evidence"), "symbols", F.lit(None).cast("string").alias("fixed_version"),
        F.lit(None).cast("string").alias("references"),
    )
    if vulns is None:
        return out
    return out.unionByName(vulns.select(
        "scan_id", F.col("component_id").alias("affects"), F.col("vuln_id").alias("id"), F.lit("advisory").alias("source"),
        "severity", F.when(is_set(F.col("vector")), scoring_method(F.col("vector"))).alias("method"),
        F.when(F.col("score") > 0, F.col("score")).alias("score"), F.nullif("vector", F.lit("")).alias("vector"),
        F.col("summary").alias("description"), F.lit(None).cast("string").alias("evidence"),
        F.lit(None).cast("string").alias("symbols"), F.nullif("fixed", F.lit("")).alias("fixed_version"),
        F.nullif(F.array_join("aliases", "|"), F.lit("")).alias("references"),
    ))


def declarations(outcomes: DataFrame) -> DataFrame:
    """Compliance claims: one per control, manual ones without a score."""
    return outcomes.select(
        "scan_id", F.col("framework").alias("standard"), F.col("control").alias("requirement"),
        F.concat_ws("/", F.lit("claim"), "framework", "control").alias("claim_ref"),
        "score", F.col("rationale"), (F.col("state") == "manual").alias("manual"),
    )
