"""SARIF as rows: results, rules and security results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_case, confidence_number, confidence_text, is_set
from ..operators.order import numbered_within
from ..operators.risks import risk_description, risk_slug, risk_title
from .tables import KEYS, listed, primary_locations


def fingerprint(detector_id: Column, component_id: Column, path: Column) -> Column:
    """Line-free identity of a result: survives code that moves inside its file."""
    return F.sha2(F.concat_ws("|", detector_id, component_id, path).cast("binary"), 256)


def headline() -> Column:
    """Message of a component's results."""
    full = F.when(is_set(F.col("group")), F.concat_ws("/", "group", "name")).otherwise(F.col("name"))
    version = F.when(F.col("version").isNotNull(), F.concat(F.lit(" ["), "version", F.lit("]"))).otherwise("")
    return F.concat("kind", F.lit(" '"), full, F.lit("'"), version, F.lit(" detected (confidence "),
                    confidence_text(F.col("confidence")), F.lit(")"))


def results(component_rows: DataFrame, occ: DataFrame, strict: bool = False) -> DataFrame:
    """One result per occurrence. Present ordered by component, path, line, detector.

    The join's hot side is a component with very many occurrences; its other side is one row
    per component, and adaptive execution splits the hot partition.
    """
    comps = listed(component_rows).select(
        *KEYS, headline().alias("message"), "kind", confidence_number(F.col("confidence")).alias("component_confidence"),
        "provider", "purl",
    )
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    located = F.col("line") > 0
    return occ.join(comps, KEYS).select(
        *KEYS, F.col("detector_id").alias("rule_id"), "message",
        F.lit(None if strict else "note").cast("string").alias("level"),
        F.lit("informational" if strict else None).cast("string").alias("result_kind"),
        F.col("path").alias("uri"), positive("line").alias("start_line"),
        F.when(located, positive("col")).alias("start_column"), F.when(located, positive("end_line")).alias("end_line"),
        F.when(located, positive("end_col")).alias("end_column"), "snippet", "symbol",
        fingerprint(F.col("detector_id"), F.col("component_id"), F.col("path")).alias("fingerprint"),
        "kind", "component_confidence", confidence_number(F.col("confidence")).alias("occurrence_confidence"),
        "provider", "purl",
    )


def severity_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def risk_score(severity: Column) -> Column:
    """Bucket marker for risks, not a CVSS claim."""
    return F.when(severity == "high", "8.0").when(severity == "medium", "5.0").otherwise("3.0")


def vuln_score(score: Column, severity: Column) -> Column:
    """The base score when known, else a value inside the severity's band."""
    return (
        F.when(score > 0, F.format_string("%.1f", score))
        .when(severity == "critical", "9.5").when(severity == "high", "8.0")
        .when(severity == "medium", "5.0").when(severity == "low", "3.0").otherwise("0.0")
    )


def rules(occ: DataFrame, risk_rows: DataFrame, vulns: DataFrame | None = None) -> DataFrame:
    """Rules present in each scan with their running index: detectors, then risks, then CVEs.

    Each block is a distinct per scan first. The index is a running number over ranges of the sorted rules, so a scan
    with any number of CVEs is no window of its own.
    """
    detectors = occ.select("scan_id", "detector_id").distinct().select(
        "scan_id", F.lit(0).alias("block"), F.col("detector_id").alias("rule_id"),
        F.concat(F.lit("Components identified by the "), "detector_id", F.lit(" detector.")).alias("description"),
        F.lit("note").alias("level"), F.lit(None).cast("string").alias("security_severity"),
    )
    present = risk_rows.select("scan_id", "risk_id", "severity").distinct()
    risk_block = present.select(
        "scan_id", F.lit(1).alias("block"), F.concat(F.lit("risk/"), risk_slug(F.col("risk_id"))).alias("rule_id"),
        risk_description(F.col("risk_id")).alias("description"),
        severity_level(F.col("severity")).alias("level"), risk_score(F.col("severity")).alias("security_severity"),
    )
    out = detectors.unionByName(risk_block)
    if vulns is not None:
        one = vulns.groupBy("scan_id", "vuln_id").agg(
            F.min_by(F.struct("severity", "score", "summary"), "component_id").alias("v"))
        text = F.when(is_set(F.col("v.summary")), F.col("v.summary")).otherwise(
            F.concat(F.lit("Known vulnerability "), "vuln_id", F.lit(".")))
        out = out.unionByName(one.select(
            "scan_id", F.lit(2).alias("block"), F.concat(F.lit("cve/"), "vuln_id").alias("rule_id"),
            text.alias("description"), severity_level(F.col("v.severity")).alias("level"),
            vuln_score(F.col("v.score"), F.col("v.severity")).alias("security_severity"),
        ))
    return numbered_within(out, ["scan_id"], ["block", "rule_id"], "rule_index").withColumn("rule_index", F.col("rule_index").cast("int")).withColumn(
        "name", camel_case(F.col("rule_id")))


def risk_results(component_rows: DataFrame, risk_rows: DataFrame, details: DataFrame) -> DataFrame:
    """One security result per (component, risk). Details are distinct catalog symbols."""
    symbols = details.groupBy(*KEYS, "risk_id").agg(F.array_sort(F.collect_set("detail")).alias("symbols"))
    named = F.concat(risk_title(F.col("risk_id")), F.lit(' in "'), "name", F.lit('"'))
    return (
        risk_rows.join(component_rows.select(*KEYS, "name"), KEYS)
        .join(symbols, [*KEYS, "risk_id"], "left")
        .select(
            *KEYS, F.concat(F.lit("risk/"), risk_slug(F.col("risk_id"))).alias("rule_id"),
            severity_level(F.col("severity")).alias("level"),
            F.when(F.size("symbols") > 0, F.concat(named, F.lit(": "), F.array_join("symbols", ", ")))
            .otherwise(named).alias("message"),
            F.col("path").alias("uri"), F.when(F.col("line") > 0, F.col("line")).alias("start_line"),
            "severity", F.array_join("symbols", "|").alias("symbols"),
        )
    )


def vuln_places(component_rows: DataFrame, occ: DataFrame) -> DataFrame:
    """What a security result says of its component: name, version and lowest place; ``component_vulns`` can carry it."""
    return component_rows.select(*KEYS, F.concat_ws(" ", "name", "version").alias("affects")).join(primary_locations(occ), KEYS, "left")


def vuln_results(component_rows: DataFrame, vulns: DataFrame, occ: DataFrame) -> DataFrame:
    """One security result per (component, CVE), anchored at the component's lowest place.

    Vulnerabilities that carry ``vuln_places`` need no join.
    """
    fix = F.when(is_set(F.col("fixed")), F.concat(F.lit("; fixed in "), "fixed")).otherwise("")
    placed = vulns if "affects" in vulns.columns else vulns.drop("name", "version").join(vuln_places(component_rows, occ), KEYS)
    return (
        placed.select(
            *KEYS, F.concat(F.lit("cve/"), "vuln_id").alias("rule_id"), severity_level(F.col("severity")).alias("level"),
            F.concat("vuln_id", F.lit(" ("), "severity", F.lit(") affects "), "affects", fix).alias("message"),
            F.col("path").alias("uri"), F.when(F.col("line") > 0, F.col("line")).alias("start_line"),
            "severity", "score", "fixed",
        )
    )


def notifications(unknowns: DataFrame) -> DataFrame:
    """Files that could not be read, as tool notifications."""
    return unknowns.select("scan_id", F.lit("note").alias("level"), F.col("reason").alias("message"),
                           F.nullif("path", F.lit("")).alias("uri"), "detector_id")
