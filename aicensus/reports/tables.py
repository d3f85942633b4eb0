"""Summaries, listings and statistics as flat rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import confidence_text, is_set, markdown_cell
from ..functions.versions import severity_rank

KEYS = ["scan_id", "component_id"]
LISTED_EVIDENCE = 8


def listed(component_rows: DataFrame) -> DataFrame:
    """Components that count: everything but roots."""
    return component_rows.filter("kind <> 'application'")


def summary_by_kind(component_rows: DataFrame) -> DataFrame:
    """Components per scan and kind. Present ordered by count descending, then kind."""
    return listed(component_rows).groupBy("scan_id", "kind").agg(F.count("*").alias("n_components"))


def fleet_by_kind(component_rows: DataFrame) -> DataFrame:
    """Fleet totals, aggregated per scan first so one busy scan is one row per kind."""
    return summary_by_kind(component_rows).groupBy("kind").agg(
        F.sum("n_components").alias("n_components"), F.count("*").alias("n_scans")
    )


def vulns_by_severity(vulns: DataFrame) -> DataFrame:
    return vulns.groupBy("scan_id", "severity").agg(F.count("*").alias("n_vulns"))


def scan_summary(scans: DataFrame, component_rows: DataFrame, edge_rows: DataFrame, files: DataFrame,
                 vulns: DataFrame | None = None) -> DataFrame:
    """Headline counts of every scan."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("scan_id").agg(F.count("*").alias(name))

    parts = [count(listed(component_rows), "components"), count(edge_rows, "relationships"), count(files, "files")]
    if vulns is not None:
        parts.append(count(vulns, "vulnerabilities"))
    out = reduce(lambda a, b: a.join(b, "scan_id", "left"), parts, scans.select("scan_id", "target"))
    return out.fillna(0, [c for c in out.columns if c not in ("scan_id", "target")])


def primary_locations(occ: DataFrame) -> DataFrame:
    """Lowest (path, line) of each component."""
    return occ.groupBy(*KEYS).agg(F.min(F.struct("path", "line")).alias("at")).select(*KEYS, "at.path", "at.line")


def location_text(path: Column, line: Column) -> Column:
    return F.when(path == "", "-").when(line > 0, F.concat_ws(":", path, line.cast("string"))).otherwise(path)


def component_listing(component_rows: DataFrame, occ: DataFrame, vulns: DataFrame | None = None) -> DataFrame:
    """One row per component as a table writer shows it."""
    dash = lambda c: F.when(is_set(c), c).otherwise("-")
    out = listed(component_rows).join(primary_locations(occ), KEYS, "left")
    if vulns is not None:
        worst = vulns.groupBy(*KEYS).agg(
            F.max(severity_rank(F.col("severity"))).alias("_rank"), F.count("*").alias("_n")
        )
        names = F.array(*[F.lit(s) for s in ("unknown", "low", "medium", "high", "critical")])
        out = out.join(worst, KEYS, "left").withColumn("vuln", F.coalesce(
            F.concat(F.get(names, F.col("_rank")), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")), F.lit("-")))
    else:
        out = out.withColumn("vuln", F.lit("-"))
    full = F.when(is_set(F.col("group")), F.concat_ws("/", "group", "name")).otherwise(F.col("name"))
    return out.select(
        *KEYS, "kind", full.alias("name"), dash(F.col("version")).alias("version"),
        dash(F.col("provider")).alias("provider"), confidence_text(F.col("confidence")).alias("confidence"),
        "vuln", F.coalesce(location_text(F.col("path"), F.col("line")), F.lit("-")).alias("location"),
        F.col("n_occurrences").alias("evidence"),
    )


def vuln_names(component_rows: DataFrame) -> DataFrame:
    """What a vulnerability's listing shows of its component; ``component_vulns`` can carry it."""
    full = F.when(is_set(F.col("group")), F.concat_ws("/", "group", "name")).otherwise(F.col("name"))
    return component_rows.select(*KEYS, full.alias("library"), F.col("version").alias("installed"))


def vuln_listing(component_rows: DataFrame, vulns: DataFrame) -> DataFrame:
    """One row per (component, CVE). Present ordered by severity rank descending, library, id.

    Vulnerabilities that carry ``vuln_names`` need no join.
    """
    named = vulns if "library" in vulns.columns else vulns.drop("name", "version").join(vuln_names(component_rows), KEYS)
    return named.select(
        *KEYS, "library", "vuln_id", "severity", severity_rank(F.col("severity")).alias("rank"),
        F.when(is_set(F.col("fixed")), "fixed").otherwise("affected").alias("status"),
        F.coalesce("installed", F.lit("-")).alias("installed"),
        F.when(is_set(F.col("fixed")), F.col("fixed")).otherwise("-").alias("fixed"), F.col("summary").alias("title"),
    )


def scan_stats(files: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Files walked, processed and failed, and bytes, per scan."""
    walked = files.groupBy("scan_id").agg(F.count("*").alias("files_walked"), F.sum("size").alias("bytes"))
    failed = (
        unknowns.filter("path <> ''").select("scan_id", "path").distinct().groupBy("scan_id")
        .agg(F.count("*").alias("files_failed"))
    )
    return walked.join(failed, "scan_id", "left").select(
        "scan_id", "files_walked", "bytes", F.coalesce("files_failed", F.lit(0)).alias("files_failed"),
        (F.col("files_walked") - F.coalesce("files_failed", F.lit(0))).alias("files_processed"),
    )


def detector_stats(routing: DataFrame, findings: DataFrame) -> DataFrame:
    """Invocations and findings per scan and detector; rule findings count for the rule engine."""
    ran = routing.groupBy("scan_id", "detector_id").agg(F.count("*").alias("invocations"))
    owner = F.when(F.col("detector_id").startswith("rules/"), "ruleengine").otherwise(F.col("detector_id"))
    made = findings.groupBy("scan_id", owner.alias("detector_id")).agg(F.count("*").alias("findings"))
    return ran.join(made, ["scan_id", "detector_id"], "full").select(
        "scan_id", "detector_id", F.coalesce("invocations", F.lit(0)).alias("invocations"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


def compliance_summary(outcomes: DataFrame) -> DataFrame:
    """Met, gap and manual counts per scan and framework."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return outcomes.groupBy("scan_id", "framework").agg(F.count("*").alias("controls"), n("met"), n("gap"), n("manual"))


def compliance_report(outcomes: DataFrame, evidence: DataFrame, component_rows: DataFrame, occ: DataFrame,
                      items: int = LISTED_EVIDENCE) -> DataFrame:
    """Report rows: up to ``items`` evidence items of each control, and how many more there are.

    The smallest component ids are found in two steps: the first keeps as many per
    (control, hash bucket), so no single task ever sorts all evidence of a hot control. ``evidence`` itself holds all.
    """
    ctl = ["scan_id", "framework", "control"]
    # The smallest "path:line" text, not the smallest (path, line): "a:10" < "a:9".
    place = F.when(F.col("line") > 0, F.concat_ws(":", "path", F.col("line").cast("string"))).otherwise(F.col("path"))
    spots = occ.filter("path <> ''").groupBy(*KEYS).agg(F.min(place).alias("spot"))
    bucket = evidence.withColumn("_b", F.pmod(F.xxhash64("component_id"), F.lit(256)))
    first = lambda *keys: W.partitionBy(*keys).orderBy("component_id")
    few = (
        bucket.withColumn("_r", F.row_number().over(first(*ctl, "_b"))).filter(F.col("_r") <= items)
        .withColumn("_r", F.row_number().over(first(*ctl))).filter(F.col("_r") <= items)
        .drop("_b")
    )
    named = few.join(component_rows.select(*KEYS, "name"), KEYS).join(spots, KEYS, "left")
    item = F.when(F.col("spot").isNotNull(), F.concat(markdown_cell(F.col("name")), F.lit(" ("), "spot", F.lit(")"))
                  ).otherwise(markdown_cell(F.col("name")))
    cells = named.groupBy(*ctl).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("t")))), lambda s: s["t"]), "; ")
        .alias("items")
    )
    n = F.col("n_components")
    more = F.when(n > items, F.concat(
        F.lit("; …(+"), (n - items).cast("string"), F.lit(" more)"))).otherwise("")
    label = F.when(F.col("state") == "manual", "manual").otherwise(F.concat(F.lit("**"), F.upper("state"), F.lit("**")))
    return outcomes.join(cells, ctl, "left").select(
        *ctl, "ord", markdown_cell(F.col("title")).alias("title"), "state", label.alias("label"),
        F.when(F.col("items").isNotNull(), F.concat(n.cast("string"), F.lit(" component(s): "), "items", more))
        .otherwise(markdown_cell(F.col("rationale"))).alias("evidence"),
    )
