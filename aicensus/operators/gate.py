"""Gate expressions, verdicts and the minimum-confidence filter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import severity_rank
from ..schemas import KINDS
from .controls import CONTROL_ROWS, FRAMEWORKS, has_risk, risk_selector_ok

_SEVERITIES = ["low", "medium", "high", "critical"]
_GATE_KINDS = [k for k in KINDS if k != "application"]


@dataclass(frozen=True)
class Gate:
    """A parsed gate: component clauses as Columns, and gap selectors on controls."""

    clauses: list[Column]
    gaps: list[tuple[str, str]]  # (framework, control), '' = any
    uses_cve: bool

    @property
    def uses_controls(self) -> bool:
        return bool(self.gaps)


def match_any() -> Gate:
    """The gate that trips on any component."""
    return Gate([F.lit(True)], [], False)


def parse_gate(text: str, controls: list[tuple[str, str]] | None = None) -> Gate:
    """OR of ANDs over kinds, confidence bounds, risk, cve and compliance terms.

    ``controls`` lists the known (framework, control) pairs. Bad terms are errors here,
    never gates that silently cannot trip.
    """
    known = [(r[0], r[1]) for r in CONTROL_ROWS] if controls is None else controls
    if not text.strip():
        raise ValueError("empty gate expression")
    clauses: list[Column] = []
    gaps: list[tuple[str, str]] = []
    uses_cve = False
    for clause in text.split("|"):
        terms = [t.strip() for t in clause.split("&")]
        if any(t == "compliance" or t.startswith("compliance:") for t in terms):
            if len(terms) > 1:
                raise ValueError("a compliance term cannot be combined with &")
            gaps.append(_gap_selector(terms[0], known))
            continue
        uses_cve = uses_cve or any(t == "cve" or t.startswith("cve:") for t in terms)
        clauses.append(reduce(lambda a, b: a & b, [_term(t) for t in terms]))
    return Gate(clauses, gaps, uses_cve)


def _term(text: str) -> Column:
    if not text:
        raise ValueError("empty term (dangling & or |)")
    bound = re.fullmatch(r"confidence\s*(>=|<=|>|<|=)\s*([0-9.]+)", text)
    if bound:
        value = float(bound[2])
        if not 0 <= value <= 1:
            raise ValueError(f"confidence bound {value} outside [0,1]")
        c = F.col("confidence")
        return {">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "=": c == value}[bound[1]]
    head, colon, sel = text.partition(":")
    if head == "risk":
        if colon and not risk_selector_ok(sel):
            raise ValueError(f"unknown risk selector {sel!r}")
        return has_risk(sel)
    if head == "cve":
        if colon and sel not in _SEVERITIES:
            raise ValueError(f"unknown cve severity {sel!r}")
        rank = _SEVERITIES.index(sel) + 1 if colon else 0
        return F.coalesce(F.col("worst_cve") >= rank, F.lit(False))
    if text == "pickle-risk":
        return has_risk("pickle-import")
    if text in _GATE_KINDS:
        return F.col("kind") == text
    raise ValueError(f"unknown gate term {text!r}")


def _gap_selector(text: str, known: list[tuple[str, str]]) -> tuple[str, str]:
    sel = text.partition(":")[2]
    if sel in ("", "gap"):
        return ("", "")
    framework, colon, control = sel.partition(":")
    if framework not in {fw for fw, _ in known}:
        raise ValueError(f"unknown framework {framework!r}; valid: {sorted(FRAMEWORKS)}")
    if colon and (framework, control) not in known:
        raise ValueError(f"framework {framework!r} has no control {control!r}")
    return (framework, control)


def with_worst_cve(tagged: DataFrame, vulns: DataFrame | None) -> DataFrame:
    """Add ``worst_cve``: highest severity rank among a component's CVEs, null if none."""
    if vulns is None:
        return tagged.withColumn("worst_cve", F.lit(None).cast("int"))
    worst = vulns.groupBy("scan_id", "component_id").agg(
        F.max(severity_rank(F.col("severity"))).alias("worst_cve")
    )
    return tagged.join(worst, ["scan_id", "component_id"], "left")


def gate_verdicts(
    gate: Gate,
    tagged: DataFrame,
    scans: DataFrame,
    vulns: DataFrame | None = None,
    outcomes: DataFrame | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """One row per scan: does the unfiltered inventory trip the gate?

    Fails closed. A gate on CVEs or controls without that overlay is an error at plan time,
    and a scan with unchecked components fails a job whose gate reads CVEs.
    """
    if gate.uses_cve and vulns is None:
        raise ValueError("the gate reads CVEs but no advisory overlay was given")
    if gate.uses_controls and outcomes is None:
        raise ValueError("the gate reads controls but none were evaluated")
    hit = reduce(lambda a, b: a | b, gate.clauses) if gate.clauses else F.lit(False)
    found = (
        with_worst_cve(tagged, vulns)
        .filter("kind <> 'application'")
        .groupBy("scan_id")
        .agg(F.bool_or(hit).alias("component_hit"))
    )
    out = scans.select("scan_id").distinct().join(found, "scan_id", "left")
    if gate.uses_controls:
        wanted = reduce(lambda a, b: a | b, [
            (F.lit(fw == "") | (F.col("framework") == fw)) & (F.lit(ctl == "") | (F.col("control") == ctl))
            for fw, ctl in gate.gaps
        ])
        gaps = outcomes.filter(F.col("state") == "gap").groupBy("scan_id").agg(F.bool_or(wanted).alias("gap_hit"))
        out = out.join(gaps, "scan_id", "left")
    else:
        out = out.withColumn("gap_hit", F.lit(False))
    if gate.uses_cve and coverage is not None:
        out = out.join(coverage.select("scan_id", "unchecked"), "scan_id", "left").withColumn(
            "component_hit",
            F.when(F.coalesce("unchecked", F.lit(0)) > 0,
                   F.raise_error(F.concat_ws(" ", F.lit("unchecked components in"), "scan_id")).cast("boolean"))
            .otherwise(F.col("component_hit")),
        )
    tripped = F.coalesce("component_hit", F.lit(False)) | F.coalesce("gap_hit", F.lit(False))
    return out.select("scan_id", tripped.alias("tripped"))


def fleet_verdict(verdicts: DataFrame) -> DataFrame:
    """The fleet trips if any scan does."""
    return verdicts.agg(
        F.coalesce(F.bool_or("tripped"), F.lit(False)).alias("tripped"),
        F.count_if("tripped").alias("scans_tripped"), F.count("*").alias("scans"),
    )


def min_confidence(component_rows: DataFrame, edge_rows: DataFrame, bound: float) -> tuple[DataFrame, DataFrame]:
    """Presentation filter: keep roots and components at or above the bound, and edges whose
    two ends survive. Never applied before a gate."""
    kept = component_rows.filter((F.col("kind") == "application") | (F.col("confidence") >= bound))
    alive = kept.select("scan_id", "component_id")
    edges = edge_rows.join(
        alive.withColumnRenamed("component_id", "from_id"), ["scan_id", "from_id"], "left_semi"
    ).join(alive.withColumnRenamed("component_id", "to_id"), ["scan_id", "to_id"], "left_semi")
    return kept, edges
