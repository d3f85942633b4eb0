"""Governance controls evaluated over components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTROLS, KINDS
from ..session import collect_config
from .risks import RISK_CATALOG, RISK_SEVERITIES, risk_slug

# The shipped control mappings
# (framework, control, title, evidence_of, gap_if); neither expression means manual.
FRAMEWORKS = {
    "nist-ai-rmf": ("NIST AI Risk Management Framework", "1.0"),
    "owasp-agentic": ("OWASP Agentic AI — Threats and Mitigations", "1.0"),
}
CONTROL_ROWS = [
    ("nist-ai-rmf", "GOVERN-1.1", "Legal and regulatory requirements involving AI are understood, managed, and documented", "", ""),
    ("nist-ai-rmf", "GOVERN-4.1", "Organizational practices foster critical thinking about the potential impacts of AI", "", ""),
    ("nist-ai-rmf", "MAP-2.1", "The specific tasks and methods used to implement the AI system are defined and documented",
     "hosted-llm | local-model-file | embedding-model | framework | rag-pipeline", ""),
    ("nist-ai-rmf", "MAP-4.1", "Approaches for mapping third-party AI technology risks are in place",
     "framework | library | hosted-llm | embedding-model", ""),
    ("nist-ai-rmf", "MAP-1.1", "Intended purpose, context of use, and norms/expectations are documented", "", ""),
    ("nist-ai-rmf", "MEASURE-2.7", "AI system security and resilience are evaluated and documented", "", "risk"),
    ("nist-ai-rmf", "MEASURE-1.1", "Approaches and metrics for measuring AI risks are selected and documented", "", ""),
    ("nist-ai-rmf", "MANAGE-2.2", "Mechanisms are in place to sustain the value of deployed AI systems", "", ""),
    ("nist-ai-rmf", "MANAGE-4.1", "Post-deployment AI system monitoring plans are implemented", "", ""),
    ("owasp-agentic", "T1", "Memory Poisoning — malicious data corrupts an agent's short- or long-term memory", "", ""),
    ("owasp-agentic", "T2", "Tool Misuse — an agent is manipulated into abusing its authorized tools", "", ""),
    ("owasp-agentic", "T3", "Privilege Compromise — an agent escalates or misuses its permissions", "", ""),
    ("owasp-agentic", "T4", "Resource Overload — compute/memory/service exhaustion via the agent", "", ""),
    ("owasp-agentic", "T5", "Cascading Hallucination Attacks — false information propagates through agent actions", "", ""),
    ("owasp-agentic", "T6", "Intent Breaking & Goal Manipulation — an agent's objectives are subverted", "", ""),
    ("owasp-agentic", "T8", "Repudiation & Untraceability — agent actions cannot be attributed or audited", "", ""),
    ("owasp-agentic", "T9", "Identity Spoofing & Impersonation — an actor impersonates an agent or user", "", ""),
    ("owasp-agentic", "T10", "Overwhelming Human-in-the-Loop — approval fatigue defeats human oversight", "", ""),
    ("owasp-agentic", "T11", "Unexpected RCE and Code Attacks — code execution through the model/artifact supply chain", "", "risk"),
]


def shipped_controls(spark: SparkSession, frameworks: list[str] | None = None) -> DataFrame:
    """The shipped controls as a table; an unknown framework is an error."""
    for name in frameworks or []:
        if name not in FRAMEWORKS:
            raise ValueError(f"unknown framework {name!r}; valid: {sorted(FRAMEWORKS)}")
    rows = [
        (fw, *FRAMEWORKS[fw], ctl, i, title, ev, gap, not ev and not gap)
        for i, (fw, ctl, title, ev, gap) in enumerate(CONTROL_ROWS)
        if frameworks is None or fw in frameworks
    ]
    return spark.createDataFrame(rows, CONTROLS)


def risk_selector_ok(sel: str) -> bool:
    return sel in RISK_SEVERITIES or sel in [row[2] for row in RISK_CATALOG]


def has_risk(sel: str) -> Column:
    """Component carries a risk: any, of a severity, or with a slug. Reads ``risk_tags``."""
    if not sel:
        return F.size("risk_tags") > 0
    return F.array_contains("risk_tags", sel)


def expression(raw: str) -> Column:
    """Control expression to a predicate over tagged components: kinds, '*', risk terms, | and &."""
    def term(text: str) -> Column:
        text = text.strip()
        if not text:
            raise ValueError("empty term (dangling & or |)")
        if text == "*":
            return F.lit(True)
        if text == "risk" or text.startswith("risk:"):
            sel = text.partition(":")[2]
            if text != "risk" and not risk_selector_ok(sel):
                raise ValueError(f"unknown risk selector {sel!r}")
            return has_risk(sel)
        if text in KINDS:
            return F.col("kind") == text
        raise ValueError(f"unknown term {text!r}")

    clauses = [[term(t) for t in clause.split("&")] for clause in raw.split("|")]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, c) for c in clauses])


def tag_components(component_rows: DataFrame, risk_rows: DataFrame) -> DataFrame:
    """Components with ``risk_tags``: severities and slugs of their risks.

    Risk rows are distinct per (component, risk) and the tags come from a catalog, so the
    array stays a handful of words.
    """
    tags = (
        risk_rows.select(
            "scan_id", "component_id",
            F.explode(F.array("severity", risk_slug(F.col("risk_id")))).alias("tag"),
        )
        .groupBy("scan_id", "component_id")
        .agg(F.array_sort(F.collect_set("tag")).alias("risk_tags"))
    )
    return component_rows.join(tags, ["scan_id", "component_id"], "left").withColumn(
        "risk_tags", F.coalesce("risk_tags", F.array().cast("array<string>"))
    )


def control_evidence(tagged: DataFrame, control_rows: DataFrame) -> DataFrame:
    """One row per (scan, control, component) match; roots never count.

    Controls are configuration: their expressions become Columns evaluated in one pass.
    """
    matches = []
    for row in collect_config(control_rows):
        if row["manual"]:
            continue
        expr = row["evidence_of"] or row["gap_if"]
        hit = F.struct(F.lit(row["framework"]).alias("framework"), F.lit(row["control"]).alias("control"))
        matches.append(F.when(expression(expr), hit))
    nothing = F.lit(None).cast("struct<framework:string,control:string>")
    hits = F.array(*matches) if matches else F.array(nothing)
    return (
        tagged.filter("kind <> 'application'")
        .select("scan_id", "component_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
        .select("scan_id", "h.framework", "h.control", "component_id")
    )


def control_outcomes(tagged: DataFrame, control_rows: DataFrame, scans: DataFrame) -> DataFrame:
    """One verdict per scan and control.

    The control list is attached to every scan by exploding a literal array, and only match
    counts are aggregated; the evidence itself stays in ``control_evidence``.
    """
    counts = control_evidence(tagged, control_rows).groupBy("scan_id", "framework", "control").agg(
        F.count("*").alias("n")
    )
    config = collect_config(control_rows)
    literal = F.array(*[
        F.struct(
            F.lit(r["framework"]).alias("framework"), F.lit(r["control"]).alias("control"),
            F.lit(r["ord"]).alias("ord"), F.lit(r["title"]).alias("title"),
            F.lit("manual" if r["manual"] else "evidence" if r["evidence_of"] else "gap").alias("rule"),
        )
        for r in config
    ])
    grid = scans.select("scan_id").distinct().select("scan_id", F.explode(literal).alias("c")).select("scan_id", "c.*")
    n = F.coalesce("n", F.lit(0))
    state = (
        F.when(F.col("rule") == "manual", "manual")
        .when((F.col("rule") == "evidence") == (n > 0), "met")
        .otherwise("gap")
    )
    text = n.cast("string")
    rationale = (
        F.when(F.col("rule") == "manual", "a person has to attest this control")
        .when((F.col("rule") == "evidence") & (n > 0), F.concat(text, F.lit(" supporting components")))
        .when(F.col("rule") == "evidence", "nothing in the inventory supports this control")
        .when(n > 0, F.concat(text, F.lit(" components open this gap")))
        .otherwise("the inventory opens no gap")
    )
    return grid.join(counts, ["scan_id", "framework", "control"], "left").select(
        "scan_id", "framework", "control", "ord", "title", state.alias("state"),
        F.when(state == "met", 1.0).when(state == "gap", 0.0).alias("score"),
        n.alias("n_components"), rationale.alias("rationale"),
    )
