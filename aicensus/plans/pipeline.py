"""The whole dataflow: files -> findings -> inventory tables -> overlays.

What several later steps read is written once as Parquet to the shared checkpoint folder: the routed
files, the findings, the sightings, and the inventory tables when first asked for. So a corpus is read once
however many detectors there are, and reports read stored tables. ``stage=False`` keeps one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_set, lines_of, snippet
from ..operators import artifacts, assemble, assets, graph, infra, manifests, project, rule_scan
from ..operators.controls import control_evidence, control_outcomes, tag_components
from ..operators.gate import gate_verdicts, min_confidence, parse_gate
from ..schemas import FINDINGS, UNKNOWNS, conform
from ..session import stored
from ..sources import corpus
from ..sources.files import language_of, prepare, split_failures, text_of, truncations
from ..sources.routing import ROUTES, SELECTORS, read_by_some, routed, select_detectors, with_routes

_PROJECT = ["project/adapter", "project/configbind", "project/hfdir", "project/raglink"]
_RANKS = {d: i for i, d in enumerate([*[s.detector_id for s in SELECTORS], *_PROJECT])}
# Config and weights files the cross-file detectors read.
_PROJECT_FILES = r"(?:^|/)(?:config|model_index|adapter_config|model_config|[^/]*generation[^/]*config[^/]*)\.(?:json|ya?ml)$"


def sequence(phase: int, detector_id: Column, within: Column) -> Column:
    """``finding_seq``: phase, detector registration and order inside the file in one number."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in _RANKS.items() for x in kv]), detector_id)
    rank = F.coalesce(rank, F.lit(len(_RANKS))).cast("bigint")
    return F.lit(phase << 56) + F.shiftleft(rank, 40) + F.coalesce(within.cast("bigint"), F.lit(0))


def _finish(rows: DataFrame, phase: int, within: str = "line") -> DataFrame:
    return conform(rows.withColumn("finding_seq", sequence(phase, F.col("detector_id"), F.col(within))), FINDINGS)


def detect_files(files: DataFrame, rules: list[dict], any_language: bool = False, detectors: set[str] | None = None):
    """Phase 1: every per-file detector. Returns (findings, unknowns)."""
    on = lambda *ids: detectors is None or any(d in detectors for d in ids)
    parts: list[DataFrame] = []
    unknowns: list[DataFrame] = []
    if on(*[s.detector_id for s in SELECTORS if "manifest" in s.tags]):
        parts.append(_finish(manifests.dependency_findings(files), 1))
        unknowns += [manifests.npm_unknowns(files), manifests.xml_unknowns(files)]
    if on("prompt/file"):
        parts.append(_finish(assets.prompt_findings(files), 1))
    if on("dataset/file"):
        parts.append(_finish(assets.dataset_findings(files), 1))
    if on("infra/dockerfile"):
        parts.append(_finish(infra.dockerfile_findings(files), 1))
    if on("infra/compose"):
        parts.append(_finish(infra.compose_findings(files), 1))
    if on("gosrc/ast"):
        parts.append(_finish(infra.go_findings(files), 1))
    if on(*[s.detector_id for s in SELECTORS if "modelfile" in s.tags]):
        facts = artifacts.artifact_facts(files)
        parts.append(_finish(artifacts.artifact_findings(files, facts), 1))
        reason = F.coalesce("error", F.try_element_at("facts", F.lit("broken")))
        unknowns.append(facts.select("scan_id", "path", "detector_id", reason.alias("reason")).filter("reason IS NOT NULL"))
        unknowns.append(artifacts.safetensors_unknowns(routed(files, "modelfile/safetensors")))
    if rules and on("ruleengine"):
        wanted = files if any_language or ROUTES not in files.columns else routed(files, "ruleengine")
        matches = rule_scan.scan_rules(wanted, rules, any_language)
        parts.append(_finish(rule_scan.match_findings(matches), 1, "match_seq"))
        unknowns.append(split_failures(matches.select("scan_id", "path", "error"), "ruleengine")[1])
    findings = reduce(DataFrame.unionByName, parts)
    if detectors is not None:
        findings = findings.filter(F.col("detector_id").isin(*detectors) | F.col("detector_id").startswith("rules/"))
    failed = conform(reduce(DataFrame.unionByName, unknowns), UNKNOWNS) if unknowns else (
        files.sparkSession.createDataFrame([], UNKNOWNS))
    return findings, failed


def detect_projects(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Phase 2: detectors that look across the files of a scan."""
    parts = [
        project.adapters(files), project.config_bindings(files), project.model_directories(files),
        project.rag_pipelines(findings),
    ]
    return reduce(DataFrame.unionByName, [_finish(p, 2) for p in parts])


_WEIGHTS = r"\.(?:safetensors|bin|gguf)$"
_ROW_GROUP = 8 << 20


def project_file() -> Column:
    """Files that the detectors across a scan read."""
    return F.col("path").rlike(_PROJECT_FILES) | F.col("path").rlike(_WEIGHTS)


class Watch:
    """Counts gathered while the detection's tables are written, without a pass of their own: files walked, their bytes,
    files that some detector reads, and for each per-file detector its files and its findings."""

    def __init__(self):
        self._walk, self._found = Observation(), Observation()
        self._ids = [s.detector_id for s in SELECTORS]

    def walk(self, routed: DataFrame) -> DataFrame:
        read = [F.count_if(F.col(ROUTES).contains(f"|{d}|")).alias(d) for d in self._ids]
        return routed.observe(self._walk, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
                              F.count_if(F.col(ROUTES) != "").alias("routed"), *read)

    def found(self, findings: DataFrame) -> DataFrame:
        owner = F.when(F.col("detector_id").startswith("rules/"), "ruleengine").otherwise(F.col("detector_id"))
        return findings.observe(self._found, *(F.count_if(owner == d).alias(d) for d in self._ids))

    def totals(self) -> dict[str, int]:
        return {n: self._walk.get[n] for n in ("files", "bytes", "routed")}

    def detectors(self) -> dict[str, tuple[int, int]]:
        """Detector id to (files read, findings)."""
        return {d: (self._walk.get[d], self._found.get[d]) for d in self._ids}


def detect(
    files: DataFrame, rules: list[dict], *, any_language: bool = False, max_bytes: int | None = None,
    user_globs: tuple[str, ...] = (), detectors: set[str] | str | None = None, stage: bool = True,
    user_detectors: tuple[Callable[[DataFrame], DataFrame], ...] = (), watch: Watch | None = None,
):
    """files -> (findings, unknowns). ``watch`` counts along (only with ``stage``).

    ``detectors`` is a set of ids or a selection expression (see ``select_detectors``). A user detector maps the
    files to findings rows; snippets it leaves out are filled from the line it names.

    The files are routed once and stored by the set of detectors that read them; each detector reads its partitions.
    """
    if isinstance(detectors, str):
        detectors = {s.detector_id for s, _ in select_detectors(detectors)}
    prepared = prepare(files, max_bytes, user_globs)
    if stage:
        rows = with_routes(prepared, {"project": project_file()})
        rows = rows if watch is None else watch.walk(rows)
        if not any_language and not user_detectors:
            rows = read_by_some(rows)
        prepared = stored(rows, "routed-files", (ROUTES,), _ROW_GROUP)
    findings, unknowns = detect_files(prepared, rules, any_language, detectors)
    for detector in user_detectors:
        findings = findings.unionByName(fill_snippets(_finish(detector(prepared.drop(ROUTES)), 1), prepared))
    if stage:
        findings = stored(findings if watch is None else watch.found(findings), "findings")
    if detectors is None or any(d in detectors for d in _PROJECT):
        held = prepared.filter(F.col(ROUTES).contains("|project|")) if stage else prepared
        findings = findings.unionByName(detect_projects(held, findings))
        unknowns = unknowns.unionByName(conform(project.config_unknowns(held), UNKNOWNS))
    if max_bytes is not None:
        unknowns = unknowns.unionByName(conform(truncations(prepared), UNKNOWNS))
    return findings, unknowns


def detect_corpus(
    spark, root: str, rules: list[dict], *, scan_id: str | None = None, user_globs: tuple[str, ...] = (),
    any_language: bool = False, fan_out: int = 1, **options,
):
    """A folder of files -> (findings, unknowns). Only files that a detector could read by path are opened.

    Files that cannot be read are unknowns. See ``sources.corpus`` for what of a file is read.
    """
    listing = corpus.list_corpus(spark, root, scan_id, user_globs, fan_out)
    if not any_language and not options.get("user_detectors"):
        wanted = reduce(lambda a, b: a | b, [s.accepts(by_content=False) for s in SELECTORS])
        listing = listing.withColumn("language", language_of(F.col("path"))).filter(wanted | project_file())
    # What was read is stored, so that errors and contents come from one pass over the corpus.
    read = stored(corpus.read_listed(listing, root, scan_id=scan_id), "corpus", (), _ROW_GROUP)
    findings, unknowns = detect(read.filter("error IS NULL").drop("error"), rules, any_language=any_language, **options)
    return findings, unknowns.unionByName(conform(corpus.unreadable(read), UNKNOWNS))


class Inventory:
    """Flat inventory tables, each planned when first asked for.

    Presentation documents are projections of these. Tables: scans, components, occurrences,
    claims, licenses, hashes, risks, risk_details, params, edges, edge_evidence, warnings, and
    where given unknowns, vulns, outcomes, control_evidence (None otherwise).
    """

    def __init__(self, **tables):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame | None:
        if name.startswith("_"):
            raise AttributeError(name)
        value = self._tables.get(name)
        if callable(value):
            value = self._tables[name] = value()
        return value

    def replace(self, **tables) -> Inventory:
        return Inventory(**{**self._tables, **tables})


def build(findings: DataFrame, scans: DataFrame, unknowns: DataFrame | None = None, stage: bool = True) -> Inventory:
    """findings -> inventory tables."""
    keyed = assemble.key_findings(findings)
    draft_rows = assemble.drafts(keyed)
    moved = assemble.redirects(draft_rows)
    sighted = assemble.sightings(keyed, moved)
    keep = stored if stage else lambda df, name: df
    sighted = keep(sighted, "sightings")
    shared = Inventory(
        occurrences=lambda: keep(assemble.occurrences(sighted), "occurrences"),
        claims=lambda: keep(assemble.identity_claims(sighted), "claims"),
        names=lambda: graph.name_index(
            assemble.surviving(draft_rows, moved).select("scan_id", "component_id", "cls", "cname").unionByName(
                assemble.root_components(scans).select("scan_id", "component_id", "cls", F.lower("name").alias("cname"))
            ).distinct()
        ),
        resolved=lambda: keep(graph.resolve_claims(
            graph.relation_claims(sighted), shared.names, graph.path_detector_index(sighted)), "relations"),
        evidence=lambda: graph.edge_evidence(shared.resolved),
    )
    return Inventory(
        scans=scans, unknowns=unknowns,
        occurrences=lambda: shared.occurrences, claims=lambda: shared.claims,
        components=lambda: keep(assemble.with_roots(
            assemble.components(sighted, shared.occurrences, shared.claims), scans), "components"),
        licenses=lambda: assemble.licenses(sighted), hashes=lambda: assemble.hashes(sighted),
        risks=lambda: keep(assemble.risks(sighted), "risks"), risk_details=lambda: assemble.risk_details(sighted),
        params=lambda: graph.promoted_params(sighted, shared.names),
        edges=lambda: keep(graph.edges(shared.evidence), "edges"), edge_evidence=lambda: shared.evidence,
        warnings=lambda: graph.unresolved(shared.resolved),
    )


def tagged(inv: Inventory) -> DataFrame:
    return tag_components(inv.components, inv.risks)


def with_controls(inv: Inventory, controls: DataFrame) -> Inventory:
    """Evaluate controls over the inventory as it stands."""
    rows = tagged(inv)
    return inv.replace(
        outcomes=control_outcomes(rows, controls, inv.scans), control_evidence=control_evidence(rows, controls)
    )


def gate(inv: Inventory, expression: str, coverage: DataFrame | None = None) -> DataFrame:
    """Verdict per scan over the unfiltered inventory."""
    return gate_verdicts(parse_gate(expression), tagged(inv), inv.scans, inv.vulns, inv.outcomes, coverage)


def present(inv: Inventory, bound: float, controls: DataFrame | None = None) -> Inventory:
    """Minimum-confidence view; controls are evaluated again over what is left."""
    comps, edges = min_confidence(inv.components, inv.edges, bound)
    keep = comps.select("scan_id", "component_id")
    def semi(name: str):
        return lambda: getattr(inv, name).join(keep, ["scan_id", "component_id"], "left_semi")

    parts = ["occurrences", "claims", "licenses", "hashes", "risks", "risk_details", "params"]
    if inv.vulns is not None:
        parts.append("vulns")
    out = inv.replace(components=comps, edges=edges, **{p: semi(p) for p in parts})
    return with_controls(out, controls) if controls is not None else out


def fill_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Snippets for findings of user detectors that give a line but no text."""
    lines = files.join(
        findings.filter(~is_set(F.col("snippet")) & (F.col("line") > 0)).select("scan_id", "path", "line").distinct(),
        ["scan_id", "path"],
    ).select("scan_id", "path", "line", snippet(F.get(lines_of(text_of(F.col("content"))), F.col("line") - 1)).alias("_s"))
    return findings.join(lines, ["scan_id", "path", "line"], "left").withColumn(
        "snippet", F.coalesce(F.when(is_set(F.col("snippet")), F.col("snippet")), "_s")
    ).drop("_s").select(*findings.columns)
