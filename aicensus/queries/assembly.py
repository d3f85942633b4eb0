"""Queries over assembled inventories: identity, merging, edges, gates, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, controls, gate, graph
from ..plans import pipeline
from ..reports import cyclonedx, documents, inventory, sarif, tables
from ..session import shared_folder, stored
from .derive import findings, scans
from .oracle import assembled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.key_findings(findings(spark, sf))


def _sighted(spark: SparkSession, sf: str) -> DataFrame:
    return stored(assemble.sightings(_keyed(spark, sf)), "sightings")


def _inventory(spark: SparkSession, sf: str) -> pipeline.Inventory:
    """A new inventory for each call: nothing is kept from an earlier query."""
    return pipeline.build(findings(spark, sf), scans(spark, sf))


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(assembled("SELECT DISTINCT scan_id, cls, cprovider, cname, disc, snapshot, draft_id FROM keyed", "keyed"))
def component_ids(spark, sf):
    cols = ["scan_id", "cls", "cprovider", "cname", "disc", "snapshot", "draft_id"]
    return _keyed(spark, sf).select(*cols).distinct()


@query(assembled("SELECT * FROM pkg_moves", "pkg_moves"))
def package_fold(spark, sf):
    return assemble.package_redirects(assemble.drafts(_keyed(spark, sf))).select("scan_id", "draft_id", "component_id")


@query(assembled("SELECT * FROM model_moves", "model_moves"))
def model_fold(spark, sf):
    return assemble.model_redirects(assemble.drafts(_keyed(spark, sf))).select("scan_id", "draft_id", "component_id")


@query(assembled("SELECT scan_id, component_id, count(*) AS n, count(*) FILTER (WHERE folded) AS n_folded FROM s GROUP BY ALL", "s"))
def redirected_sightings(spark, sf):
    return _sighted(spark, sf).groupBy("scan_id", "component_id").agg(
        F.count("*").alias("n"), F.count_if("folded").alias("n_folded"))


@query(assembled("SELECT scan_id, component_id, path, line, col, detector_id, method, snippet, confidence FROM occ", "occ"))
def occurrences(spark, sf):
    return assemble.occurrences(_sighted(spark, sf)).select(
        "scan_id", "component_id", "path", "line", "col", "detector_id", "method", "snippet", "confidence")


@query(assembled("SELECT scan_id, component_id, n_occurrences, round(confidence, 6) AS confidence FROM conf", "conf"))
def confidence_noisy_or(spark, sf):
    return assemble.confidences(assemble.occurrences(_sighted(spark, sf))).select(
        "scan_id", "component_id", "n_occurrences", r6("confidence"))


@query(assembled("SELECT scan_id, component_id, field, value, confidence, method FROM claims", "claims"))
def identity_claims(spark, sf):
    return assemble.identity_claims(_sighted(spark, sf))


@query(assembled("SELECT scan_id, component_id, version FROM ver", "ver"))
def version_resolution(spark, sf):
    return assemble.resolved_versions(assemble.identity_claims(_sighted(spark, sf)))


@query(assembled(
    "SELECT scan_id, component_id, kind, name, provider, disc, grp AS \"group\", url AS download_location, ecosystem, "
    "declared_name FROM comp", "comp"))
def component_scalars(spark, sf):
    return assemble.component_scalars(_sighted(spark, sf)).select(
        "scan_id", "component_id", "kind", "name", "provider", "disc", "group", "download_location", "ecosystem",
        "declared_name")


def _state(c: str) -> str:
    return (f"CASE WHEN {c}_lo IS NULL THEN 'absent' WHEN {c}_lo = {c}_hi THEN 'known' ELSE 'unknown' END AS {c}_state, "
            f"CASE WHEN {c}_lo = {c}_hi THEN {c}_lo END AS {c}_value")


@query(assembled(
    f"SELECT scan_id, component_id, {_state('arch')}, {_state('params')}, {_state('endpoint')} FROM scal", "scal"))
def facet_merge(spark, sf):
    f = assemble.facets(_sighted(spark, sf))
    return f.select("scan_id", "component_id", *[
        x for c, n in (("model_architecture", "arch"), ("model_param_count", "params"), ("infra_endpoint", "endpoint"))
        for x in (F.col(f"{c}.p").alias(f"{n}_state"), F.col(f"{c}.v").alias(f"{n}_value"))])


@query(assembled(
    "SELECT scan_id, component_id, unnest(list_filter([CASE WHEN arch_lo <> arch_hi THEN 'model.architecture' END, "
    "CASE WHEN params_lo <> params_hi THEN 'model.param_count' END, "
    "CASE WHEN endpoint_lo <> endpoint_hi THEN 'infra.endpoint' END], lambda x: x IS NOT NULL)) AS field FROM scal", "scal"))
def facet_conflicts(spark, sf):
    return assemble.facet_conflicts(assemble.facets(_sighted(spark, sf)))


@query(assembled("SELECT DISTINCT scan_id, component_id, 'sha-256' AS alg, lower(sha) AS hex FROM s WHERE sha <> ''", "s"))
def hash_union(spark, sf):
    return assemble.hashes(_sighted(spark, sf))


@query(assembled("SELECT scan_id, component_id, risk_id, severity, path, line FROM risks", "risks"))
def risk_rollup(spark, sf):
    return assemble.risks(_sighted(spark, sf)).select("scan_id", "component_id", "risk_id", "severity", "path", "line")


@query(assembled("SELECT * FROM details", "details"))
def risk_details(spark, sf):
    return assemble.risk_details(_sighted(spark, sf))


@query(assembled("SELECT scan_id, component_id, kind, name FROM roots", "roots"))
def root_components(spark, sf):
    return assemble.root_components(scans(spark, sf)).select("scan_id", "component_id", "kind", "name")


@query(assembled(
    "SELECT scan_id, component_id, kind, name, provider, version, grp AS \"group\", purl, "
    "round(confidence, 6) AS confidence, n_occurrences FROM comps UNION ALL "
    "SELECT scan_id, component_id, kind, name, NULL, NULL, NULL, NULL, 0.0, 0 FROM roots", "comps", "roots"))
def inventory_components(spark, sf):
    return _inventory(spark, sf).components.select(
        "scan_id", "component_id", "kind", "name", "provider", "version", "group", "purl", r6("confidence"), "n_occurrences")


@query(assembled(
    "SELECT scan_id, component_id, unnest(list_filter([CASE WHEN provider <> '' THEN 'asset:model.provider=' || provider END, "
    "'asset:model.id=' || name], lambda x: x IS NOT NULL)) AS property FROM comp WHERE cls = 'hosted-model'", "comp"))
def model_properties(spark, sf):
    rows = assemble.components(_sighted(spark, sf)).select("scan_id", "component_id", F.explode("properties").alias("p"))
    return rows.select("scan_id", "component_id", F.concat_ws("=", "p.name", "p.value").alias("property"))


@query(assembled("SELECT scan_id, cls, cname, candidates, target_id FROM names", "names"))
def name_index(spark, sf):
    keyed = _keyed(spark, sf)
    d = assemble.drafts(keyed)
    left = assemble.surviving(d, assemble.redirects(d)).select("scan_id", "component_id", "cls", "cname")
    roots = assemble.root_components(scans(spark, sf)).select(
        "scan_id", "component_id", "cls", F.lower("name").alias("cname"))
    return graph.name_index(left.unionByName(roots).distinct())


@query(assembled(
    "SELECT scan_id, from_id, type, to_id, path, line, confidence FROM resolved WHERE candidates = 1 AND to_id <> from_id",
    "resolved"))
def edge_evidence(spark, sf):
    return _inventory(spark, sf).edge_evidence.select("scan_id", "from_id", "type", "to_id", "path", "line", "confidence")


@query(assembled("SELECT scan_id, from_id, type, to_id, round(confidence, 6) AS confidence, n_evidence FROM edges", "edges"))
def edges(spark, sf):
    return _inventory(spark, sf).edges.select("scan_id", "from_id", "type", "to_id", r6("confidence"), "n_evidence")


@query(assembled(
    "SELECT scan_id, path, line, from_id AS component_id, from_name, type, CASE "
    "WHEN form = 'from_field' AND wanted IS NULL THEN 'field not captured: model' "
    "WHEN form = 'local_ref' AND candidates = 0 THEN 'same file lacks a finding of rules/a/b' "
    "WHEN candidates = 0 THEN 'target not found: ' || CASE WHEN type = 'uses' THEN 'hosted-llm' ELSE 'vector-db' END || '/' || wanted "
    "ELSE 'several targets fit: ' || candidates END AS reason FROM resolved WHERE candidates <> 1", "resolved"))
def edge_warnings(spark, sf):
    return _inventory(spark, sf).warnings.select("scan_id", "path", "line", "component_id", "from_name", "type", "reason")


@query(assembled("SELECT * FROM params", "params"))
def param_promotion(spark, sf):
    return _inventory(spark, sf).params.select("scan_id", "component_id", "param", "value", "path", "line", "col")


@query(assembled(
    "SELECT from_id, to_id, scan_id FROM edges WHERE type = 'uses' AND from_id = "
    "(SELECT max(from_id) FROM edges WHERE type = 'uses')", "edges"))
def graph_lookup(spark, sf):
    e = _inventory(spark, sf).edges.filter("type = 'uses'")
    return graph.edges_from(e, e.agg(F.max("from_id")).first()[0]).select("from_id", "to_id", "scan_id")


@query(assembled(
    "SELECT 'kind' AS lookup, component_id AS found FROM comps WHERE kind = 'vector-db' UNION ALL "
    "SELECT 'id', component_id FROM comps WHERE component_id = (SELECT max(to_id) FROM edges) UNION ALL "
    "SELECT 'to', from_id FROM edges WHERE to_id = (SELECT max(to_id) FROM edges)", "comps", "edges"))
def graph_lookups(spark, sf):
    inv = _inventory(spark, sf)
    last = inv.edges.agg(F.max("to_id")).first()[0]
    parts = {"kind": graph.by_kind(inv.components, "vector-db").select(F.col("component_id").alias("found")),
             "id": graph.get(inv.components, last).select(F.col("component_id").alias("found")),
             "to": graph.edges_to(inv.edges, last).select(F.col("from_id").alias("found"))}
    rows = [df.select(F.lit(k).alias("lookup"), "found") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ── controls, gates, filters ─────────────────────────────────────────────────

_GRID = (
    "SELECT scan_id, framework, control, CASE WHEN rule = 'manual' THEN 'manual' "
    "WHEN (rule = 'evidence') = (n > 0) THEN 'met' ELSE 'gap' END AS state, n AS n_components FROM ("
    "SELECT s.scan_id, c.framework, c.control, c.rule, count(t.component_id) AS n FROM scans s CROSS JOIN ctl c LEFT JOIN tagged t "
    "ON t.scan_id = s.scan_id AND CASE WHEN c.control = 'MAP-2.1' THEN t.kind IN "
    "('hosted-llm', 'local-model-file', 'embedding-model', 'framework', 'rag-pipeline') "
    "WHEN c.control = 'MAP-4.1' THEN t.kind IN ('framework', 'library', 'hosted-llm', 'embedding-model') "
    "WHEN c.rule = 'gap' THEN len(t.tags) > 0 ELSE false END GROUP BY s.scan_id, c.framework, c.control, c.rule)"
)
_CTL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{fw}', '{ctl}', '{'evidence' if ev else 'gap' if gap else 'manual'}')"
    for fw, ctl, _, ev, gap in controls.CONTROL_ROWS) + ") t(framework, control, rule)"


def with_controls(select: str, *needs: str) -> str:
    sql = assembled("", "tagged", "scans", *needs).rstrip()
    return sql + f",\nctl AS ({_CTL}),\noutcomes AS ({_GRID})\n" + select


def _tagged(inv):
    return controls.tag_components(inv.components, inv.risks)


@query(with_controls("SELECT * FROM outcomes"))
def control_outcomes(spark, sf):
    inv = _inventory(spark, sf)
    return controls.control_outcomes(_tagged(inv), controls.shipped_controls(spark), inv.scans).select(
        "scan_id", "framework", "control", "state", F.col("n_components").cast("bigint").alias("n_components"))


@query(with_controls("SELECT * FROM outcomes").replace(
    "LEFT JOIN tagged t", "LEFT JOIN (SELECT * FROM tagged WHERE confidence >= 0.8) t"))
def present_controls(spark, sf):
    """Controls evaluated again over what a minimum confidence leaves."""
    shown = pipeline.present(_inventory(spark, sf), 0.8, controls.shipped_controls(spark))
    return shown.outcomes.select(
        "scan_id", "framework", "control", "state", F.col("n_components").cast("bigint").alias("n_components"))


@query(with_controls(
    "SELECT scan_id, framework, count(*) AS controls, count(*) FILTER (WHERE state = 'met') AS met, count(*) FILTER (WHERE state = 'gap') AS gap, "
    "count(*) FILTER (WHERE state = 'manual') AS manual FROM outcomes GROUP BY ALL"))
def compliance_summary(spark, sf):
    inv = _inventory(spark, sf)
    return tables.compliance_summary(
        controls.control_outcomes(_tagged(inv), controls.shipped_controls(spark), inv.scans))


@query(with_controls(
    "SELECT scan_id, framework AS standard, control AS requirement, 'claim/' || framework || '/' || control AS claim_ref, "
    "CASE state WHEN 'met' THEN 1.0::DOUBLE WHEN 'gap' THEN 0.0::DOUBLE END AS score, state = 'manual' AS manual FROM outcomes"))
def cdx_declarations(spark, sf):
    inv = _inventory(spark, sf)
    return cyclonedx.declarations(
        controls.control_outcomes(_tagged(inv), controls.shipped_controls(spark), inv.scans)).drop("rationale")


_CELLS = """
, hits AS (SELECT t.scan_id, c.framework, c.control, t.component_id FROM ctl c JOIN tagged t ON
  CASE WHEN c.control = 'MAP-2.1' THEN t.kind IN ('hosted-llm', 'local-model-file', 'embedding-model', 'framework', 'rag-pipeline')
       WHEN c.control = 'MAP-4.1' THEN t.kind IN ('framework', 'library', 'hosted-llm', 'embedding-model')
       WHEN c.rule = 'gap' THEN len(t.tags) > 0 ELSE false END),
spots AS (SELECT scan_id, component_id, min(CASE WHEN line > 0 THEN path || ':' || line ELSE path END) AS spot FROM occ GROUP BY ALL),
few AS (SELECT h.*, c.name, s.spot FROM hits h JOIN comps c USING (scan_id, component_id) LEFT JOIN spots s USING (scan_id, component_id)
  QUALIFY row_number() OVER (PARTITION BY h.scan_id, h.framework, h.control ORDER BY h.component_id) <= 8),
cells AS (SELECT scan_id, framework, control, string_agg(name || ' (' || spot || ')', '; ' ORDER BY component_id) AS items FROM few GROUP BY ALL)
SELECT o.scan_id, o.framework, o.control, o.state, n_components || ' component(s): ' || items ||
  CASE WHEN n_components > 8 THEN '; …(+' || (n_components - 8) || ' more)' ELSE '' END AS evidence
FROM outcomes o JOIN cells USING (scan_id, framework, control)
"""


@query(with_controls("", "comps", "occ").rstrip() + _CELLS)
def compliance_report(spark, sf):
    inv = _inventory(spark, sf)
    ctl = controls.shipped_controls(spark)
    rows = _tagged(inv)
    out = controls.control_outcomes(rows, ctl, inv.scans)
    report = tables.compliance_report(out, controls.control_evidence(rows, ctl), inv.components, inv.occurrences)
    return report.filter("evidence LIKE '%component(s): %'").select("scan_id", "framework", "control", "state", "evidence")


GATE = "embedding-model & confidence>=0.9 | risk:high & library | compliance:nist-ai-rmf:MEASURE-2.7"
_GATE_SQL = (
    "SELECT s.scan_id, coalesce(h.hit, false) OR coalesce(o.gap, false) AS tripped FROM scans s "
    "LEFT JOIN (SELECT scan_id, bool_or(kind = 'embedding-model' AND confidence >= 0.9 OR "
    "list_contains(tags, 'high') AND kind = 'library') AS hit FROM tagged GROUP BY ALL) h USING (scan_id) "
    "LEFT JOIN (SELECT scan_id, bool_or(control = 'MEASURE-2.7' AND state = 'gap') AS gap FROM outcomes GROUP BY ALL) o USING (scan_id)"
)


def _verdicts(spark, sf):
    inv = _inventory(spark, sf)
    rows = _tagged(inv)
    out = controls.control_outcomes(rows, controls.shipped_controls(spark, ["nist-ai-rmf"]), inv.scans)
    return gate.gate_verdicts(gate.parse_gate(GATE), rows, inv.scans, outcomes=out)


@query(with_controls(_GATE_SQL))
def gate_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query(with_controls(
    f"SELECT bool_or(tripped) AS tripped, count(*) FILTER (WHERE tripped) AS scans_tripped, count(*) AS scans FROM ({_GATE_SQL})"))
def fleet_verdict(spark, sf):
    return gate.fleet_verdict(_verdicts(spark, sf))


@query(assembled(
    "SELECT scan_id, component_id, kind FROM comps WHERE confidence >= 0.8 UNION ALL SELECT scan_id, component_id, kind FROM roots",
    "comps", "roots"))
def min_confidence_components(spark, sf):
    inv = _inventory(spark, sf)
    return gate.min_confidence(inv.components, inv.edges, 0.8)[0].select("scan_id", "component_id", "kind")


@query(assembled(
    "SELECT e.scan_id, from_id, type, to_id FROM edges e JOIN comps a ON a.scan_id = e.scan_id AND a.component_id = from_id "
    "AND a.confidence >= 0.8 JOIN comps b ON b.scan_id = e.scan_id AND b.component_id = to_id AND b.confidence >= 0.8",
    "edges", "comps"))
def min_confidence_edges(spark, sf):
    inv = _inventory(spark, sf)
    return gate.min_confidence(inv.components, inv.edges, 0.8)[1].select("scan_id", "from_id", "type", "to_id")


# ── reports ──────────────────────────────────────────────────────────────────


@query(assembled("SELECT scan_id, kind, count(*) AS n_components FROM comps GROUP BY ALL", "comps"))
def summary_by_kind(spark, sf):
    return tables.summary_by_kind(_inventory(spark, sf).components)


@query(assembled(
    "SELECT kind, count(*) AS n_components, count(DISTINCT scan_id) AS n_scans FROM comps GROUP BY kind", "comps"))
def fleet_by_kind(spark, sf):
    return tables.fleet_by_kind(_inventory(spark, sf).components)


_NUM = "CAST(round_even(confidence * 10000, 0) / 10000 AS DOUBLE)"
_TXT = ("regexp_replace(CAST(CAST(round_even(confidence * 10000, 0) / 10000 AS DECIMAL(10, 4)) AS VARCHAR), '\\.?0+$', '')")


@query(assembled(
    f"SELECT scan_id, component_id, kind, CASE WHEN grp IS NOT NULL THEN grp || '/' || name ELSE name END AS name, "
    f"coalesce(version, '-') AS version, CASE WHEN provider <> '' THEN provider ELSE '-' END AS provider, {_TXT} AS confidence, "
    "location, n_occurrences AS evidence FROM comps JOIN (SELECT scan_id, component_id, "
    "arg_min(CASE WHEN line > 0 THEN path || ':' || line ELSE path END, path || chr(1) || lpad(CAST(line AS VARCHAR), 9, '0')) AS location "
    "FROM occ GROUP BY ALL) USING (scan_id, component_id)", "comps", "occ"))
def component_listing(spark, sf):
    inv = _inventory(spark, sf)
    return tables.component_listing(inv.components, inv.occurrences).drop("vuln")


@query(assembled(
    "SELECT scan_id, target, coalesce(c.n, 0) AS components, coalesce(e.n, 0) AS relationships, coalesce(fl.n, 0) AS files "
    "FROM scans LEFT JOIN (SELECT scan_id, count(*) AS n FROM comps GROUP BY ALL) c USING (scan_id) "
    "LEFT JOIN (SELECT scan_id, count(*) AS n FROM edges GROUP BY ALL) e USING (scan_id) "
    "LEFT JOIN (SELECT scan_id, count(DISTINCT path) AS n FROM f GROUP BY ALL) fl USING (scan_id)",
    "scans", "comps", "edges", "f"))
def scan_summary(spark, sf):
    inv = _inventory(spark, sf)
    files = findings(spark, sf).select("scan_id", "path").distinct()
    return tables.scan_summary(inv.scans, inv.components, inv.edges, files)


@query(assembled(
    "SELECT o.scan_id, o.component_id, o.detector_id AS rule_id, sha256(o.detector_id || '|' || o.component_id || '|' || o.path) AS fingerprint, "
    "o.path AS uri, CASE WHEN line > 0 THEN line END AS start_line, CASE WHEN line > 0 AND col > 0 THEN col END AS start_column, "
    "c.kind || ' ''' || CASE WHEN grp IS NOT NULL THEN grp || '/' || name ELSE name END || '''' || "
    "CASE WHEN version IS NOT NULL THEN ' [' || version || ']' ELSE '' END || ' detected (confidence ' || "
    f"{_TXT.replace('confidence', 'c.confidence')} || ')' AS message FROM occ o JOIN "
    "(SELECT scan_id, component_id, kind, grp, name, version, confidence FROM comps) c "
    "ON c.scan_id = o.scan_id AND c.component_id = o.component_id".replace("name ELSE name", "c.name ELSE c.name")
    .replace("grp || '/'", "c.grp || '/'").replace("WHEN grp", "WHEN c.grp").replace("WHEN version", "WHEN c.version")
    .replace("[' || version", "[' || c.version"), "occ", "comps"))
def sarif_results(spark, sf):
    inv = _inventory(spark, sf)
    return sarif.results(inv.components, inv.occurrences).select(
        "scan_id", "component_id", "rule_id", "fingerprint", "uri", "start_line", "start_column", "message")


@query(assembled(
    "SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY block, rule_id) - 1 AS rule_index FROM ("
    "SELECT DISTINCT scan_id, 0 AS block, detector_id AS rule_id FROM occ UNION ALL "
    "SELECT DISTINCT scan_id, 1, 'risk/' || slug FROM risks)", "occ", "risks"))
def sarif_rules(spark, sf):
    inv = _inventory(spark, sf)
    return sarif.rules(inv.occurrences, inv.risks).select(
        "scan_id", "rule_id", F.col("rule_index").cast("bigint").alias("rule_index"))


_LVL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


@query(assembled(
    f"SELECT r.scan_id, r.component_id, 'risk/' || slug AS rule_id, {_LVL} AS level, r.path AS uri, "
    "CASE WHEN r.line > 0 THEN r.line END AS start_line, d.symbols FROM risks r LEFT JOIN (SELECT scan_id, component_id, risk_id, "
    "string_agg(detail, '|' ORDER BY detail) AS symbols FROM details GROUP BY ALL) d USING (scan_id, component_id, risk_id)",
    "risks", "details"))
def sarif_risk_results(spark, sf):
    inv = _inventory(spark, sf)
    return sarif.risk_results(inv.components, inv.risks, inv.risk_details).select(
        "scan_id", "component_id", "rule_id", "level", "uri", "start_line", "symbols")


_TYPE = ("CASE WHEN kind IN ('hosted-llm', 'local-model-file', 'embedding-model') THEN 'machine-learning-model' "
         "WHEN kind IN ('framework', 'library') THEN kind WHEN kind IN ('prompt', 'dataset', 'ai-config') THEN 'data' ELSE 'application' END")


@query(assembled(
    f"SELECT scan_id, component_id AS bom_ref, {_TYPE} AS type, name, grp AS \"group\", version, purl, "
    "CASE WHEN kind = 'dataset' THEN 'dataset' END AS data_type, url AS distribution_url FROM comps UNION ALL "
    "SELECT scan_id, component_id, 'application', name, NULL, NULL, NULL, NULL, NULL FROM roots", "comps", "roots"))
def cdx_components(spark, sf):
    return cyclonedx.components(_inventory(spark, sf).components).drop("data_url")


_MODEL = "kind IN ('hosted-llm', 'local-model-file', 'embedding-model')"


_PROPERTIES = (
    "SELECT scan_id, component_id AS bom_ref, 'asset:' || n AS name, v AS value FROM ("
    "SELECT scan_id, component_id, 'kind' AS n, kind AS v FROM comps UNION ALL SELECT scan_id, component_id, 'kind', kind FROM roots "
    f"UNION ALL SELECT scan_id, component_id, 'confidence', {_TXT} FROM comps UNION ALL SELECT scan_id, component_id, 'confidence', '0' FROM roots "
    f"UNION ALL SELECT scan_id, component_id, CASE WHEN {_MODEL} THEN 'model.provider' ELSE 'provider' END, provider FROM comps WHERE provider <> '' "
    "UNION ALL SELECT scan_id, component_id, 'model.paramCount', CAST(params_lo AS VARCHAR) FROM comps WHERE params_lo = params_hi "
    "UNION ALL SELECT scan_id, component_id, 'service.endpoint', endpoint_lo FROM comps WHERE endpoint_lo = endpoint_hi "
    "UNION ALL SELECT scan_id, component_id, 'model.provider', provider FROM comps WHERE cls = 'hosted-model' AND provider <> '' "
    "UNION ALL SELECT scan_id, component_id, 'model.id', name FROM comps WHERE cls = 'hosted-model' "
    "UNION ALL SELECT scan_id, component_id, 'param.' || param, value || ' @ ' || path || ':' || line FROM params "
    f"UNION ALL SELECT scan_id, from_id, 'rel.' || type, to_id || '@' || {_TXT} FROM edges WHERE type NOT IN ('depends-on', 'trained-on') "
    "UNION ALL SELECT scan_id, component_id, 'pickle.risk', severity FROM risks WHERE risk_id = 'RISK-PICKLE-IMPORT' "
    "UNION ALL SELECT scan_id, component_id, 'pickle.imports', string_agg(detail, '|' ORDER BY detail) FROM details "
    "WHERE risk_id = 'RISK-PICKLE-IMPORT' GROUP BY ALL)")


@query(assembled(_PROPERTIES, "comps", "roots", "params", "edges", "risks", "details"))
def cdx_properties(spark, sf):
    inv = _inventory(spark, sf)
    return cyclonedx.properties(inv.components, inv.edges, inv.params, inv.risks, inv.risk_details)


@query(assembled(
    "SELECT scan_id, component_id AS bom_ref, CASE WHEN arch_lo = arch_hi THEN arch_lo END AS architecture FROM comps "
    f"WHERE {_MODEL} AND arch_lo = arch_hi", "comps"))
def cdx_model_cards(spark, sf):
    inv = _inventory(spark, sf)
    return cyclonedx.model_cards(inv.components, inv.edges).select("scan_id", "bom_ref", "architecture")


@query(assembled("SELECT DISTINCT scan_id, from_id AS ref, to_id AS depends_on FROM edges WHERE type = 'depends-on'", "edges"))
def cdx_dependencies(spark, sf):
    return cyclonedx.dependencies(_inventory(spark, sf).edges)


@query(assembled(
    "SELECT r.scan_id, r.component_id AS affects, r.risk_id AS id, severity, CASE WHEN line > 0 THEN path || ':' || line ELSE path END AS evidence, "
    "symbols FROM risks r LEFT JOIN (SELECT scan_id, component_id, risk_id, string_agg(detail, '|' ORDER BY detail) AS symbols "
    "FROM details GROUP BY ALL) USING (scan_id, component_id, risk_id)", "risks", "details"))
def cdx_vulnerabilities(spark, sf):
    inv = _inventory(spark, sf)
    return cyclonedx.vulnerabilities(inv.risks, inv.risk_details).select(
        "scan_id", "affects", "id", "severity", "evidence", "symbols")


@query(assembled(
    f"SELECT scan_id, component_id AS bom_ref, field, value AS concluded_value, {_NUM} AS confidence, "
    "CASE WHEN method = 'config-analysis' THEN 'other' ELSE method END AS technique FROM claims", "claims"))
def cdx_identity_evidence(spark, sf):
    return cyclonedx.evidence_identity(assemble.identity_claims(_sighted(spark, sf))).drop("method_value")


@query(assembled(
    f"SELECT DISTINCT confidence, {_TXT} AS shown, {_NUM} AS number FROM conf", "conf").replace(
        "SELECT DISTINCT confidence,", "SELECT DISTINCT round(confidence, 9) AS confidence,"))
def confidence_format(spark, sf):
    from ..functions.text import confidence_number, confidence_text
    c = assemble.confidences(assemble.occurrences(_sighted(spark, sf)))
    return c.select(F.round("confidence", 9).alias("confidence"), confidence_text(F.col("confidence")).alias("shown"),
                    confidence_number(F.col("confidence")).alias("number")).distinct()


@query(assembled(
    "SELECT record_type, count(*) AS records FROM (SELECT 'component' AS record_type FROM comps UNION ALL SELECT 'component' FROM roots "
    "UNION ALL SELECT 'occurrence' FROM occ UNION ALL SELECT 'edge' FROM edges UNION ALL SELECT 'claim' FROM claims "
    "UNION ALL SELECT 'risk' FROM risks UNION ALL SELECT 'param' FROM params UNION ALL SELECT 'scan' FROM scans "
    "UNION ALL SELECT 'risk_detail' FROM details UNION ALL SELECT 'warning' FROM resolved WHERE candidates <> 1 "
    "UNION ALL SELECT 'edge_evidence' FROM resolved WHERE candidates = 1 AND to_id <> from_id "
    "UNION ALL SELECT DISTINCT ON (scan_id, component_id, lower(sha)) 'hash' FROM s WHERE sha <> '') GROUP BY ALL",
    "comps", "roots", "occ", "edges", "claims", "risks", "params", "scans", "s", "details", "resolved"))
def json_records(spark, sf):
    return inventory.json_records(_inventory(spark, sf)).groupBy("record_type").agg(F.count("*").alias("records"))


@query(assembled(
    f"SELECT scan_id, 'edge' AS record_type, '{{\"from_id\":\"' || from_id || '\",\"type\":\"' || type || '\",\"to_id\":\"' || to_id || "
    f"'\",\"confidence\":' || {_NUM} || ',\"n_evidence\":' || n_evidence || '}}' AS record FROM edges UNION ALL "
    "SELECT scan_id, 'risk_detail', '{\"component_id\":\"' || component_id || '\",\"risk_id\":\"' || risk_id || '\",\"detail\":\"' || detail || '\"}' "
    "FROM details UNION ALL SELECT scan_id, 'scan', '{\"kind\":\"dir\",\"target\":\"/srv/Repos/' || upper(scan_id) || '/\"}' FROM scans",
    "edges", "details", "scans"))
def json_documents(spark, sf):
    """Text of the JSON records of three tables."""
    return inventory.json_records(_inventory(spark, sf)).filter("record_type IN ('edge', 'risk_detail', 'scan')").select(
        "scan_id", "record_type", "record")


@query(assembled(
    "SELECT 'tables' AS output, kind AS entry, count(*) AS n FROM comps GROUP BY ALL UNION ALL SELECT 'tables', 'application', count(*) FROM roots "
    "UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY ALL", "comps", "roots", "edges"))
def multi_output(spark, sf):
    """Two outputs written from one stored inventory, and read back."""
    inv, folder = _inventory(spark, sf), shared_folder(spark, "outputs")
    inventory.write_all({"tables": (inv.components, f"{folder}/tables"), "json": (inv.edges, f"{folder}/edges")})
    kept = spark.read.parquet(f"{folder}/tables").groupBy(F.lit("tables").alias("output"), F.col("kind").alias("entry")).agg(F.count("*").alias("n"))
    edges = spark.read.schema("type string").json(f"{folder}/edges").groupBy(F.lit("edges").alias("output"), F.col("type").alias("entry")).agg(
        F.count("*").alias("n"))
    return kept.unionByName(edges)


def _blocks(spark, leaves) -> DataFrame:
    return documents.text_blocks(documents.fragments(leaves), 10_000)


# The documents of ``doc`` (scan_id, t) in blocks of 10,000 characters.
_CUT = "SELECT scan_id, block, substr(t, CAST(block * 10000 + 1 AS INTEGER), 10000) AS text FROM (SELECT *, unnest(range(0, (length(t) + 9999) // 10000)) AS block FROM doc)"


def _section(name: str, rows: str, owner: str, record: str) -> str:
    return f"SELECT scan_id, '\"{name}\":[' || string_agg({record}, ',' ORDER BY {owner}, {record}) || ']' AS t FROM {rows} GROUP BY scan_id"


@query(assembled("", "edges", "details", "scans").rstrip() + ", a AS (" + _section(
    "scans", "scans", "scan_id", "'{\"kind\":\"dir\",\"target\":\"' || target || '\"}'") + "), b AS (" + _section(
    "edges", "edges", "from_id", f"'{{\"from_id\":\"' || from_id || '\",\"type\":\"' || type || '\",\"to_id\":\"' || to_id || '\",\"confidence\":' || {_NUM} "
    "|| ',\"n_evidence\":' || n_evidence || '}'") + "), c AS (" + _section(
    "risk_details", "details", "component_id", "'{\"component_id\":\"' || component_id || '\",\"risk_id\":\"' || risk_id || '\",\"detail\":\"' || detail || '\"}'")
    + "), doc AS (SELECT scan_id, '{\"scan_id\":\"' || scan_id || '\",' || concat_ws(',', a.t, b.t, c.t) || '}' AS t "
    "FROM a LEFT JOIN b USING (scan_id) LEFT JOIN c USING (scan_id)) " + _CUT)
def native_documents(spark, sf):
    """Whole JSON documents of three tables, one per scan."""
    return _blocks(spark, documents.native_leaves(_inventory(spark, sf), ["scans", "edges", "risk_details"]))


_CDX = f"""
, obj AS (SELECT scan_id, component_id AS ref, '{{"bom-ref":"' || component_id || '","type":"' || {_TYPE} || '","name":"' || name || '"'
  || coalesce(',"group":"' || nullif(grp, '') || '"', '') || coalesce(',"version":"' || nullif(version, '') || '"', '')
  || coalesce(',"purl":"' || nullif(purl, '') || '"', '')
  || coalesce(',"externalReferences":[{{"type":"distribution","url":"' || nullif(url, '') || '"}}]', '')
  || CASE WHEN kind = 'dataset' THEN ',"data":[{{"type":"dataset","name":"' || name || '"}}]' ELSE '' END AS head FROM comps
  UNION ALL SELECT scan_id, component_id, '{{"bom-ref":"' || component_id || '","type":"application","name":"' || name || '"' FROM roots),
h AS (SELECT scan_id, ref, ',"hashes":[' || string_agg('{{"alg":"SHA-256","content":"' || hex || '"}}', ',' ORDER BY hex) || ']' AS t
  FROM (SELECT DISTINCT scan_id, component_id AS ref, lower(sha) AS hex FROM s WHERE sha <> '') GROUP BY ALL),
o AS (SELECT scan_id, component_id AS ref, '"occurrences":[' || string_agg('{{"location":"' || path || '"' || CASE WHEN line > 0 THEN ',"line":' || line ELSE '' END
  || ',"additionalContext":"' || snippet || '"}}', ',' ORDER BY path, line, snippet) || ']' AS t FROM occ GROUP BY ALL),
i0 AS (SELECT scan_id, component_id AS ref, '{{"field":"' || field || '","concludedValue":"' || value || '","confidence":' || {_NUM} || ',"methods":[{{"technique":"'
  || CASE WHEN method = 'config-analysis' THEN 'other' ELSE method END || '","confidence":' || {_NUM}
  || CASE WHEN method = 'config-analysis' THEN ',"value":"' || method || '"' ELSE '' END || '}}]}}' AS t FROM claims),
i AS (SELECT scan_id, ref, '"identity":[' || string_agg(t, ',' ORDER BY t) || ']' AS t FROM i0 GROUP BY ALL),
props AS ({_PROPERTIES}),
p AS (SELECT scan_id, bom_ref AS ref, ',"properties":[' || string_agg('{{"name":"' || name || '","value":"' || value || '"}}', ',' ORDER BY name, value) || ']' AS t
  FROM props WHERE value IS NOT NULL GROUP BY ALL),
whole AS (SELECT obj.scan_id, ref, head || coalesce(h.t, '') || CASE WHEN o.t IS NOT NULL OR i.t IS NOT NULL THEN ',"evidence":{{' || concat_ws(',', o.t, i.t) || '}}' ELSE '' END
  || coalesce(p.t, '') || '}}' AS t FROM obj LEFT JOIN h USING (scan_id, ref) LEFT JOIN o USING (scan_id, ref) LEFT JOIN i USING (scan_id, ref) LEFT JOIN p USING (scan_id, ref)),
list AS (SELECT scan_id, ',"components":[' || string_agg(t, ',' ORDER BY ref) || ']' AS t FROM whole GROUP BY ALL),
d0 AS (SELECT scan_id, from_id, '{{"ref":"' || from_id || '","dependsOn":[' || string_agg('"' || to_id || '"', ',' ORDER BY to_id) || ']}}' AS t
  FROM (SELECT DISTINCT scan_id, from_id, to_id FROM edges WHERE type = 'depends-on') GROUP BY scan_id, from_id),
d AS (SELECT scan_id, ',"dependencies":[' || string_agg(t, ',' ORDER BY from_id) || ']' AS t FROM d0 GROUP BY ALL),
doc AS (SELECT scan_id, '{{"bomFormat":"CycloneDX","specVersion":"1.6","scan_id":"' || scan_id || '","metadata":{{"component":{{"type":"application","name":"' || target
  || '"}}}}' || coalesce(list.t, '') || coalesce(d.t, '') || '}}' AS t FROM scans LEFT JOIN list USING (scan_id) LEFT JOIN d USING (scan_id))
"""


@query(assembled("", "comps", "roots", "s", "occ", "claims", "params", "edges", "risks", "details", "scans").rstrip() + _CDX + _CUT)
def cdx_documents(spark, sf):
    """Whole CycloneDX documents, one per scan: components with hashes, evidence and properties, and dependencies."""
    return _blocks(spark, documents.cyclonedx_leaves(_inventory(spark, sf), ["metadata", "components", "dependencies"]))
