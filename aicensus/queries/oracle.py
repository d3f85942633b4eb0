"""DuckDB SQL for the assembly queries, built as one chain of common table expressions."""

from __future__ import annotations

from ..functions.identity import (
    ID_PREFIX, KIND_CLASS, KIND_PRECEDENCE, NAME_ALIASES, PROVIDER_ALIASES,
)
from ..operators.risks import RISK_CATALOG
from .derive import FLAT_SQL


def case(expr: str, table: dict, otherwise: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def id_sql(cls: str, provider: str, name: str, disc: str) -> str:
    parts = " || chr(0) || ".join([cls, provider, name, disc])
    return f"'{ID_PREFIX}' || substr(sha256({parts}), 1, 16)"


DATE = r"^(.+)-([0-9]{4}-[0-9]{2}-[0-9]{2})$"


def norm_name(cls: str, name: str, eco: str) -> str:
    raw = f"trim({name})"
    low = f"lower({raw})"
    pkg = f"CASE WHEN {eco} = 'pypi' THEN regexp_replace({low}, '[-_.]+', '-', 'g') ELSE {low} END"
    return (
        f"CASE WHEN {cls} = 'hosted-model' THEN CASE WHEN regexp_matches({low}, '{DATE}') "
        f"THEN regexp_extract({low}, '{DATE}', 1) ELSE {low} END "
        f"WHEN {cls} IN ('package', 'vecdb') THEN {case(f'({pkg})', NAME_ALIASES, f'({pkg})')} "
        f"WHEN {cls} IN ('weights-file', 'prompt', 'dataset') THEN trim({raw}, '/') ELSE {low} END"
    )


_CLS = case("kind", KIND_CLASS, "kind")
_PROV = case("lower(trim(provider))", PROVIDER_ALIASES, "lower(trim(provider))")

CTES: dict[str, str] = {
    "f": FLAT_SQL,
    "k0": f"SELECT *, {_CLS} AS cls, {_PROV} AS cprovider FROM f",
    "k1": f"SELECT *, {norm_name('cls', 'name', 'ecosystem')} AS cname, "
          f"CASE WHEN cls = 'hosted-model' THEN regexp_extract(lower(trim(name)), '{DATE}', 2) ELSE '' END AS snapshot "
          "FROM k0",
    "k2": "SELECT *, CASE WHEN cls = 'weights-file' THEN CASE WHEN sha <> '' THEN 'sha256:' || lower(sha) "
          "ELSE 'path:' || cname END WHEN cls = 'package' THEN ecosystem ELSE '' END AS disc FROM k1",
    "keyed": f"SELECT *, {id_sql('cls', 'cprovider', 'cname', 'disc')} AS draft_id FROM k2",
    "drafts": "SELECT DISTINCT scan_id, draft_id, cls, cprovider, cname, disc FROM keyed",
    "pkg_moves": "SELECT s.scan_id, s.draft_id, t.draft_id AS component_id FROM drafts s JOIN drafts t "
                 "ON s.scan_id = t.scan_id AND s.cls = 'package' AND t.cls = 'package' AND s.cprovider = t.cprovider "
                 "AND s.cname = t.cname AND s.disc = '' AND t.disc <> '' "
                 "QUALIFY count(*) OVER (PARTITION BY s.scan_id, s.draft_id) = 1",
    "model_moves": "SELECT s.scan_id, s.draft_id, t.draft_id AS component_id FROM drafts s JOIN drafts t "
                   "ON s.scan_id = t.scan_id AND s.cls = 'hosted-model' AND t.cls = 'hosted-model' "
                   "AND s.cname = t.cname AND s.cprovider = '' AND t.cprovider <> '' "
                   "QUALIFY count(*) OVER (PARTITION BY s.scan_id, s.draft_id) = 1",
    "moves": "SELECT * FROM pkg_moves UNION ALL SELECT * FROM model_moves",
    "s": "SELECT keyed.*, coalesce(m.component_id, keyed.draft_id) AS component_id, m.component_id IS NOT NULL AS folded "
         "FROM keyed LEFT JOIN moves m USING (scan_id, draft_id)",
    "ranked": "SELECT *, lag(detector_id) OVER w AS prev_det, lag(path) OVER w AS prev_path, lag(line) OVER w AS prev_line "
              "FROM s WINDOW w AS (PARTITION BY scan_id, component_id "
              "ORDER BY path, line, col, detector_id, method, snippet, finding_seq)",
    "occ": "SELECT * FROM ranked WHERE prev_det IS NULL OR prev_det <> detector_id OR prev_path <> path OR prev_line <> line",
    "g": "SELECT scan_id, component_id, method, detector_id, max(confidence) + (1 - max(confidence)) * "
         "least(0.05 * (count(*) - 1), 0.15) AS g, count(*) AS n FROM occ GROUP BY ALL",
    "gm": "SELECT scan_id, component_id, method, max(g) AS m, sum(n) AS n FROM g GROUP BY ALL",
    "conf": "SELECT scan_id, component_id, CAST(sum(n) AS BIGINT) AS n_occurrences, "
            "CASE WHEN bool_or(method IN ('hash-comparison', 'attestation')) THEN 1 - product(1 - m) "
            "ELSE least(1 - product(1 - m), 0.99) END AS confidence FROM gm GROUP BY scan_id, component_id",
    "claims0": "SELECT scan_id, component_id, 'version' AS field, trim(version) AS value, confidence, method, folded, path, finding_seq FROM s "
               "UNION ALL SELECT scan_id, component_id, 'version', snapshot, confidence, method, folded, path, finding_seq FROM s "
               "UNION ALL SELECT scan_id, component_id, 'name', CASE WHEN trim(name) <> cname THEN trim(name) ELSE '' END, "
               "confidence, method, folded, path, finding_seq FROM s",
    "claims": "SELECT scan_id, component_id, field, value, confidence, method FROM claims0 WHERE value <> '' "
              "QUALIFY row_number() OVER (PARTITION BY scan_id, component_id, field, value "
              "ORDER BY confidence DESC, folded, path, finding_seq) = 1",
    "ver": "SELECT scan_id, component_id, value AS version FROM claims WHERE field = 'version' "
           "QUALIFY row_number() OVER (PARTITION BY scan_id, component_id ORDER BY confidence DESC, value) = 1",
    "scal": "SELECT scan_id, component_id, max(cls) AS cls, max(cname) AS name, "
            "max(cprovider) FILTER (WHERE NOT folded) AS provider, max(disc) FILTER (WHERE NOT folded) AS disc, "
            f"max({case('kind', KIND_PRECEDENCE, '0')}) AS prec, "
            + ", ".join(
                f"arg_min({c}, (CASE WHEN folded THEN '1' ELSE '0' END) || path || chr(1) || lpad(CAST(finding_seq AS VARCHAR), 12, '0')) "
                f"FILTER (WHERE {c} <> '') AS {c}" for c in ("grp", "url", "ecosystem"))
            + ", min(trim(name)) FILTER (WHERE ecosystem <> '' AND trim(name) <> '') AS declared_name, "
            + ", ".join(
                f"min({c}) FILTER (WHERE NOT folded AND {ok}) AS {c}_lo, max({c}) FILTER (WHERE NOT folded AND {ok}) AS {c}_hi"
                for c, ok in (("arch", "arch <> ''"), ("params", "params <> 0"), ("endpoint", "endpoint <> ''")))
            + " FROM s GROUP BY scan_id, component_id",
}
CTES["comp"] = (
    "SELECT scan_id, component_id, scal.cls, CASE "
    "WHEN scal.cls = 'hosted-model' THEN CASE prec WHEN 3 THEN 'embedding-model' ELSE 'hosted-llm' END "
    "WHEN scal.cls = 'package' THEN CASE prec WHEN 2 THEN 'framework' ELSE 'library' END "
    "WHEN scal.cls = 'infra' THEN CASE prec WHEN 2 THEN 'service' ELSE 'infra' END "
    "WHEN scal.cls = 'weights-file' THEN 'local-model-file' WHEN scal.cls = 'vecdb' THEN 'vector-db' "
    "WHEN scal.cls = 'rag' THEN 'rag-pipeline' ELSE scal.cls END AS kind, "
    "name, provider, disc, grp, url, ecosystem, declared_name, arch_lo, arch_hi, params_lo, params_hi, "
    "endpoint_lo, endpoint_hi, ver.version, conf.confidence, conf.n_occurrences "
    "FROM scal JOIN conf USING (scan_id, component_id) LEFT JOIN ver USING (scan_id, component_id)"
)


def enc(x: str) -> str:
    e = f"url_encode({x})"
    for have, want in [("%24", "$"), ("%26", "&"), ("%3D", "="), ("%3A", ":"), ("%2F", "/"), ("%7E", "~")]:
        e = f"replace({e}, '{have}', '{want}')"
    return e


_low_ns = "CASE WHEN ecosystem IN ('npm', 'golang') THEN lower(grp) ELSE grp END"
_low_nm = ("CASE WHEN ecosystem = 'pypi' THEN regexp_replace(lower(coalesce(declared_name, name)), '[-_.]+', '-', 'g') "
           "WHEN ecosystem IN ('npm', 'golang') THEN lower(coalesce(declared_name, name)) ELSE coalesce(declared_name, name) END")
CTES["comps"] = (
    "SELECT *, CASE WHEN cls = 'weights-file' AND disc LIKE 'sha256:%' THEN "
    f"'pkg:generic/' || {enc('name')} || '?checksum=sha256:' || substr(disc, 8) "
    "WHEN cls = 'package' AND version IS NOT NULL AND ecosystem IS NOT NULL THEN "
    f"'pkg:' || ecosystem || '/' || CASE WHEN grp IS NOT NULL THEN {enc(_low_ns)} || '/' ELSE '' END || {enc(_low_nm)} "
    f"|| '@' || {enc('version')} END AS purl FROM comp"
)
CTES["scans"] = "SELECT DISTINCT scan_id, '/srv/Repos/' || upper(scan_id) || '/' AS target FROM f"
CTES["roots"] = (
    f"SELECT scan_id, {id_sql(chr(39) + 'app' + chr(39), chr(39) * 2, 'scan_id', chr(39) * 2)} AS component_id, "
    "'application' AS kind, upper(scan_id) AS name FROM scans"
)
CTES["survivors"] = (
    "SELECT scan_id, draft_id AS component_id, cls, cname FROM drafts WHERE NOT EXISTS "
    "(SELECT 1 FROM moves m WHERE m.scan_id = drafts.scan_id AND m.draft_id = drafts.draft_id) "
    "UNION SELECT scan_id, component_id, 'app', lower(name) FROM roots"
)
CTES["names"] = (
    "SELECT scan_id, cls, cname, count(*) AS candidates, min(component_id) AS target_id FROM survivors GROUP BY ALL"
)
CTES["local"] = (
    "SELECT scan_id, path, detector_id, count(DISTINCT component_id) AS candidates, min(component_id) AS target_id "
    "FROM s GROUP BY ALL"
)
CTES["rel"] = (
    "SELECT s.scan_id, component_id AS from_id, name AS from_name, path, line, confidence, 'uses' AS type, 'from_field' AS form, "
    f"nullif(f_model, '') AS wanted, 'hosted-model' AS tcls FROM s WHERE rel_uses "
    "UNION ALL SELECT s.scan_id, component_id, name, path, line, confidence, 'depends-on', 'name', 'chroma', 'vecdb' FROM s WHERE rel_name "
    "UNION ALL SELECT s.scan_id, component_id, name, path, line, confidence, 'contains', 'local_ref', NULL, NULL FROM s WHERE rel_ref"
)
CTES["resolved"] = (
    "SELECT r.*, coalesce(CASE WHEN form = 'local_ref' THEN l.candidates ELSE n.candidates END, 0) AS candidates, "
    "CASE WHEN form = 'local_ref' THEN l.target_id ELSE n.target_id END AS to_id FROM rel r "
    "LEFT JOIN names n ON r.form <> 'local_ref' AND n.scan_id = r.scan_id AND n.cls = r.tcls AND n.cname = r.wanted "
    "LEFT JOIN local l ON r.form = 'local_ref' AND l.scan_id = r.scan_id AND l.path = r.path AND l.detector_id = 'rules/a/b'"
)
CTES["edges"] = (
    "SELECT scan_id, from_id, type, to_id, least(1 - product(1 - confidence), 0.99) AS confidence, count(*) AS n_evidence "
    "FROM resolved WHERE candidates = 1 AND to_id <> from_id GROUP BY ALL"
)
CTES["params"] = (
    "SELECT DISTINCT s.scan_id, n.target_id AS component_id, 'temperature' AS param, f_temp AS value, path, line, col FROM s "
    "JOIN names n ON n.scan_id = s.scan_id AND n.cls = 'hosted-model' AND n.cname = s.f_model AND n.candidates = 1 "
    "WHERE f_model <> '' AND f_temp <> ''"
)
_sev = case("risk", {r[0]: r[1] for r in RISK_CATALOG}, "'low'")
_slug = case("risk", {r[0]: r[2] for r in RISK_CATALOG}, "'unknown-odd-risk-7'")
CTES["risks"] = (
    f"SELECT scan_id, component_id, risk AS risk_id, {_sev} AS severity, {_slug} AS slug, path, line FROM s WHERE risk <> '' "
    "QUALIFY row_number() OVER (PARTITION BY scan_id, component_id, risk ORDER BY path, line, col, detector_id, method, snippet) = 1"
)
CTES["details"] = "SELECT DISTINCT scan_id, component_id, risk AS risk_id, detail FROM s WHERE risk <> ''"
CTES["tagged"] = (
    "SELECT c.*, coalesce(t.tags, []) AS tags FROM comps c LEFT JOIN (SELECT scan_id, component_id, "
    "list(severity) || list(slug) AS tags FROM risks GROUP BY ALL) t USING (scan_id, component_id)"
)

_DEPS = {
    "f": [], "k0": ["f"], "k1": ["k0"], "k2": ["k1"], "keyed": ["k2"], "drafts": ["keyed"], "pkg_moves": ["drafts"],
    "model_moves": ["drafts"], "moves": ["pkg_moves", "model_moves"], "s": ["keyed", "moves"], "ranked": ["s"],
    "occ": ["ranked"], "g": ["occ"], "gm": ["g"], "conf": ["gm"], "claims0": ["s"], "claims": ["claims0"],
    "ver": ["claims"], "scal": ["s"], "comp": ["scal", "conf", "ver"], "comps": ["comp"], "scans": ["f"],
    "roots": ["scans"], "survivors": ["drafts", "moves", "roots"], "names": ["survivors"], "local": ["s"],
    "rel": ["s"], "resolved": ["rel", "names", "local"], "edges": ["resolved"], "params": ["s", "names"],
    "risks": ["s"], "details": ["s"], "tagged": ["comps", "risks"],
}


def add_cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = sql
    _DEPS[name] = needs


def assembled(select: str, *needs: str) -> str:
    """A SELECT over the chain's tables, with only the expressions it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in _DEPS[name]:
                visit(d)
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + select
