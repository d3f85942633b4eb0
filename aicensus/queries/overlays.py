"""Queries on vulnerabilities, versions, licenses, package URLs and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions import versions as ver
from ..operators import assemble, gate, vulns
from ..operators.order import numbered
from ..reports import cyclonedx, sarif, tables
from ..schemas import FINDINGS, conform
from ..session import stored
from .derive import duck_sql, pick, spark_sql, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = duck_sql(sql)
        return fn
    return add


# ── versions and scores ──────────────────────────────────────────────────────

_VERSION = ("concat(" + pick("l_orderkey", ["", "v", " "]) + ", CAST(l_partkey % 3 AS VARCHAR(10)), "
            + pick("l_suppkey", ["", ".0", ".1", ".10.2", ".0.0"]) + ", " + pick("l_linenumber", ["", "-rc1", ".", "+b"]) + ")")
_RELEASE = "concat(CAST(l_partkey % 3 AS VARCHAR(10)), " + pick("l_suppkey", ["", "", ".1", ".10.2", ""]) + ")"


@query(f"SELECT DISTINCT {_VERSION} AS version, {_RELEASE} AS sort_key FROM lineitem")
def version_keys(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{spark_sql(_VERSION)} AS version").distinct()
    return rows.withColumn("sort_key", F.array_join(ver.version_key(F.col("version")).cast("array<string>"), "."))


_VECTOR = ("concat(" + pick("l_orderkey", ["CVSS:3.1", "CVSS:3.0", "CVSS:3.1", "CVSS:2.0"]) + ", '/AV:', "
           + pick("l_partkey", list("NALP")) + ", '/AC:', " + pick("l_suppkey", list("LH")) + ", '/PR:', "
           + pick("IDIV(l_partkey, 4)", list("NLH")) + ", '/UI:', " + pick("IDIV(l_suppkey, 2)", list("NR")) + ", '/S:', "
           + pick("l_linenumber", list("UC")) + ", '/C:', " + pick("IDIV(l_orderkey, 4)", list("HLN")) + ", '/I:', "
           + pick("IDIV(l_orderkey, 12)", list("HLN")) + ", CASE WHEN l_partkey % 17 = 0 THEN '' ELSE concat('/A:', "
           + pick("IDIV(l_orderkey, 36)", list("HLN")) + ") END)")


def _weight(metric: str, weights: dict[str, float]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items())
    return f"CASE regexp_extract(vector, '/{metric}:([A-Z])', 1) {arms} END"


_SCORE_SQL = (
    f"WITH v AS (SELECT DISTINCT {_VECTOR} AS vector FROM lineitem), w AS (SELECT vector, contains(vector, '/S:C') AS ch, "
    + ", ".join(f"{_weight(m, ver._CIA)} AS {m.lower()}_" for m in "CIA") + ", "
    + f"{_weight('AV', ver._AV)} AS av, {_weight('AC', ver._AC)} AS ac, {_weight('UI', ver._UI)} AS ui, "
    + f"CASE WHEN contains(vector, '/S:C') THEN {_weight('PR', ver._PR_CHANGED)} ELSE {_weight('PR', ver._PR_SAME)} END AS pr FROM v), "
    "i AS (SELECT *, 1 - (1 - c_) * (1 - i_) * (1 - a_) AS iss FROM w), "
    "m AS (SELECT *, CASE WHEN ch THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS imp FROM i), "
    "b AS (SELECT *, least(CASE WHEN ch THEN 1.08::DOUBLE * (imp + 8.22::DOUBLE * av * ac * pr * ui) ELSE imp + 8.22::DOUBLE * av * ac * pr * ui END, 10.0::DOUBLE) AS base FROM m), "
    "n AS (SELECT *, CAST(round(base * 100000) AS BIGINT) AS cents FROM b) "
    "SELECT vector, CASE WHEN vector LIKE 'CVSS:2%' OR NOT contains(vector, '/A:') THEN NULL WHEN imp <= 0 THEN 0.0::DOUBLE "
    "WHEN cents % 10000 = 0 THEN cents / 100000.0::DOUBLE ELSE (cents // 10000 + 1) / 10.0::DOUBLE END AS score FROM n"
)


@query(_SCORE_SQL)
def cvss_score(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{spark_sql(_VECTOR)} AS vector").distinct()
    return ver.add_cvss3_score(rows)


# ── advisories joined to packages ────────────────────────────────────────────

# Installed packages: one component per part, in scans by brand.
_INSTALLED = {
    "scan_id": "p_brand", "component_id": "concat('asset:', CAST(p_partkey AS VARCHAR(10)))",
    "name": "concat('pkg-', CAST(p_partkey % 60 AS VARCHAR(10)))",
    "version": "concat(CAST(p_size % 5 AS VARCHAR(10)), '.', CAST(IDIV(p_size, 5) AS VARCHAR(10)))",
    "ecosystem": pick("IDIV(p_partkey, 60)", ["pypi", "npm"]),
}
# Advisories: one per supplier.
_ADV = {
    "id": "concat('GHSA-', lpad(CAST(s_suppkey AS VARCHAR(10)), 6, '0'))",
    "alias": "CASE WHEN s_suppkey % 4 = 0 THEN 'PYSEC-1' ELSE concat('CVE-2024-', CAST(s_suppkey % 70 AS VARCHAR(10))) END",
    "package": "concat('pkg-', CAST(s_suppkey % 40 AS VARCHAR(10)))",
    "introduced": "CAST(s_suppkey % 2 AS VARCHAR(10))",
    "fixed1": "concat(CAST(1 + s_suppkey % 3 AS VARCHAR(10)), '.', CAST(s_suppkey % 7 AS VARCHAR(10)))",
    "fixed2": "concat(CAST(2 + s_suppkey % 3 AS VARCHAR(10)), '.9')",
    "vector": "CASE WHEN s_suppkey % 3 = 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' "
              "WHEN s_suppkey % 3 = 1 THEN 'CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N' ELSE 'CVSS:4.0/AV:N' END",
    "text": pick("s_suppkey", ["HIGH", "MODERATE", "", "low"]),
    "summary": "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('bug ', CAST(s_suppkey AS VARCHAR(10))) END",
}


def installed(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "part")).selectExpr(*[f"{spark_sql(v)} AS {k}" for k, v in _INSTALLED.items()])
    purl = ident.package_purl(F.col("ecosystem"), F.lit(""), F.col("name"), F.col("version"))
    return rows.withColumn("purl", purl).withColumn("kind", F.lit("library")).withColumn("confidence", F.lit(0.9))


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").selectExpr(*[f"{spark_sql(v)} AS {k}" for k, v in _ADV.items()])
    event = lambda k, v: F.create_map(F.lit(k), v)
    return a.select(
        "id", F.array("alias").alias("aliases"), F.lit("pypi").alias("ecosystem"), "package", "summary",
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.col("vector").alias("score"))).alias("severity"),
        F.col("text").alias("db_severity"),
        F.array(
            F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event("introduced", F.col("introduced")), event("fixed", F.col("fixed1"))).alias("events")),
            F.struct(F.lit("SEMVER").alias("type"), F.array(event("introduced", F.lit("2.5")), event("fixed", F.col("fixed2"))).alias("events")),
            F.struct(F.lit("GIT").alias("type"), F.array(event("introduced", F.lit("0")), event("fixed", F.lit("abc"))).alias("events")),
        ).alias("ranges"),
    )


# A package with a third of all versions and of all ranges, which are narrow, open or empty.
_HOT_VERSIONS = {
    "ecosystem": "'pypi'", "package": "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE concat('p', CAST(o_custkey % 50 AS VARCHAR(10))) END",
    "version": "CASE WHEN o_orderkey % 101 = 0 THEN 'main' ELSE concat(CAST(o_orderkey % 40 AS VARCHAR(10)), '.', "
               "CAST(IDIV(o_orderkey, 40) % 977 AS VARCHAR(10)), '.', CAST(o_custkey % 13 AS VARCHAR(10))) END",
}
_HOT_RANGES = {
    "id": "concat('A-', lpad(CAST(p_partkey AS VARCHAR(10)), 7, '0'))", "ecosystem": "'pypi'",
    "package": "CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE concat('p', CAST(p_partkey % 70 AS VARCHAR(10))) END",
    "introduced": "CASE WHEN p_partkey % 500 < 2 THEN NULL ELSE concat(CAST(p_partkey % 40 AS VARCHAR(10)), '.', CAST((p_partkey * 7) % 977 AS VARCHAR(10))) END",
    "fixed": "CASE WHEN p_partkey % 500 IN (0, 2) THEN NULL ELSE concat(CAST(p_partkey % 40 AS VARCHAR(10)), '.', "
             "CAST((p_partkey * 7) % 977 + p_size % 9 - 1 AS VARCHAR(10)), '.5') END",
}
_PARTS = lambda c: (f"(TRY_CAST(split_part({c}, '.', 1) AS BIGINT) * 1000000 + TRY_CAST(split_part({c}, '.', 2) AS BIGINT) * 1000 + "  # noqa: E731
                    f"coalesce(TRY_CAST(nullif(split_part({c}, '.', 3), '') AS BIGINT), 0))")


@query(
    "WITH v AS (SELECT DISTINCT " + ", ".join(f"{e} AS {n}" for n, e in _HOT_VERSIONS.items()) + " FROM orders), "
    "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _HOT_RANGES.items()) + " FROM part), "
    f"k AS (SELECT package, version, {_PARTS('version')} AS x FROM v), "
    f"b AS (SELECT package, id, {_PARTS('introduced')} AS lo, CASE WHEN contains(fixed, '-') THEN split_part(fixed, '.', 1)::BIGINT * 1000000 "
    f"ELSE {_PARTS('fixed')} END AS hi FROM r) "
    "SELECT package, version, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM k JOIN b USING (package) "
    "WHERE (lo IS NULL OR x >= lo) AND (hi IS NULL OR x < hi) GROUP BY ALL")
def cve_hot_package(spark, sf):
    """Advisory ranges of a package with thousands of versions and ranges, found by ranks."""
    coords = table(spark, sf, "orders").selectExpr(*[f"{spark_sql(e)} AS {n}" for n, e in _HOT_VERSIONS.items()]).distinct()
    ranges = table(spark, sf, "part").selectExpr(*[f"{spark_sql(e)} AS {n}" for n, e in _HOT_RANGES.items()])
    # Numbers in the order of the ids: least and greatest texts would sort every hit.
    ids = stored(numbered(ranges.filter("id IS NOT NULL").select("id").distinct(), ["id"], "no"), "advisory-ids")
    found = vulns.range_hits(coords, ranges.join(ids, "id", "left").drop("id").withColumnRenamed("no", "id")).groupBy("package", "version").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    named = lambda c: ids.select(F.col("id").alias(f"{c}_id"), F.col("no").alias(c))
    return found.join(named("first"), "first", "left").join(named("last"), "last", "left").select("package", "version", "n", "first_id", "last_id")


_NUM = lambda c: f"(CAST(split_part({c}, '.', 1) AS INT) * 1000 + coalesce(TRY_CAST(nullif(split_part({c}, '.', 2), '') AS INT), 0))"
_MATCH = (
    "p AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _INSTALLED.items()) + " FROM part), "
    "a AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _ADV.items()) + " FROM supplier), "
    f"pv AS (SELECT *, {_NUM('version')} AS v FROM p WHERE ecosystem = 'pypi'), "
    f"av AS (SELECT *, {_NUM('introduced')} AS i, {_NUM('fixed1')} AS f1, {_NUM('fixed2')} AS f2 FROM a), "
    "m0 AS (SELECT pv.scan_id, component_id, name, version, id, CASE WHEN starts_with(alias, 'CVE') THEN alias ELSE id END AS vuln_id, "
    "CASE WHEN starts_with(alias, 'CVE') THEN id ELSE alias END AS other, "
    "CASE WHEN vector LIKE '%/C:H%' THEN 9.8::DOUBLE WHEN vector LIKE '%/C:L%' THEN 1.8::DOUBLE ELSE 0.0::DOUBLE END AS score, vector, "
    "CASE WHEN vector LIKE '%/C:H%' THEN 'critical' WHEN vector LIKE '%/C:L%' THEN 'low' ELSE "
    "CASE upper(text) WHEN 'HIGH' THEN 'high' WHEN 'MODERATE' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'unknown' END END AS severity, summary, "
    "CASE WHEN f1 > v AND (f1 <= f2 OR f2 <= v) THEN fixed1 WHEN f2 > v THEN fixed2 ELSE fixed1 END AS fixed "
    "FROM pv JOIN av ON av.package = pv.name AND (v >= i AND v < f1 OR v >= 2005 AND v < f2)), "
    "r AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rk FROM m0), "
    "d AS (SELECT scan_id, component_id, vuln_id, min(name) AS name, min(version) AS version, first(severity ORDER BY score DESC, rk DESC, id) AS severity, "
    "first(score ORDER BY score DESC, rk DESC, id) AS score, first(vector ORDER BY score DESC, rk DESC, id) AS vector, first(fixed ORDER BY id) AS fixed, "
    "coalesce(first(summary ORDER BY id) FILTER (WHERE summary <> ''), '') AS summary, "
    "string_agg(DISTINCT other, '|' ORDER BY other) AS aliases FROM r GROUP BY ALL)"
)


@query(f"WITH {_MATCH} SELECT scan_id, component_id, id, vuln_id, severity, score, fixed FROM r")
def cve_join(spark, sf):
    return vulns.match_advisories(installed(spark, sf), advisories(spark, sf)).select(
        "scan_id", "component_id", "id", "vuln_id", "severity", "score", "fixed")


@query(f"WITH {_MATCH} SELECT scan_id, component_id, vuln_id, severity, score, vector, fixed, summary, aliases FROM d")
def component_vulns(spark, sf):
    return vulns.component_vulns(installed(spark, sf), advisories(spark, sf)).select(
        "scan_id", "component_id", "vuln_id", "severity", "score", "vector", "fixed", "summary",
        F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {_MATCH} SELECT scan_id, severity, count(*) AS n_vulns FROM d GROUP BY ALL")
def vulns_by_severity(spark, sf):
    return tables.vulns_by_severity(vulns.component_vulns(installed(spark, sf), advisories(spark, sf)))


_RANKED = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"WITH {_MATCH} SELECT scan_id, name AS library, vuln_id, severity, {_RANKED} AS rank, 'fixed' AS status, version AS installed, "
       "fixed, summary AS title FROM d")
def vuln_listing(spark, sf):
    comps = installed(spark, sf).withColumn("group", F.lit(None).cast("string"))
    return tables.vuln_listing(comps, vulns.component_vulns(comps, advisories(spark, sf), tables.vuln_names(comps))).drop("component_id")


@query(f"WITH {_MATCH} SELECT scan_id, 'cve/' || vuln_id AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' "
       "WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, vuln_id || ' (' || severity || ') affects ' || name || ' ' || version "
       "|| '; fixed in ' || fixed AS message, 'req.txt' AS uri, 3 AS start_line FROM d")
def sarif_vuln_results(spark, sf):
    comps = installed(spark, sf)
    occ = comps.select("scan_id", "component_id", F.lit("req.txt").alias("path"), F.explode(F.array(F.lit(7), F.lit(3))).alias("line"))
    return sarif.vuln_results(comps, vulns.component_vulns(comps, advisories(spark, sf), sarif.vuln_places(comps, occ)), occ).select(
        "scan_id", "rule_id", "level", "message", "uri", "start_line")


@query(f"WITH {_MATCH} SELECT scan_id, component_id AS affects, vuln_id AS id, severity, CASE WHEN vector LIKE 'CVSS:3.1%' THEN 'CVSSv31' ELSE 'CVSSv4' END AS method, "
       "CASE WHEN score > 0 THEN score END AS score, fixed AS fixed_version, aliases AS \"references\" FROM d")
def cdx_vulnerabilities_cve(spark, sf):
    comps = installed(spark, sf)
    none = spark.createDataFrame([], FINDINGS).withColumn("component_id", F.lit(""))
    out = cyclonedx.vulnerabilities(
        assemble.risks(none), assemble.risk_details(none), vulns.component_vulns(comps, advisories(spark, sf)))
    return out.select("scan_id", "affects", "id", "severity", "method", "score", "fixed_version", "references")


@query(f"WITH {_MATCH}, w AS (SELECT scan_id, max({_RANKED}) AS worst FROM d GROUP BY ALL) "
       "SELECT s.scan_id, coalesce(worst >= 3, false) AS tripped FROM (SELECT DISTINCT p_brand AS scan_id FROM part) s LEFT JOIN w USING (scan_id)")
def cve_gate(spark, sf):
    comps = installed(spark, sf).withColumn("risk_tags", F.array().cast("array<string>"))
    found = vulns.component_vulns(comps, advisories(spark, sf))
    return gate.gate_verdicts(gate.parse_gate("cve:high"), comps, comps.select("scan_id").distinct(), vulns=found)


@query("WITH p AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _INSTALLED.items()) + ", p_partkey FROM part) "
       "SELECT scan_id, count(*) AS queryable, count(*) FILTER (WHERE CAST(substr(name, 5) AS INT) % 7 = 0) AS unchecked FROM p GROUP BY ALL")
def check_coverage(spark, sf):
    comps = installed(spark, sf)
    seen = comps.filter(F.substring("name", 5, 9).cast("int") % 7 != 0).select("purl")
    return vulns.check_coverage(comps, seen)


# ── package URLs, licenses, trained-on edges, statistics ─────────────────────

_NAME = pick("p_partkey", ["@Scope/Pkg", "A_b.C", "github.com/X/y", "a b+c~d", "x:y=z", "naïve"])


def _enc(x: str) -> str:
    e = f"url_encode({x})"
    for have, want in [("%24", "$"), ("%26", "&"), ("%3D", "="), ("%3A", ":"), ("%2F", "/"), ("%7E", "~")]:
        e = f"replace({e}, '{have}', '{want}')"
    return e


@query(
    f"WITH t AS (SELECT p_partkey, {_NAME} AS n, '1.' || p_size || '+b' AS v FROM part) SELECT p_partkey, "
    f"'pkg:npm/' || {_enc('lower(n)')} || '@' || {_enc('v')} AS npm, "
    f"'pkg:pypi/' || {_enc(chr(40) + 'regexp_replace(lower(n), ' + chr(39) + '[-_.]+' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))} || '@' || {_enc('v')} AS pypi, "
    f"'pkg:maven/' || {_enc('n')} || '/' || {_enc('n')} AS maven, 'pkg:generic/' || {_enc('n')} || '?checksum=sha256:ab' AS generic, "
    f"'pkg:huggingface/org/' || {_enc('lower(n)')} AS hf, 'pkg:oci/' || {_enc('lower(n)')} || '@sha256:1' AS oci FROM t")
def package_urls(spark, sf):
    n, v, none = F.col("n"), F.col("v"), F.lit("")
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{spark_sql(_NAME)} AS n", "concat('1.', CAST(p_size AS STRING), '+b') AS v")
    return rows.select(
        "p_partkey", ident.package_purl(F.lit("npm"), none, n, v).alias("npm"),
        ident.package_purl(F.lit("pypi"), none, n, v).alias("pypi"), ident.package_purl(F.lit("maven"), n, n, none).alias("maven"),
        ident.generic_purl(n, F.lit("AB")).alias("generic"), ident.huggingface_purl(F.lit("Org"), n, none).alias("hf"),
        ident.oci_purl(n, F.lit("sha256:1")).alias("oci"))


@query(
    "SELECT DISTINCT e.user_id % 20 AS component, CASE WHEN event_type = 'click' THEN 'expression' ELSE 'id' END AS form, "
    "CASE WHEN event_type = 'click' THEN 'MIT OR X' ELSE 'L-' || (user_id % 3) END AS value FROM events e")
def license_union(spark, sf):
    e = table(spark, sf, "events")
    click = F.col("event_type") == "click"
    lic = F.struct(F.concat(F.lit("L-"), (F.col("user_id") % 3).cast("string")).alias("spdx_id"), F.lit("n").alias("name"),
                   F.when(click, "MIT OR X").alias("expression"))
    rows = e.select(F.lit("s").alias("scan_id"), (F.col("user_id") % 20).alias("component_id"), F.array(lic, lic).alias("licenses"))
    return cyclonedx.licenses(assemble.licenses(rows)).select(F.col("bom_ref").alias("component"), "form", "value").distinct()


@query(
    "WITH e AS (SELECT l_orderkey % 50 AS scan, l_partkey % 40 AS f, l_suppkey % 30 AS t, l_quantity / 60 AS c FROM lineitem) "
    "SELECT CAST(scan AS VARCHAR) AS scan_id, CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id, "
    "round(least(1 - product(1 - c), 0.99), 9) AS confidence, count(*) AS n_evidence FROM e WHERE f <> t GROUP BY ALL")
def edge_confidence(spark, sf):
    from ..operators import graph
    e = table(spark, sf, "lineitem").selectExpr(
        "CAST(l_orderkey % 50 AS STRING) AS scan_id", "CAST(l_partkey % 40 AS STRING) AS from_id",
        "CAST(l_suppkey % 30 AS STRING) AS to_id", "'uses' AS type", "l_quantity / 60 AS confidence").filter("from_id <> to_id")
    return graph.edges(e).select("scan_id", "from_id", "to_id", F.round("confidence", 9).alias("confidence"), "n_evidence")


@query(
    "WITH o AS (SELECT l_partkey % 200 AS id, l_orderkey % 300 AS p, l_linenumber AS line, l_suppkey % 7 AS c, l_returnflag AS det, "
    "CAST(l_quantity AS INT) % 3 AS m FROM lineitem), w AS (SELECT *, lag(det) OVER x AS pd, lag(p) OVER x AS pp, lag(line) OVER x AS pl FROM o "
    "WINDOW x AS (PARTITION BY id ORDER BY p, line, c, det, m)) SELECT CAST(id AS VARCHAR) AS component_id, count(*) AS kept FROM w "
    "WHERE pd IS NULL OR pd <> det OR pp <> p OR pl <> line GROUP BY ALL")
def occurrence_dedupe(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "'s' AS scan_id", "l_orderkey AS finding_seq", "CAST(l_partkey % 200 AS STRING) AS component_id",
        "CAST(l_orderkey % 300 AS STRING) AS path", "l_linenumber AS line", "CAST(l_suppkey % 7 AS INT) AS col",
        "l_returnflag AS detector_id", "CAST(CAST(l_quantity AS INT) % 3 AS STRING) AS method")
    full = conform(rows, FINDINGS + ", component_id string")
    return assemble.occurrences(full).groupBy("component_id").agg(F.count("*").alias("kept"))


@query(
    "WITH f AS (SELECT 's' || (user_id % 40) AS scan_id, " + pick("event_id", ["rules/a/b", "manifest/npm", "prompt/file"])
    + " AS det FROM events), r AS (SELECT 's' || (user_id % 40) AS scan_id, " + pick("IDIV(event_id, 3)", ["ruleengine", "manifest/npm", "gosrc/ast"])
    + " AS det FROM events), a AS (SELECT scan_id, det, count(*) AS n FROM r GROUP BY ALL), "
    "b AS (SELECT scan_id, CASE WHEN starts_with(det, 'rules/') THEN 'ruleengine' ELSE det END AS det, count(*) AS n FROM f GROUP BY ALL) "
    "SELECT scan_id, det AS detector_id, coalesce(a.n, 0) AS invocations, coalesce(b.n, 0) AS findings FROM a FULL JOIN b USING (scan_id, det)")
def detector_stats(spark, sf):
    e = table(spark, sf, "events")
    scan = "concat('s', CAST(user_id % 40 AS STRING)) AS scan_id"
    f = e.selectExpr(scan, pick("event_id", ["rules/a/b", "manifest/npm", "prompt/file"]) + " AS detector_id")
    r = e.selectExpr(scan, spark_sql(pick("IDIV(event_id, 3)", ["ruleengine", "manifest/npm", "gosrc/ast"])) + " AS detector_id")
    return tables.detector_stats(r, f)
