"""Findings to components.

Every step is a narrow projection, a partially aggregated ``groupBy`` or an equi-join on keys
that start with ``scan_id``. Evidence stays in flat tables keyed by component, so a component
seen a billion times is a billion rows of ``occurrences`` and never one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions.text import basename, blank_to_null, is_set, strip
from ..schemas import METHODS, check_enums
from .risks import risk_severity

HASH_METHODS = ["hash-comparison", "attestation"]


def finding_order() -> Column:
    """Order of findings in a scan: phase, path, then the sequence inside the file.

    The phase sits in the top byte of ``finding_seq``; no global numbering is needed.
    """
    return F.struct(F.shiftright("finding_seq", 56).alias("phase"), "path", "finding_seq")


def key_findings(findings: DataFrame) -> DataFrame:
    """Add class, normalized provider and name, discriminator and the pre-fold id."""
    eco = F.coalesce(F.col("ecosystem"), F.lit(""))
    return (
        check_enums(findings)
        .withColumns({
            "cls": ident.kind_class(F.col("kind")), "cprovider": ident.normalize_provider(F.col("provider")),
        })
        .withColumns({
            "cname": ident.normalize_name(F.col("cls"), F.col("name"), eco),
            "snapshot": ident.snapshot_version(F.col("cls"), F.col("name")),
        })
        .withColumn(
            "disc", ident.discriminator(F.col("cls"), F.col("cname"), eco, ident.first_sha256(F.col("hashes")))
        )
        .withColumn(
            "draft_id", ident.component_id(F.col("cls"), F.col("cprovider"), F.col("cname"), F.col("disc"))
        )
    )


def drafts(keyed: DataFrame) -> DataFrame:
    """Distinct identities per scan, before folding."""
    return keyed.select("scan_id", "draft_id", "cls", "cprovider", "cname", "disc").distinct()


def redirects(draft_rows: DataFrame) -> DataFrame:
    """Ids without an owner field that fold into the only sibling with one.

    The owner field is the ecosystem for packages (siblings share provider and name) and the
    provider for hosted models (siblings share the name). A group holds at most one id
    without owner, because its key is then complete, so conditional aggregates decide the
    fold in one pass; no sibling or several siblings refuse.
    """
    package = F.col("cls") == "package"
    owned = F.when(package, F.col("disc") != "").otherwise(F.col("cprovider") != "")
    return (
        draft_rows.filter(F.col("cls").isin("package", "hosted-model"))
        .groupBy("scan_id", "cls", F.when(package, F.col("cprovider")).otherwise("").alias("provider"), "cname")
        .agg(
            F.count_if(owned).alias("homes"),
            F.max(F.when(owned, F.col("draft_id"))).alias("component_id"),
            F.max(F.when(~owned, F.col("draft_id"))).alias("draft_id"),
        )
        .filter("homes = 1 AND draft_id IS NOT NULL")
        .select("scan_id", "draft_id", "component_id", "cls")
    )


def package_redirects(draft_rows: DataFrame) -> DataFrame:
    """Packages without ecosystem folding into their only ecosystem."""
    return redirects(draft_rows).filter("cls = 'package'").drop("cls")


def model_redirects(draft_rows: DataFrame) -> DataFrame:
    """Hosted models without provider folding into their only provider."""
    return redirects(draft_rows).filter("cls = 'hosted-model'").drop("cls")


def sightings(keyed: DataFrame, redirect_rows: DataFrame | None = None) -> DataFrame:
    """Findings with their final ``component_id``; ``folded`` marks redirected ones."""
    if redirect_rows is None:
        redirect_rows = redirects(drafts(keyed))
    home = redirect_rows.select("scan_id", "draft_id", F.col("component_id").alias("_home"))
    return (
        keyed.join(home, ["scan_id", "draft_id"], "left")
        .withColumn("component_id", F.coalesce("_home", "draft_id"))
        .withColumn("folded", F.col("_home").isNotNull())
        .drop("_home")
    )


def surviving(draft_rows: DataFrame, redirect_rows: DataFrame) -> DataFrame:
    """Identities left after folding."""
    return draft_rows.join(redirect_rows, ["scan_id", "draft_id"], "left_anti").withColumnRenamed(
        "draft_id", "component_id"
    )


# ── evidence ─────────────────────────────────────────────────────────────────


def occurrences(sighted: DataFrame) -> DataFrame:
    """Deduplicated occurrences.

    Rule: in the order path, line, column, detector, method, snippet, drop a row that equals
    its predecessor in (path, line, detector). Path and line lead that order, so the
    comparison never leaves one line of one file; exact repeats are first removed by a
    partial aggregate, which leaves the window one line's distinct hits however often the
    line was reported.
    """
    fields_json = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    distinct = (
        sighted.withColumn("fields_json", fields_json)
        .groupBy(
            "scan_id", "component_id", "path", "line", "col", "detector_id", "method", "snippet",
            "confidence", "symbol", "end_line", "end_col", "fields_json",
        )
        .agg(F.min("finding_seq").alias("finding_seq"))
    )
    spot = W.partitionBy("scan_id", "component_id", "path", "line").orderBy(
        "col", "detector_id", "method", "snippet", "finding_seq", "confidence"
    )
    return (
        distinct.withColumn("_prev", F.lag("detector_id").over(spot))
        .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("detector_id")))
        .drop("_prev")
    )


def confidences(occ: DataFrame) -> DataFrame:
    """Grouped noisy-OR per component.

    Per (detector, method): g = max + (1 - max) * min(0.05 * (n - 1), 0.15). Per method the
    largest g. Then 1 - product(1 - g) in sorted method order, capped at 0.99 unless hash or
    attestation evidence exists. The methods are an enumeration, so the last level is one
    aggregate with a column per method instead of a collected list.
    """
    per_detector = occ.groupBy("scan_id", "component_id", "detector_id", "method").agg(
        F.max("confidence").alias("m"), F.count("*").alias("n")
    )
    g = F.col("m") + (1 - F.col("m")) * F.least(0.05 * (F.col("n") - 1), F.lit(0.15))
    methods = sorted(METHODS)
    wide = per_detector.withColumn("g", g).groupBy("scan_id", "component_id").agg(
        F.sum("n").alias("n_occurrences"),
        *[F.max(F.when(F.col("method") == m, F.col("g"))).alias(f"g_{i}") for i, m in enumerate(methods)],
    )
    rest = F.lit(1.0)
    for i in range(len(methods)):
        rest = rest * (1 - F.coalesce(F.col(f"g_{i}"), F.lit(0.0)))
    certain = F.lit(False)
    for i, m in enumerate(methods):
        if m in HASH_METHODS:
            certain = certain | F.col(f"g_{i}").isNotNull()
    raw = 1 - rest
    return wide.select(
        "scan_id", "component_id", "n_occurrences",
        F.when(certain, raw).otherwise(F.least(raw, F.lit(0.99))).alias("confidence"),
    )


def identity_claims(sighted: DataFrame) -> DataFrame:
    """Contested versions and names: one row per (component, field, value), best confidence."""
    raw = strip(F.coalesce(F.col("name"), F.lit("")))
    claim = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    claims = F.array(
        claim("version", strip(F.coalesce(F.col("version"), F.lit("")))),
        claim("version", F.col("snapshot")),
        claim("name", F.when(raw != F.col("cname"), raw).otherwise("")),
    )
    return (
        sighted.select(
            "scan_id", "component_id", "method", "confidence", "folded", finding_order().alias("seen"),
            F.explode(F.filter(claims, lambda c: c["value"] != "")).alias("c"),
        )
        .groupBy("scan_id", "component_id", F.col("c.field").alias("field"), F.col("c.value").alias("value"))
        .agg(
            F.max("confidence").alias("confidence"),
            F.min_by("method", F.struct((-F.col("confidence")).alias("c"), "folded", "seen", "method")).alias("method"),
        )
    )


def resolved_versions(claims: DataFrame) -> DataFrame:
    """Winning version: highest confidence, then smallest value."""
    return (
        claims.filter("field = 'version'")
        .groupBy("scan_id", "component_id")
        .agg(F.min_by("value", F.struct((-F.col("confidence")).alias("c"), "value")).alias("version"))
    )


# Facet fields: (facet, field).
MODEL_FIELDS = ["task", "architecture", "quantization", "format", "base_model", "param_count", "context_length"]
DATA_FIELDS = ["format", "size_bytes", "url"]
INFRA_FIELDS = ["endpoint", "region", "deployment"]
FACETS = (
    [("model", f) for f in MODEL_FIELDS] + [("data", f) for f in DATA_FIELDS] + [("infra", f) for f in INFRA_FIELDS]
)
_NUMERIC = {"param_count", "context_length", "size_bytes"}


def _facet_value(facet: str, field: str) -> Column:
    c = F.col(f"{facet}.{field}")
    given = F.nullif(c, F.lit(0).cast("bigint")) if field in _NUMERIC else blank_to_null(c)
    # A folded sighting brings no model, data or infra facets along.
    return F.when(~F.col("folded"), given)


def facet_bounds() -> list[Column]:
    """Smallest and largest claim per facet field: equal means agreed, different means conflict."""
    out = []
    for facet, field in FACETS:
        value = _facet_value(facet, field)
        out += [F.min(value).alias(f"{facet}_{field}_lo"), F.max(value).alias(f"{facet}_{field}_hi")]
    return out


def facet_state(facet: str, field: str) -> Column:
    """struct<p, v>: absent, unknown (conflict) or known with its value."""
    lo, hi = F.col(f"{facet}_{field}_lo"), F.col(f"{facet}_{field}_hi")
    p = F.when(lo.isNull(), "absent").when(lo == hi, "known").otherwise("unknown")
    return F.struct(p.alias("p"), F.when(lo == hi, lo).alias("v")).alias(f"{facet}_{field}")


def facets(sighted: DataFrame) -> DataFrame:
    """Merged facets: one known value stays known, conflicting values become unknown."""
    merged = sighted.groupBy("scan_id", "component_id").agg(*facet_bounds())
    return merged.select("scan_id", "component_id", *[facet_state(a, b) for a, b in FACETS])


def facet_conflicts(facet_rows: DataFrame) -> DataFrame:
    """One warning per conflicting facet field."""
    names = F.array(*[
        F.when(F.col(f"{a}_{b}.p") == "unknown", F.lit(f"{a}.{b}")) for a, b in FACETS
    ])
    return facet_rows.select(
        "scan_id", "component_id", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("field")
    )


def licenses(sighted: DataFrame) -> DataFrame:
    return sighted.select("scan_id", "component_id", F.explode("licenses").alias("l")).select(
        "scan_id", "component_id", "l.*"
    ).distinct()


def hashes(sighted: DataFrame) -> DataFrame:
    """Distinct hashes; algorithm and digest compare without case, digests stored lower-case."""
    return (
        sighted.select("scan_id", "component_id", "folded", finding_order().alias("seen"), F.explode("hashes").alias("h"))
        .groupBy("scan_id", "component_id", F.lower("h.alg").alias("_alg"), F.lower("h.hex").alias("hex"))
        .agg(F.min_by("h.alg", F.struct("folded", "seen", "h.alg")).alias("alg"))
        .select("scan_id", "component_id", "alg", "hex")
    )


def risk_details(sighted: DataFrame) -> DataFrame:
    """Distinct (component, risk, detail)."""
    return (
        sighted.select("scan_id", "component_id", F.explode("risks").alias("r"))
        .select("scan_id", "component_id", F.col("r.id").alias("risk_id"), F.explode("r.detail").alias("detail"))
        .distinct()
    )


def risks(sighted: DataFrame) -> DataFrame:
    """One row per (component, risk) with the smallest occurrence as provenance."""
    place = F.struct("path", "line", "col", "detector_id", "method", "snippet", "end_line", "end_col", "confidence")
    return (
        sighted.select("scan_id", "component_id", F.explode("risks.id").alias("risk_id"), place.alias("o"))
        .groupBy("scan_id", "component_id", "risk_id")
        .agg(F.min("o").alias("o"))
        .select(
            "scan_id", "component_id", "risk_id", risk_severity(F.col("risk_id")).alias("severity"),
            "o.path", "o.line", "o.col", "o.end_line", "o.end_col", "o.detector_id", "o.method", "o.snippet",
        )
    )


# ── components ───────────────────────────────────────────────────────────────


def resolved_kind(cls: Column, precedence: Column) -> Column:
    """Kind of a class at the highest precedence seen; unique within each class."""
    out = F.lit(None).cast("string")
    for kind, kind_cls in reversed(list(ident.KIND_CLASS.items())):
        rank = ident.KIND_PRECEDENCE.get(kind, 0)
        out = F.when((cls == kind_cls) & (precedence == rank), F.lit(kind)).otherwise(out)
    return out


def component_scalars(sighted: DataFrame) -> DataFrame:
    """Kind, names, first-wins scalars and facets: one aggregate over all sightings."""
    order = F.struct(F.col("folded"), finding_order().alias("seen"))
    raw = strip(F.coalesce(F.col("name"), F.lit("")))
    first = lambda c: F.min_by(F.col(c), F.when(is_set(F.col(c)), order))
    own = ~F.col("folded")
    merged = sighted.groupBy("scan_id", "component_id").agg(
        F.max("cls").alias("cls"),
        F.max("cname").alias("name"),
        F.max(F.when(own, F.col("cprovider"))).alias("provider"),
        F.max(F.when(own, F.col("disc"))).alias("disc"),
        F.max(ident.kind_precedence(F.col("kind"))).alias("precedence"),
        first("group").alias("group"),
        first("download_location").alias("download_location"),
        first("ecosystem").alias("ecosystem"),
        F.min(F.when(is_set(F.col("ecosystem")) & (raw != ""), raw)).alias("declared_name"),
        *facet_bounds(),
    )
    return merged.select(
        "scan_id", "component_id", "cls",
        resolved_kind(F.col("cls"), F.col("precedence")).alias("kind"),
        "name", "provider", "disc", "group", "download_location", "ecosystem", "declared_name",
        *[facet_state(a, b) for a, b in FACETS],
    )


def purl_of() -> Column:
    """Package URL of an assembled component; null where the class has none."""
    sha = F.regexp_extract("disc", "^sha256:(.*)$", 1)
    return F.when(F.col("cls") == "weights-file", ident.generic_purl(F.col("name"), sha)).when(
        (F.col("cls") == "package") & is_set(F.col("version")),
        ident.package_purl(
            F.col("ecosystem"), F.col("group"), F.coalesce("declared_name", "name"), F.col("version")
        ),
    )


def model_properties() -> Column:
    """Provider and id properties of hosted models."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    props = F.array(
        F.when(F.col("provider") != "", pair(f"{ident.ID_PREFIX}model.provider", F.col("provider"))),
        pair(f"{ident.ID_PREFIX}model.id", F.col("name")),
    )
    return F.when(F.col("cls") == "hosted-model", F.filter(props, lambda p: p.isNotNull()))


def components(sighted: DataFrame, occ: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """One row per component: scalars, facets, version, confidence, package URL."""
    occ = occurrences(sighted) if occ is None else occ
    claims = identity_claims(sighted) if claims is None else claims
    keys = ["scan_id", "component_id"]
    out = (
        component_scalars(sighted)
        .join(confidences(occ), keys)
        .join(resolved_versions(claims), keys, "left")
    )
    return out.withColumn("purl", purl_of()).withColumn("properties", model_properties())


def root_components(scans: DataFrame) -> DataFrame:
    """The application root of each scan: id from the lower-case name, name as given."""
    target = F.regexp_replace(F.coalesce("target", F.lit("")), "/+$", "")
    given = F.when(F.coalesce("target", F.lit("")).contains("/") & target.contains("/"), basename(target)).otherwise(
        F.coalesce("target", F.lit(""))
    )
    name = F.when(given == "", "application").otherwise(given)
    empty = F.lit("")
    return scans.select(
        "scan_id",
        ident.component_id(F.lit("app"), empty, F.lower(name), empty).alias("component_id"),
        F.lit("app").alias("cls"),
        F.lit("application").alias("kind"),
        name.alias("name"),
    )


def with_roots(component_rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Add each scan's root unless a finding already claimed that identity."""
    claimed = component_rows.filter("cls = 'app'").select("scan_id", "component_id")
    roots = (
        root_components(scans)
        .join(claimed, ["scan_id", "component_id"], "left_anti")
        .withColumn("confidence", F.lit(0.0))
        .withColumn("n_occurrences", F.lit(0).cast("bigint"))
    )
    return component_rows.unionByName(roots, allowMissingColumns=True)
