"""Relation claims to edges, and parameter promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity as ident


def name_index(survivors: DataFrame) -> DataFrame:
    """How many components of a scan carry a (class, name), and one of them."""
    return survivors.groupBy("scan_id", "cls", "cname").agg(
        F.count("*").alias("candidates"), F.min("component_id").alias("target_id")
    )


def path_detector_index(sighted: DataFrame) -> DataFrame:
    """Distinct components one detector claimed in one file."""
    return (
        sighted.select("scan_id", "path", "detector_id", "component_id")
        .distinct()
        .groupBy("scan_id", "path", "detector_id")
        .agg(F.count("*").alias("candidates"), F.min("component_id").alias("target_id"))
    )


def relation_claims(sighted: DataFrame) -> DataFrame:
    """One row per relation claim with the wanted target name worked out."""
    claims = sighted.select(
        "scan_id", "component_id", "finding_seq", "name", "path", "line", "col", "detector_id", "confidence",
        "fields", F.posexplode("relations").alias("rel_no", "r"),
    )
    empty = F.lit("")
    ref, field, given = (F.coalesce(f"r.{c}", empty) for c in ("local_ref", "from_field", "name"))
    by_field = F.coalesce(
        F.nullif(F.try_element_at("fields", field), empty),
        F.nullif(F.try_element_at("fields", F.concat(F.lit("param."), field)), empty),
    )
    form = (
        F.when(ref != "", "local_ref").when(field != "", "from_field").when(given != "", "name").otherwise("none")
    )
    rule_ref = F.when(ref.startswith("rules/") | ~ref.contains("/"), ref).otherwise(
        F.concat(F.lit("rules/"), ref)
    )
    wanted = F.when(form == "from_field", by_field).when(form == "name", given)
    target_cls = ident.kind_class(F.coalesce("r.target_kind", empty))
    return claims.select(
        "scan_id", F.col("component_id").alias("from_id"), F.col("name").alias("from_name"),
        "finding_seq", "rel_no", "path", "line", "col", "detector_id", "confidence",
        F.col("r.type").alias("type"), F.col("r.target_kind").alias("target_kind"), form.alias("form"),
        field.alias("from_field"), rule_ref.alias("ref_detector"), wanted.alias("wanted"),
        target_cls.alias("target_cls"),
        ident.normalize_name(target_cls, wanted, empty).alias("target_name"),
    )


def resolve_claims(claims: DataFrame, names: DataFrame, local: DataFrame) -> DataFrame:
    """Add ``candidates`` and ``target_id`` to every claim.

    Both indexes hold one row per key and are stacked into one lookup table, so all claim
    forms resolve in a single join. A claim that names nothing gets a key no index has.
    """
    lookup = names.select(
        "scan_id", F.lit("name").alias("k"), F.col("cls").alias("a"), F.col("cname").alias("b"),
        "candidates", "target_id",
    ).unionByName(
        local.select(
            "scan_id", F.lit("ref").alias("k"), F.col("path").alias("a"), F.col("detector_id").alias("b"),
            "candidates", "target_id",
        )
    )
    named = F.col("form").isin("name", "from_field") & F.col("wanted").isNotNull()
    is_ref = F.col("form") == "local_ref"
    keyed = claims.withColumns({
        "k": F.when(named, "name").when(is_ref, "ref").otherwise("none"),
        "a": F.when(named, F.col("target_cls")).otherwise(F.col("path")),
        "b": F.when(named, F.col("target_name")).when(is_ref, F.col("ref_detector")).otherwise(F.col("detector_id")),
    })
    return (
        keyed.join(lookup, ["scan_id", "k", "a", "b"], "left")
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .drop("k", "a", "b")
    )


def edge_evidence(resolved: DataFrame) -> DataFrame:
    """Resolved claims between two different components."""
    return resolved.filter((F.col("candidates") == 1) & (F.col("target_id") != F.col("from_id"))).select(
        "scan_id", "from_id", "type", F.col("target_id").alias("to_id"),
        "path", "line", "col", "detector_id", "confidence", "finding_seq",
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Warnings: claims whose target is missing or ambiguous."""
    reason = (
        F.when(F.col("form") == "none", "the relation names no target")
        .when((F.col("form") == "from_field") & F.col("wanted").isNull(),
              F.concat(F.lit("field not captured: "), "from_field"))
        .when((F.col("form") == "local_ref") & (F.col("candidates") == 0),
              F.concat(F.lit("same file lacks a finding of "), "ref_detector"))
        .when(F.col("candidates") == 0, F.concat(F.lit("target not found: "), F.concat_ws("/", "target_kind", "wanted")))
        .otherwise(F.concat(F.lit("several targets fit: "), F.col("candidates").cast("string")))
    )
    return resolved.filter("candidates <> 1").select(
        "scan_id", "path", "line", F.col("from_id").alias("component_id"), "from_name", "type", reason.alias("reason")
    )


def edges(evidence: DataFrame) -> DataFrame:
    """One edge per (from, type, to): noisy-OR of its sightings, at most 0.99.

    Capping after every sighting, as a running update would, gives the same value: the
    noisy-OR never falls, so one final cap is enough and the product can be partially
    aggregated however many sightings an edge has.
    """
    return evidence.groupBy("scan_id", "from_id", "type", "to_id").agg(
        # The product's order is not fixed, so its last bits are rounded away.
        F.round(F.least(1 - F.product(1 - F.col("confidence")), F.lit(0.99)), 12).alias("confidence"),
        F.count("*").alias("n_evidence"),
    )


def promoted_params(sighted: DataFrame, names: DataFrame) -> DataFrame:
    """Call-site parameters bound to the hosted model the same sighting names.

    Uses all sightings, before occurrence deduplication. In the order name, value, path,
    line, column, detector a binding equal to its predecessor in name, value and location
    is dropped; that comparison stays inside one position of one file.
    """
    params = F.map_filter("fields", lambda k, v: k.startswith("param."))
    hosted = F.lit("hosted-model")
    model = F.try_element_at("fields", F.lit("model"))
    bound = (
        sighted.filter(F.coalesce(model, F.lit("")) != "")
        .select(
            "scan_id", "path", "line", "col", "end_line", "end_col", "detector_id",
            ident.normalize_name(hosted, model, F.lit("")).alias("cname"),
            F.explode(params).alias("key", "value"),
        )
        .withColumn("param", F.expr("substring(key, 7)"))
        .drop("key")
        .distinct()
    )
    target = names.filter("cls = 'hosted-model' AND candidates = 1").select("scan_id", "cname", "target_id")
    spot = W.partitionBy("scan_id", "component_id", "param", "value", "path", "line", "col").orderBy(
        "detector_id", "end_line", "end_col"
    )
    ends = F.struct("end_line", "end_col")
    return (
        bound.join(target, ["scan_id", "cname"])
        .withColumnRenamed("target_id", "component_id")
        .withColumn("_prev", F.lag(ends).over(spot))
        .filter(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(ends))
        .select("scan_id", "component_id", "param", "value", "path", "line", "col", "detector_id")
    )


# ── graph lookups ────────────────────────────────────────────────────────────


def by_kind(component_rows: DataFrame, kind: str) -> DataFrame:
    return component_rows.filter(F.col("kind") == kind)


def get(component_rows: DataFrame, component_id: str) -> DataFrame:
    return component_rows.filter(F.col("component_id") == component_id)


def edges_from(edge_rows: DataFrame, component_id: str) -> DataFrame:
    return edge_rows.filter(F.col("from_id") == component_id)


def edges_to(edge_rows: DataFrame, component_id: str) -> DataFrame:
    return edge_rows.filter(F.col("to_id") == component_id)
