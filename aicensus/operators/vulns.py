"""Known-vulnerability overlay: components joined to an advisory table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import (
    add_cvss3_score, severity_from_score, severity_from_text, severity_rank, version_key, version_shaped,
)
from ..session import stored
from .order import numbered

# Package-URL types that advisories cover.
ADVISORY_ECOSYSTEMS = ["pypi", "npm", "golang", "cargo", "maven", "nuget"]


def queryable(purl: Column) -> Column:
    """A versioned package URL of a covered ecosystem."""
    eco = F.regexp_extract(purl, r"^pkg:([^/]*)", 1)
    return F.coalesce(purl.contains("@") & eco.isin(ADVISORY_ECOSYSTEMS), F.lit(False))


def coordinate(component_rows: DataFrame) -> DataFrame:
    """Components that can be checked, with (ecosystem, package, version) from the package URL."""
    body = F.regexp_extract("purl", r"^pkg:[^/]*/(.*)@[^@]*$", 1)
    return (
        component_rows.filter(queryable(F.col("purl")))
        .withColumn("ecosystem", F.regexp_extract("purl", r"^pkg:([^/]*)", 1))
        .withColumn("package", F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))
        .select("scan_id", "component_id", "name", "version", "ecosystem", "package")
    )


def version_ranges(advisories: DataFrame) -> DataFrame:
    """Affected ranges: each ``introduced`` event up to the next ``fixed`` event after it."""
    events = advisories.select(
        "id", "ecosystem", "package", F.posexplode("ranges").alias("range_no", "r")
    ).filter(F.col("r.type") != "GIT")
    pairs = events.select(
        "id", "ecosystem", "package", "range_no", F.col("r.events").alias("events"),
        F.posexplode("r.events").alias("event_no", "e"),
    ).filter(F.try_element_at("e", F.lit("introduced")).isNotNull())
    later = F.filter(
        F.slice("events", F.col("event_no") + 2, F.greatest(F.size("events"), F.lit(1))),
        lambda e: F.try_element_at(e, F.lit("fixed")).isNotNull(),
    )
    return pairs.select(
        "id", "ecosystem", "package", "range_no",
        F.try_element_at("e", F.lit("introduced")).alias("introduced"),
        F.try_element_at(F.get(later, F.lit(0)), F.lit("fixed")).alias("fixed"),
    )


def in_range(version: Column, introduced: Column, fixed: Column) -> Column:
    """introduced <= version < fixed; a missing bound is open."""
    v = version_key(version)
    lo, hi = version_key(introduced), version_key(fixed)
    return (lo.isNull() | (v >= lo)) & (hi.isNull() | (v < hi))


# Pairs of (version, range) of one package that are compared directly; packages with more go through ranks.
DIRECT_PAIRS = 20_000


def span_nodes(low: Column, high: Column) -> Column:
    """The interval [low, high) of ranks as aligned blocks (level, node) of 2^level ranks: two a level at most."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low).cast("double"))).cast("int"))

    def blocks(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        lo, hi = F.ceil(low / width).cast("bigint"), F.floor(high / width).cast("bigint")
        block = lambda node: F.struct(level.alias("level"), node.alias("node"))
        return F.filter(F.array(
            F.when((lo % 2 == 1) & (lo < hi), block(lo)), F.when((hi % 2 == 1) & (lo + lo % 2 < hi), block(hi - 1))), lambda b: b.isNotNull())

    return F.flatten(F.transform(levels, blocks))


# Versions and ranges meet in blocks of 2^level ranks.
FINE, COARSE = 6, 12


def apart(placed: DataFrame) -> DataFrame:
    """Intervals [low, high) of one (package, id), touching or overlapping ones joined, so that no rank lies in two of them."""
    rows = ["ecosystem", "package", "id"]
    earlier = W.partitionBy(*rows).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    reach = placed.select(*rows, "low", "high").distinct().withColumn("reach", F.max("high").over(earlier))
    starts = reach.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("low") > F.col("reach"))).over(
        W.partitionBy(*rows).orderBy("low", "high").rowsBetween(W.unboundedPreceding, 0)))
    return starts.groupBy(*rows, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def met_blocks(low: Column, high: Column) -> Column:
    """Blocks (level, node) that hold every rank of [low, high) once: coarse ones inside it, fine ones that meet the rest."""
    shift = lambda c, by: F.call_function("shiftright", c, F.lit(by))
    first, end = shift(low + ((1 << COARSE) - 1), COARSE), shift(high, COARSE)  # coarse blocks that lie inside
    per = 1 << (COARSE - FINE)
    fine, last = shift(low, FINE), shift(high - 1, FINE)

    def nodes(level: int, start: Column, stop: Column) -> Column:
        found = F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(found, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    inside = first < end
    return F.when(inside, F.concat(nodes(FINE, fine, first * per - 1), nodes(COARSE, first, end - 1), nodes(FINE, end * per, last))).otherwise(
        nodes(FINE, fine, last))


def ranked_hits(coords: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, package, version, id) of the versions inside a range, without comparing all of both.

    Versions and bounds of all packages become numbers in one order. A version lies in one fine and one coarse block of
    numbers; a range meets the coarse blocks inside it and the fine ones at its ends, and the intervals of one id are joined
    first. So an equi-join on the block gives each hit once, and only the ends, 64 numbers each, are compared in vain.
    No block of a wide range is larger than a coarse one, so that the hits of wide ranges are many join keys.
    """
    package = ["ecosystem", "package"]
    keyed = stored(coords.select(*package, "version").distinct().withColumn("k", version_key(F.col("version"))), "advisory-versions")
    bounds = stored(ranges.select(*package, "id", version_key(F.col("introduced")).alias("lo"), version_key(F.col("fixed")).alias("hi")),
                    "advisory-ranges")
    marks = reduce(DataFrame.unionByName, [keyed.select(*package, "k"), *(bounds.select(*package, F.col(c).alias("k")) for c in ("lo", "hi"))])
    ranks = stored(numbered(marks.filter("k IS NOT NULL").distinct(), [*package, "k"], "rank"), "advisory-ranks")
    spans = ranks.groupBy(*package).agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("end"))
    bound = lambda c: ranks.select(*package, F.col("k").alias(c), F.col("rank").alias(f"{c}_rank"))
    placed = bounds.join(bound("lo"), [*package, "lo"], "left").join(bound("hi"), [*package, "hi"], "left").join(spans, package)
    low, high = F.coalesce("lo_rank", "first"), F.coalesce("hi_rank", "end")
    covered = apart(placed.select(*package, "id", low.alias("low"), high.alias("high")).filter("low < high"))
    blocks = stored(covered.select("id", "low", "high", F.explode(met_blocks(F.col("low"), F.col("high"))).alias("b")).select(
        "id", "low", "high", "b.level", "b.node"), "advisory-blocks")
    points = keyed.join(ranks, [*package, "k"]).select(
        *package, "version", "rank", F.explode(F.array(F.lit(FINE), F.lit(COARSE))).alias("level")).withColumn(
        "node", F.call_function("shiftright", "rank", "level"))
    inside = points.join(blocks, ["level", "node"]).filter("low <= rank AND rank < high").select(*package, "version", "id")
    # A version without a key lies in ranges without bounds only.
    unkeyed = keyed.filter("k IS NULL").join(
        bounds.filter("lo IS NULL AND hi IS NULL").select(*package, "id").distinct(), package).select(*package, "version", "id")
    return inside.unionByName(unkeyed)


def direct_hits(coords: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same by comparing every version with every range of its package."""
    return coords.join(ranges, ["ecosystem", "package"]).filter(
        in_range(F.col("version"), F.col("introduced"), F.col("fixed"))).select("ecosystem", "package", "version", "id").distinct()


def range_hits(coords: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, package, version, id): small packages directly, those with many versions and ranges by ranks."""
    package = ["ecosystem", "package"]
    coords, ranges = stored(coords, "advisory-coords"), stored(ranges, "advisory-bounds")
    pairs = coords.groupBy(*package).agg(F.count(F.lit(1)).alias("v")).join(
        ranges.groupBy(*package).agg(F.count(F.lit(1)).alias("r")), package)
    large = stored(pairs.filter(F.col("v") * F.col("r") > DIRECT_PAIRS).select(*package), "advisory-large")
    if large.isEmpty():
        return direct_hits(coords, ranges)
    only = lambda rows, how: rows.join(large, package, how)
    return direct_hits(only(coords, "left_anti"), only(ranges, "left_anti")).unionByName(
        ranked_hits(only(coords, "left_semi"), only(ranges, "left_semi")))


def preferred_id(advisory_id: Column, aliases: Column) -> Column:
    every = F.concat(F.array(advisory_id), F.coalesce(aliases, F.array().cast("array<string>")))
    cve = F.get(F.filter(every, lambda x: x.startswith("CVE-")), F.lit(0))
    return F.coalesce(cve, advisory_id)


def other_ids(advisory_id: Column, aliases: Column) -> Column:
    every = F.concat(F.array(advisory_id), F.coalesce(aliases, F.array().cast("array<string>")))
    shown = preferred_id(advisory_id, aliases)
    return F.array_sort(F.filter(every, lambda x: x != shown))


def scored(advisories: DataFrame) -> DataFrame:
    """Add display id, aliases, score, vector and severity to each advisory.

    The first usable v3 vector of an advisory is scored; without one the first vector is
    shown and the advisory's text decides the severity.
    """
    vectors = advisories.select("id", F.posexplode("severity").alias("n", "s")).select(
        "id", "n", F.col("s.score").alias("vector"))
    v3 = (
        add_cvss3_score(vectors.filter(F.col("vector").startswith("CVSS:3")))
        .groupBy("id")
        # Unusable vectors have no place in the order. A filter on the score would be pushed below the
        # projections and inline the whole formula.
        .agg(F.min_by(F.struct("score", "vector"), F.when(F.col("score").isNotNull(), F.col("n"))).alias("v3"))
    )
    shown = F.get(F.filter("severity", lambda s: s["score"] != ""), F.lit(0))["score"]
    known = F.col("v3.score").isNotNull()
    return (
        advisories.join(v3, "id", "left")
        .withColumns({
            "vuln_id": preferred_id(F.col("id"), F.col("aliases")),
            "alias_ids": other_ids(F.col("id"), F.col("aliases")),
            "score": F.coalesce("v3.score", F.lit(0.0)),
            "vector": F.coalesce("v3.vector", shown, F.lit("")),
            "cve_severity": F.when(known, severity_from_score(F.col("v3.score"))).otherwise(
                severity_from_text(F.col("db_severity"))),
        })
        .drop("v3")
    )


def fixed_events(advisories: DataFrame) -> DataFrame:
    """Every ``fixed`` event in encounter order."""
    return (
        advisories.select("id", F.posexplode("ranges").alias("range_no", "r"))
        .select("id", "range_no", F.col("r.type").alias("type"), F.posexplode("r.events").alias("event_no", "e"))
        .withColumn("fixed", F.try_element_at("e", F.lit("fixed")))
        .filter(F.coalesce("fixed", F.lit("")) != "")
        .select("id", "range_no", "event_no", "type", "fixed")
    )


def fix_candidates(advisories: DataFrame) -> DataFrame:
    """Per advisory the ordered fixes, so the pick per installed version is a narrow step.

    An advisory's events are one record of the advisory source: the arrays are as long as
    that record, not as long as the data.
    """
    spots = F.struct("range_no", "event_no", "fixed")
    return fixed_events(advisories).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") != "GIT", spots))).alias("releases"),
        F.min(F.when(F.col("type") == "GIT", spots))["fixed"].alias("git_fix"),
    )


def pick_fix(releases: Column, git_fix: Column, installed: Column) -> Column:
    """Smallest fix above the installed version, else the first release fix, else the commit."""
    v = version_key(installed)
    above = F.filter(releases, lambda r: version_key(r["fixed"]) > v)
    best = F.array_min(F.transform(
        above, lambda r: F.struct(version_key(r["fixed"]).alias("k"), r["range_no"].alias("a"),
                                  r["event_no"].alias("b"), r["fixed"].alias("f"))
    ))["f"]
    return F.coalesce(best, F.get(releases, F.lit(0))["fixed"], git_fix, F.lit(""))


KEYS = ["scan_id", "component_id"]
PLACE = ["ecosystem", "package", "version"]


def coordinate_answers(checked: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, package, version, advisory) with its facts and the fix for that version, once per distinct coordinate."""
    # Few versions and ranges can give many hits: they are dealt anew before fixes are picked.
    hits = range_hits(checked.select(*PLACE).distinct(), version_ranges(advisories)).repartition(*PLACE, "id")
    facts = scored(advisories).select(
        "id", "vuln_id", "alias_ids", "score", "vector", F.col("cve_severity").alias("severity"), "summary"
    ).join(fix_candidates(advisories), "id", "left")
    return hits.join(facts, "id").withColumn(
        "fixed", pick_fix(F.coalesce("releases", F.array().cast(
            "array<struct<range_no:int,event_no:int,fixed:string>>")), F.col("git_fix"), F.col("version"))
    ).drop("releases", "git_fix")


def match_advisories(component_rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """(component, advisory) matches, before deduplication.

    One popular package at one version may sit in every scan. Range checks, scoring and fix
    picks therefore run on distinct (ecosystem, package, version) coordinates, which a
    partial aggregate reduces before the shuffle; the answers are joined back to components
    on the whole coordinate, a join adaptive execution can split on its hot side.
    """
    checked = stored(coordinate(component_rows), "advisory-checked")
    return checked.join(coordinate_answers(checked, advisories), PLACE)


def merge_advisories(matches: DataFrame, by: list[str], *further: Column) -> DataFrame:
    """One row per ``by`` and display id: most severe score, best fix, first summary, all aliases.

    Advisories of one display id are taken in id order. The alias set is as large as the advisories naming one vulnerability.
    """
    severe = F.struct((-F.col("score")).alias("a"), (-severity_rank(F.col("severity"))).alias("b"), "id")
    order = F.col("id")
    fix = F.col("fixed")
    merged = matches.groupBy(*by, "vuln_id").agg(
        F.min_by(F.struct("severity", "score", "vector"), severe).alias("s"),
        F.min_by("fixed", F.struct((~version_shaped(fix)).alias("a"), (fix == "").alias("b"), order)).alias("fixed"),
        F.min_by("summary", F.when(F.coalesce("summary", F.lit("")) != "", order)).alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("alias_ids")))).alias("aliases"),
        F.min("id").alias("advisory_id"),
        *further,
    )
    return merged.withColumns({
        "aliases": F.filter("aliases", lambda a: a != F.col("vuln_id")), "severity": F.col("s.severity"), "score": F.col("s.score"),
        "vector": F.col("s.vector"), "summary": F.coalesce("summary", F.lit(""))}).drop("s")


VULNS = [*KEYS, "name", "version", "vuln_id", "advisory_id", "aliases", "severity", "score", "vector", "summary", "fixed"]


def dedupe_advisories(matches: DataFrame) -> DataFrame:
    """One row per (component, display id)."""
    return merge_advisories(matches, KEYS, F.max("name").alias("name"), F.max("version").alias("version")).select(*VULNS)


def component_vulns(component_rows: DataFrame, advisories: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """One row per (component, display id).

    Components at one coordinate have the same answers, so these are deduplicated once per coordinate and then joined to the
    components: the rows of all components, the result, cross no shuffle. The few components with several coordinates
    (an id that repeats, or null) are deduplicated over their own matches.

    ``beside`` is joined by scan and component, as to the result, but before the answers multiply the rows.
    """
    checked = stored(coordinate(component_rows).filter("version IS NOT NULL"), "advisory-checked")
    answers = stored(coordinate_answers(checked, advisories), "advisory-answers")
    place = F.struct(*PLACE)
    members = stored(checked.groupBy(*KEYS).agg(
        F.max("name").alias("name"), F.min(place).alias("place"), F.max(place).alias("last")), "advisory-members")
    one, more = members.filter("place = last"), members.filter("place <> last").select(*KEYS)
    joined = (lambda rows: rows) if beside is None else (lambda rows: rows.join(beside, KEYS))
    columns = VULNS if beside is None else [*VULNS, *(c for c in beside.columns if c not in KEYS)]
    shared = joined(one.select(*KEYS, "name", "place.*")).join(merge_advisories(answers, PLACE), PLACE).select(*columns)
    left, right = checked.alias("l"), more.alias("r")
    own = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS], "left_semi").join(answers, PLACE)
    return shared.unionByName(joined(dedupe_advisories(own)).select(*columns))


def unchecked(component_rows: DataFrame, checked_purls: DataFrame) -> DataFrame:
    """Components whose package URL should have been checked and was not."""
    want = component_rows.filter(queryable(F.col("purl"))).select("scan_id", "component_id", "purl")
    return want.join(checked_purls.select("purl").distinct(), "purl", "left_anti")


def check_coverage(component_rows: DataFrame, checked_purls: DataFrame) -> DataFrame:
    """Per scan: components that could not be checked, of those that should be."""
    want = component_rows.filter(queryable(F.col("purl"))).groupBy("scan_id").agg(F.count("*").alias("queryable"))
    missed = unchecked(component_rows, checked_purls).groupBy("scan_id").agg(F.count("*").alias("unchecked"))
    return want.join(missed, "scan_id", "left").withColumn("unchecked", F.coalesce("unchecked", F.lit(0)))
