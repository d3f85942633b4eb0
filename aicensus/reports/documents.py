"""One valid JSON document per scan, as sorted fragments that many tasks write.

A document is a tree of six levels: scan, section, owner (an object of a section), group and array inside the owner, item. Every
row is a leaf and names, for each level, the text that opens and closes it. In the sorted order a row opens the levels in
which it differs from the row before and closes those in which it differs from the row behind; the neighbours across the
borders of ranges come from one narrow table of first and last rows. So no scan, however large, is one task or one value, and
the fragments of a scan, one after the other, are its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.pipeline import Inventory
from ..session import ship_package, stored
from . import cyclonedx
from .inventory import TABLES, table_records

LEVELS = ["scan_id", "section", "owner", "grp", "array", "item"]
_TYPES = {"scan_id": "string", "section": "int", "owner": "string", "grp": "int", "array": "int", "item": "string"}


def leaf(rows: DataFrame, *, section: int, opens: dict[str, Column | str], closes: dict[str, str], owner: Column | None = None,
         grp: int = 0, array: int = 0, item: Column | None = None) -> DataFrame:
    """Rows of a document's leaves; ``opens`` and ``closes`` hold the texts of the levels that have some."""
    text = lambda t: F.lit(t) if isinstance(t, str) else t
    level = {"section": F.lit(section), "owner": F.lit("") if owner is None else owner, "grp": F.lit(grp), "array": F.lit(array),
             "item": F.lit("") if item is None else item}
    return rows.select(
        "scan_id", *(level[n].cast(_TYPES[n]).alias(n) for n in LEVELS[1:]),
        F.array(*(text(opens.get(n, "")) for n in LEVELS)).alias("opens"), F.array(*(F.lit(closes.get(n, "")) for n in LEVELS)).alias("closes"))


def _common(a: Column, b: Column) -> Column:
    """How many levels, from the scan on, two rows share."""
    out = F.lit(len(LEVELS))
    for i, n in reversed(list(enumerate(LEVELS))):
        out = F.when(~a[n].eqNullSafe(b[n]), F.lit(i)).otherwise(out)
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(out)


def fragments(leaves: DataFrame) -> DataFrame:
    """scan_id, part, at, text: a scan's document is its texts in (part, at) order."""
    ship_package(leaves.sparkSession)
    n = len(LEVELS)
    shape = pa.schema([*((x, pa.int32() if _TYPES[x] == "int" else pa.string()) for x in LEVELS), ("opens", pa.list_(pa.string())),
                       ("closes", pa.list_(pa.string())), ("part", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("behind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before, held = TaskContext.get().partitionId(), 0, None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    shared = next((i for i in range(n) if row[i] != held[i]), n)
                    rows.append((*held, part, at, before, shared))
                    at, before = at + 1, shared
                held = row
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(*held, part, at, before, None)])

    ddl = ", ".join(f"{x} {_TYPES[x]}" for x in LEVELS) + ", opens array<string>, closes array<string>, part long, at long, before int, behind int"
    rows = stored(leaves.repartitionByRange(*LEVELS).sortWithinPartitions(*LEVELS).mapInArrow(run, ddl), "fragments")
    # Two rows a range at most: their neighbours lie in other ranges.
    key = F.struct(*LEVELS)
    order = W.orderBy("part", "at")
    ends = rows.filter("before IS NULL OR behind IS NULL").select("part", "at", key.alias("k"))
    ends = ends.select("part", "at", _common(F.lag("k").over(order), F.col("k")).alias("b0"), _common(F.lead("k").over(order), F.col("k")).alias("b1"))
    joined = rows.join(F.broadcast(ends), ["part", "at"], "left")
    depth = lambda known, found: F.least(F.coalesce(known, found), F.lit(n - 1))  # noqa: E731 - an item is always one of its own
    joined = joined.select("scan_id", "part", "at", "opens", "closes", depth("before", "b0").alias("before"), depth("behind", "b1").alias("behind"))
    head = F.array_join(F.slice("opens", F.col("before") + 1, n - F.col("before")), "")
    tail = F.array_join(F.reverse(F.slice("closes", F.col("behind") + 1, n - F.col("behind"))), "")
    return joined.select("scan_id", "part", "at", F.concat(F.when(F.col("before") > 0, ",").otherwise(""), head, tail).alias("text"))


def positioned(pieces: DataFrame) -> DataFrame:
    """The fragments with ``start``, the characters of their document in front of them: sums inside a range, and of the ranges before."""
    lengths = pieces.select("scan_id", "part", "at", F.length("text").cast("bigint").alias("n"))
    ahead = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    sums = lengths.groupBy("scan_id", "part").agg(F.sum("n").alias("n"))
    sums = sums.select("scan_id", "part", F.coalesce(F.sum("n").over(ahead("scan_id").orderBy("part")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(ahead("scan_id", "part").orderBy("at")), F.lit(0))
    starts = lengths.select("scan_id", "part", "at", inside.alias("_in")).join(sums, ["scan_id", "part"]).select(
        "part", "at", (F.col("_before") + F.col("_in")).alias("start"))
    return pieces.join(starts, ["part", "at"])


def text_blocks(pieces: DataFrame, size: int) -> DataFrame:
    """scan_id, block, text: the documents in blocks of ``size`` characters, whatever their fragments."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("text") - 1) / size)
    cut = positioned(pieces).filter("text <> ''").select("scan_id", "start", "text", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * size - F.col("start"), F.lit(0)).cast("int")
    end = F.least(F.col("block") * size + size - F.col("start"), F.length("text")).cast("int")
    parts = cut.select("scan_id", "block", F.struct("start", F.substring("text", begin + 1, end - begin).alias("text")).alias("p"))
    return parts.groupBy("scan_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("text"))


def write_documents(pieces: DataFrame, path: str) -> None:
    """One folder per scan; the texts of its files, in the order of their names, are the scan's document."""
    order = ["scan_id", "part", "at"]
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("scan_id", "text").write.mode("errorifexists").partitionBy(
        "scan_id").text(path)


def _header(text: str) -> dict[str, Column | str]:
    """The opening text of a scan, which ends with a comma: its sections follow."""
    own = F.to_json(F.struct("scan_id"))
    return {"scan_id": F.concat(F.lit("{" + text), F.substring(own, F.lit(2), F.length(own) - 2), F.lit(","))}


def _json_string(value: Column) -> Column:
    """A text as a JSON string."""
    inside = F.to_json(F.struct(value.alias("v")))
    return F.substring(inside, F.lit(6), F.length(inside) - 6)


def _object_head(json: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def native_leaves(inv: Inventory, tables: list[str] | None = None) -> DataFrame:
    """The inventory's tables as sections of arrays, in document order."""
    parts = []
    for section, (kind, attr) in enumerate(TABLES):
        if (tables is None or attr in tables) and (rows := table_records(inv, attr)) is not None:
            parts.append(leaf(
                rows, section=section, owner=F.col("owner"), item=F.col("record"),
                opens={**_header(""), "section": f'"{attr}":[', "item": F.col("record")}, closes={"scan_id": "}", "section": "]"}))
    return reduce(DataFrame.unionByName, parts)


_SECTIONS = ["metadata", "components", "dependencies", "vulnerabilities", "declarations"]


def cyclonedx_leaves(inv: Inventory, sections: list[str] | None = None) -> DataFrame:
    """CycloneDX documents: components with their nested arrays, dependencies, vulnerabilities, claims."""
    begin, wanted = '"bomFormat":"CycloneDX","specVersion":"1.6",', sections or _SECTIONS
    number = {n: i for i, n in enumerate(_SECTIONS)}
    close = {"scan_id": "}", "section": "]"}
    parts: list[DataFrame] = []

    def section(name: str, rows: DataFrame, **kw) -> DataFrame:
        opens = {**_header(begin), "section": f'"{name}":[', **kw.pop("opens")}
        return leaf(rows, section=number[name], opens=opens, closes={**close, **kw.pop("closes", {})}, **kw)

    def nested(name: str, rows: DataFrame, ref: str, grp: int, array: int, label: str, item: Column, order: Column | None = None, wrap: str = "") -> DataFrame:
        """An array inside an object of a section, perhaps inside an object of its own (``wrap``)."""
        opens = {"grp": f'"{wrap}":{{' if wrap else "", "array": f'"{label}":[', "item": item}
        return section(name, rows, owner=F.col(ref), grp=grp, array=array, item=item if order is None else order, opens=opens,
                       closes={"owner": "}", "grp": "}" if wrap else "", "array": "]"})

    def objects(name: str, rows: DataFrame, ref: str, json: Column) -> DataFrame:
        return section(name, rows, owner=F.col(ref), opens={"owner": _object_head(json)}, closes={"owner": "}"})

    if "metadata" in wanted:
        parts.append(leaf(inv.scans, section=0, opens={**_header(begin), "section": F.concat(
            F.lit('"metadata":'), F.to_json(F.struct(F.struct(F.lit("application").alias("type"), F.col("target").alias("name")).alias("component"))))},
            closes={"scan_id": "}"}))
    if "components" in wanted:
        rows = cyclonedx.components(inv.components)
        blank = lambda c: F.nullif(F.col(c), F.lit(""))
        data = F.when(F.col("data_type").isNotNull(), F.array(F.struct(F.col("data_type").alias("type"), "name", F.when(
            F.col("data_url").isNotNull(), F.struct(F.col("data_url").alias("url"))).alias("contents"))))
        refs = F.when(blank("distribution_url").isNotNull(), F.array(F.struct(F.lit("distribution").alias("type"), F.col("distribution_url").alias("url"))))
        parts.append(objects("components", rows, "bom_ref", F.to_json(F.struct(
            F.col("bom_ref").alias("bom-ref"), "type", "name", blank("group").alias("group"), blank("version").alias("version"), blank("purl").alias("purl"),
            refs.alias("externalReferences"), data.alias("data")))))
        parts.append(nested("components", cyclonedx.hashes(inv.hashes), "bom_ref", 1, 0, "hashes", F.to_json(F.struct("alg", "content"))))
        if inv.licenses is not None:
            said = F.when(F.col("form") == "expression", F.to_json(F.struct(F.col("value").alias("expression")))).when(
                F.col("form") == "id", F.to_json(F.struct(F.struct(F.col("value").alias("id")).alias("license")))).otherwise(
                F.to_json(F.struct(F.struct(F.col("value").alias("name")).alias("license"))))
            parts.append(nested("components", cyclonedx.licenses(inv.licenses), "bom_ref", 2, 0, "licenses", said))
        places = cyclonedx.evidence_occurrences(inv.occurrences)
        spot = F.concat_ws("\0", "location", F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 10, "0"), F.coalesce("symbol", F.lit("")),
                           F.coalesce("additional_context", F.lit("")))
        parts.append(nested("components", places, "bom_ref", 3, 0, "occurrences", F.to_json(F.struct(
            "location", "line", blank("symbol").alias("symbol"), blank("additional_context").alias("additionalContext"))), spot, "evidence"))
        parts.append(nested("components", cyclonedx.evidence_identity(inv.claims), "bom_ref", 3, 1, "identity", F.to_json(F.struct(
            "field", F.col("concluded_value").alias("concludedValue"), "confidence",
            F.array(F.struct("technique", "confidence", F.col("method_value").alias("value"))).alias("methods"))), None, "evidence"))
        held = cyclonedx.properties(inv.components, inv.edges, inv.params, inv.risks, inv.risk_details)
        parts.append(nested("components", held, "bom_ref", 4, 0, "properties", F.to_json(F.struct("name", "value")),
                            F.concat_ws("\0", "name", "value")))
    if "dependencies" in wanted:
        pairs = cyclonedx.dependencies(inv.edges)
        parts.append(objects("dependencies", pairs.select("scan_id", "ref").distinct(), "ref", F.to_json(F.struct("ref"))))
        parts.append(nested("dependencies", pairs, "ref", 1, 0, "dependsOn", _json_string(F.col("depends_on"))))
    if "vulnerabilities" in wanted:
        found = cyclonedx.vulnerabilities(inv.risks, inv.risk_details, inv.vulns)
        parts.append(section("vulnerabilities", found, owner=F.col("affects"), item=F.concat_ws("\0", "id", "source"), opens={"item": F.to_json(F.struct(
            "id", F.struct(F.col("source").alias("name")).alias("source"), F.array(F.struct("score", "severity", "method", "vector")).alias("ratings"),
            "description", F.array(F.struct(F.col("affects").alias("ref"))).alias("affects")))}))
    if "declarations" in wanted and inv.outcomes is not None:
        claims = cyclonedx.declarations(inv.outcomes)
        parts.append(section("declarations", claims, owner=F.col("claim_ref"), opens={"owner": F.to_json(F.struct(
            F.col("claim_ref").alias("bom-ref"), "requirement", "score", "rationale"))}))
    return reduce(DataFrame.unionByName, parts)
