"""The native inventory as JSON, and writing several projections from one inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence_number
from ..plans.pipeline import Inventory

# Record types of the JSON document, in document order.
TABLES = [
    ("scan", "scans"), ("component", "components"), ("occurrence", "occurrences"), ("claim", "claims"),
    ("license", "licenses"), ("hash", "hashes"), ("risk", "risks"), ("param", "params"), ("edge", "edges"),
    ("vulnerability", "vulns"), ("control", "outcomes"), ("unknown", "unknowns"), ("risk_detail", "risk_details"),
    ("edge_evidence", "edge_evidence"), ("control_evidence", "control_evidence"), ("warning", "warnings"),
    ("scan_stats", "stats"), ("detector_stats", "detector_stats"),
]


def table_records(inv: Inventory, attr: str) -> DataFrame | None:
    """One table's rows as JSON: (scan_id, owner, record); None where the inventory has no such table."""
    df = getattr(inv, attr)
    if df is None:
        return None
    if "confidence" in df.columns:
        df = df.withColumn("confidence", confidence_number(F.col("confidence")))
    body = [c for c in df.columns if c not in ("scan_id", "cls", "disc", "finding_seq", "declared_name")]
    owner = next((c for c in ("component_id", "from_id", "path", "control") if c in df.columns), None)
    return df.select("scan_id", (F.col(owner) if owner else F.lit("")).alias("owner"), F.to_json(F.struct(*body)).alias("record"))


def json_records(inv: Inventory) -> DataFrame:
    """Every inventory row as one JSON line: (scan_id, section, record_type, owner, record).

    A scan's records in (section, owner, record) order are what ``documents`` writes as one JSON document.
    """
    out = None
    for section, (kind, attr) in enumerate(TABLES):
        rows = table_records(inv, attr)
        if rows is not None:
            rows = rows.select("scan_id", F.lit(section).alias("section"), F.lit(kind).alias("record_type"), "owner", "record")
            out = rows if out is None else out.unionByName(rows)
    return out


def write_json(inv: Inventory, path: str, buckets: int = 64) -> None:
    """JSON lines in folders of scans (``bucket``); each scan's records are sorted.

    Range partitioning on the full sort key cuts a large scan into several files whose names
    keep the document order. A folder holds many scans, so files stay few and large.
    """
    rows = json_records(inv).withColumn("bucket", F.pmod(F.xxhash64("scan_id"), F.lit(buckets)))
    order = ["bucket", "scan_id", "section", "owner", "record"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("bucket").json(path)


def write_all(outputs: dict[str, tuple[DataFrame, str]], writer: Callable | None = None) -> None:
    """Write several projections, format by format; all read the inventory's stored tables."""
    for fmt, (df, path) in outputs.items():
        if writer is not None:
            writer(fmt, df, path)
        else:
            df.write.mode("errorifexists").format("parquet" if fmt == "tables" else "json").save(path)
