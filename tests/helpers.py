"""Rows for tests of more than one module."""

from aicensus.schemas import FINDINGS, struct_type


def files_frame(spark, rows):
    """(scan_id, path, bytes or text) rows as a files table."""
    data = [(s, p, len(c), None, bytearray(c.encode() if isinstance(c, str) else c)) for s, p, c in rows]
    return spark.createDataFrame(
        data, "scan_id string, path string, size bigint, mod_time timestamp, content binary")


def findings(spark, rows):
    names = [f.name for f in struct_type(FINDINGS).fields]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, FINDINGS)


def sighting(i, **kw):
    base = dict(scan_id="s", finding_seq=i, kind="library", name="x", provider="", ecosystem="", path="a", line=1, col=1,
                detector_id="d", method="source-code-analysis", confidence=0.7, snippet="")
    return {**base, **kw}
