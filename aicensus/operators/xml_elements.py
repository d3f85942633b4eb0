"""Elements of XML files as rows: attributes, texts of direct children, line. One Arrow pass with the standard parser.

Names are compared without namespace prefixes; entities and CDATA are read as their text; an element inside one of the
same name is part of it. What stands before an error in a file is kept, and the error is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

ELEMENTS = "scan_id string, path string, line int, raw string, attributes map<string,string>, children map<string,string>, error string"
_ARROW = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("raw", pa.string()),
                    ("attributes", pa.map_(pa.string(), pa.string())), ("children", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def _local(name: str) -> str:
    return name.rpartition(":")[2]


class _Reader:
    """The elements of one name in one file, in the order of their ends."""

    def __init__(self, raw: bytes, tag: str):
        self.raw, self.tag = raw, tag
        self.found: list[dict] = []
        self.open: dict | None = None  # the element being read, from its start tag on
        self.depth = 0
        self.child: str | None = None
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text
        self.parser.DefaultHandler = lambda _: self.behind()

    def behind(self) -> None:
        """The event after a start tag tells where the tag ended."""
        if self.open is not None and self.open["end"] is None:
            self.open["end"] = self.parser.CurrentByteIndex

    def start(self, name: str, attributes: dict) -> None:
        self.behind()
        if self.open is not None:
            self.depth += 1
            if self.depth == 1:
                self.child = _local(name)
                self.open["children"][self.child] = ""  # of repeated children the last counts
        elif _local(name) == self.tag:
            self.open = {"at": self.parser.CurrentByteIndex, "end": None, "children": {},
                         "attributes": {_local(k): v for k, v in attributes.items() if not k.startswith("xmlns")}}

    def text(self, data: str) -> None:
        self.behind()
        if self.child is not None and self.depth == 1:
            self.open["children"][self.child] += data

    def end(self, name: str) -> None:
        self.behind()
        if self.open is None:
            return
        if self.depth:
            self.depth -= 1
            if self.depth == 0:
                self.child = None
            return
        self.found.append(self.open)
        self.open = None

    def rows(self) -> Iterator[dict]:
        error = None
        try:
            self.parser.Parse(self.raw, True)
        except (expat.ExpatError, ValueError) as failed:
            error = f"the XML does not parse: {failed}"
        for e in self.found:
            stop = self.raw.find(b"\n", e["at"])
            shown = self.raw[e["at"]:stop if stop >= 0 else len(self.raw)]
            yield {"line": self.raw.count(b"\n", 0, e["end"]) + 1, "raw": shown.decode("utf-8", "replace").rstrip("\r"),
                   "attributes": list(e["attributes"].items()), "children": list(e["children"].items())}
        if error is not None:
            yield {"error": error}


def xml_elements(files: DataFrame, tag: str) -> DataFrame:
    """Rows of the elements named ``tag`` (see ELEMENTS), and one row with ``error`` per file that breaks off."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scan, path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if raw:
                    rows += [{"scan_id": scan, "path": path, **row} for row in _Reader(raw, tag).rows()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)

    ship_package(files.sparkSession)
    return files.select("scan_id", "path", "content").mapInArrow(run, ELEMENTS)
