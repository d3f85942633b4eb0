"""Whole documents from fragments, whatever the ranges."""
import json

import pytest
from aicensus.plans import pipeline
from aicensus.reports import documents
from helpers import findings, sighting
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def inventory(spark):
    model = dict(task="t", architecture="llama", param_count=7, quantization=None, context_length=None, format=None, base_model=None)
    rows = [sighting(i, name=f"n{i % 4}", path=f'p"{i % 3}\n', line=i, snippet='say "hi"\t\\', version=f"1.{i % 2}", provider="Ü",
                     hashes=[dict(alg="SHA-256", hex=f"AB{i % 2}")] if i % 2 else None, method="config-analysis") for i in range(40)]
    rows += [sighting(50, scan_id="t", kind="dataset", name="d", download_location="http://x"), sighting(51, scan_id="t", kind="local-model-file", name="w", model=model)]
    f = findings(spark, rows)
    scans = spark.createDataFrame([("s", "dir", "/a"), ("t", "dir", "/b"), ("empty", "dir", 'c"')], "scan_id string, kind string, target string")
    return pipeline.build(f, scans)


def texts(pieces):
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["part"], r["at"])):
        out[r["scan_id"]] = out.get(r["scan_id"], "") + r["text"]
    return out


@pytest.mark.parametrize("ranges", ["1", "3", "40"])
def test_documents_are_valid_json(spark, inventory, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        native = {k: json.loads(v) for k, v in texts(documents.fragments(documents.native_leaves(inventory))).items()}
        cdx = {k: json.loads(v) for k, v in texts(documents.fragments(documents.cyclonedx_leaves(inventory))).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(native) == set(cdx) == {"s", "t", "empty"} and native["s"]["scan_id"] == "s"
    for scan, doc in native.items():
        for name in ("components", "occurrences", "claims", "hashes"):
            assert len(doc.get(name, [])) == getattr(inventory, name).filter(F.col("scan_id") == scan).count(), (scan, name)
    named = {c["name"]: c for c in cdx["s"]["components"]}
    assert {"n0", "n1", "n2", "n3"} <= set(named) and "hashes" not in named["n0"] and named["n1"]["hashes"][0]["alg"] == "SHA-256"
    places = named["n1"]["evidence"]["occurrences"]
    assert [p["line"] for p in sorted(places, key=lambda p: p["line"])] == list(range(1, 40, 4))
    assert places[0]["additionalContext"] == 'say "hi"\t\\' and places == sorted(places, key=lambda p: (p["location"], p["line"]))
    assert {m["technique"] for i in named["n1"]["evidence"]["identity"] for m in i["methods"]} == {"other"}
    assert cdx["t"]["metadata"]["component"]["name"] == "/b" and cdx["empty"]["metadata"]["component"]["name"] == 'c"'
    assert next(c for c in cdx["t"]["components"] if c["name"] == "d")["externalReferences"] == [{"type": "distribution", "url": "http://x"}]


def test_written_documents(spark, inventory, tmp_path):
    pieces = documents.fragments(documents.cyclonedx_leaves(inventory))
    documents.write_documents(pieces, str(tmp_path / "out"))
    want = {k: json.loads(v) for k, v in texts(pieces).items()}
    for scan, doc in want.items():
        files = sorted((tmp_path / "out" / f"scan_id={scan}").glob("part-*.txt"))
        assert json.loads("".join(f.read_text() for f in files)) == doc


@pytest.mark.parametrize("size", [1, 17, 100_000])
def test_blocks_are_the_text(spark, inventory, size):
    pieces = documents.fragments(documents.native_leaves(inventory, ["scans", "components"]))
    blocks = documents.text_blocks(pieces, size).collect()
    for scan, text in texts(pieces).items():
        mine = sorted((r for r in blocks if r["scan_id"] == scan), key=lambda r: r["block"])
        assert [r["text"] for r in mine] == [text[i:i + size] for i in range(0, len(text), size)]


def test_no_scan_is_one_value(spark, inventory):
    plan = documents.fragments(documents.native_leaves(inventory))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "windowspecdefinition(scan_id" not in plan
