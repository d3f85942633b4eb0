import pytest
from pyspark.sql import functions as F

from aicensus.operators import controls, gate


@pytest.mark.parametrize("text", [
    "", "hosted-llm |", "nope", "confidence>=2", "risk:nope", "cve:unknown", "compliance:x", "compliance & library",
    "confidence", "application", "compliance:nist-ai-rmf:NOPE",
])
def test_bad_gates(spark, text):
    with pytest.raises(ValueError):
        gate.parse_gate(text)


def test_verdicts(spark):
    comps = spark.createDataFrame(
        [("s", "root", "application", 1.0, []), ("s", "a", "library", 0.5, ["high", "pickle-import"]), ("t", "b", "prompt", 0.9, [])],
        "scan_id string, component_id string, kind string, confidence double, risk_tags array<string>")
    scans = comps.select("scan_id").distinct()
    run = lambda g: {r["scan_id"] for r in gate.gate_verdicts(g, comps, scans).filter("tripped").collect()}
    assert run(gate.parse_gate("library & confidence>=0.9")) == set()
    assert run(gate.parse_gate("pickle-risk | prompt & confidence=0.9")) == {"s", "t"}
    assert run(gate.parse_gate("risk:high")) == {"s"}
    assert run(gate.match_any()) == {"s", "t"}
    with pytest.raises(ValueError):
        gate.gate_verdicts(gate.parse_gate("cve"), comps, scans)
    coverage = scans.withColumn("unchecked", F.lit(1))
    vulns = spark.createDataFrame([], "scan_id string, component_id string, severity string")
    with pytest.raises(Exception, match="unchecked"):
        gate.gate_verdicts(gate.parse_gate("cve"), comps, scans, vulns, coverage=coverage).collect()


def test_control_expression(spark):
    rows = spark.createDataFrame([("library", ["high"]), ("prompt", [])], "kind string, risk_tags array<string>")
    assert rows.filter(controls.expression("* & risk:high | prompt")).count() == 2
    with pytest.raises(ValueError):
        controls.expression("library &")
    with pytest.raises(ValueError):
        controls.shipped_controls(spark, ["nope"])
