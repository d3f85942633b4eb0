import random

import pytest
from aicensus.operators import assemble, graph
from aicensus.plans import pipeline
from aicensus.schemas import FINDINGS, conform, struct_type
from helpers import findings, sighting


@pytest.mark.parametrize("rows, want", [
    ([dict(line=i, confidence=0.85) for i in range(12)], 0.8725),
    ([dict(method="filename", confidence=0.5), dict(method="binary-analysis", confidence=0.95, line=2)], 0.975),
    ([dict(method=m, confidence=0.98, line=i) for i, m in enumerate(["filename", "config-analysis", "ast-fingerprint"])], 0.99),
    ([dict(method="hash-comparison", confidence=1.0)], 1.0),
])
def test_confidence(spark, rows, want):
    f = findings(spark, [sighting(i, **r) for i, r in enumerate(rows)])
    s = assemble.sightings(assemble.key_findings(f))
    assert assemble.confidences(assemble.occurrences(s)).first()["confidence"] == pytest.approx(want)


def test_adjacent_dedupe(spark):
    spots = [("a", 1, 1, "A"), ("a", 1, 5, "B"), ("a", 1, 9, "A"), ("b", 1, 1, "A"), ("b", 1, 2, "A")]
    f = findings(spark, [sighting(i, path=p, line=n, col=c, detector_id=d) for i, (p, n, c, d) in enumerate(spots)])
    assert assemble.occurrences(assemble.sightings(assemble.key_findings(f))).count() == 4


def test_folds_refuse_ambiguity(spark):
    f = findings(spark, [
        sighting(1, name="openai", provider="OpenAI"), sighting(2, name="openai", provider="OpenAI", ecosystem="pypi"),
        sighting(3, name="redis"), sighting(4, name="redis", ecosystem="pypi"), sighting(5, name="redis", ecosystem="npm"),
        sighting(6, kind="hosted-llm", name="gpt"), sighting(7, kind="hosted-llm", name="gpt", provider="openai"),
    ])
    d = assemble.drafts(assemble.key_findings(f))
    assert assemble.redirects(d).count() == 2


def test_unfolded_facets_and_conflict(spark):
    model = lambda a: dict(task=None, architecture=a, param_count=None, quantization=None, context_length=None, format=None, base_model=None)
    f = findings(spark, [
        sighting(1, kind="hosted-llm", name="gpt", provider="openai", model=model("a")),
        sighting(2, kind="hosted-llm", name="gpt", provider="openai", model=model("b")),
        sighting(3, kind="hosted-llm", name="gpt", model=model("c")),
    ])
    row = assemble.facets(assemble.sightings(assemble.key_findings(f))).first()
    assert row["model_architecture"]["p"] == "unknown" and row["model_task"]["p"] == "absent"


def test_order_and_skew_independence(spark):
    """Shuffled, repartitioned input, with one component holding a third of all rows."""
    rows = [sighting(i, name="hot" if i % 3 == 0 else f"n{i % 7}", path=f"p{i % 5}", line=i % 11, col=i % 2,
                     detector_id=f"d{i % 3}", confidence=(30 + i % 60) / 100, version=f"1.{i % 3}") for i in range(300)]

    def build(data, parts):
        s = assemble.sightings(assemble.key_findings(findings(spark, data).repartition(parts)))
        cols = ["component_id", "kind", "name", "version", "confidence", "n_occurrences"]
        return sorted(map(tuple, assemble.components(s).select(*cols).collect()))

    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    assert build(rows, 1) == build(shuffled, 7)


def test_self_edges_and_ambiguous_targets(spark):
    rel = lambda kind, name: [dict(type="uses", target_kind=kind, name=name, from_field=None, local_ref=None)]
    f = findings(spark, [
        sighting(1, kind="hosted-llm", name="m", provider="a"), sighting(2, kind="hosted-llm", name="m", provider="b"),
        sighting(3, name="lib", relations=rel("hosted-llm", "m")), sighting(4, name="lib", relations=rel("library", "LIB")),
        sighting(5, name="lib", relations=rel("library", "other")), sighting(6, name="other"),
    ])
    scans = spark.createDataFrame([("s", "dir", "/x/Y")], "scan_id string, kind string, target string")
    inv = pipeline.build(f, scans)
    assert [r["type"] for r in inv.edges.collect()] == ["uses"]
    assert [r["reason"] for r in inv.warnings.collect()] == ["several targets fit: 2"]
    assert graph.edges_from(inv.edges, inv.edges.first()["from_id"]).count() == 1


def test_bad_enum_fails(spark):
    with pytest.raises(Exception, match="bad finding"):
        assemble.key_findings(findings(spark, [sighting(1, method="guess")])).collect()


def test_conform_keeps_schema(spark):
    assert conform(spark.range(1)).schema == struct_type(FINDINGS)
