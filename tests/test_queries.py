"""A sample of the registered queries against DuckDB on the smallest tables."""
import duckdb
import pytest
from aicensus.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "nation orders part lineitem events documents embeddings pages conversations supplier".split()
SAMPLE = ["component_ids", "occurrences", "inventory_components", "edges", "gate_verdicts", "rule_scan_documents",
          "requirements_deps", "pyproject_deps", "dockerfile_infra", "safetensors_facts", "layer_squash", "component_vulns",
          "npm_shapes", "requirements_shapes", "call_site_params", "graph_lookups", "present_controls", "json_documents",
          "multi_output", "corpus_files", "rule_risks", "selected_detectors", "gguf_long_array"]


def norm(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(registry.ORACLES[name])
    order = [d[0] for d in rel.description]
    want = sorted(tuple(norm(r[order.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
