import duckdb
import pytest
from aicensus.llm import queries
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLES[name])
    order = [d[0] for d in rel.description]
    assert sorted(order) == sorted(df.columns)
    want = sorted(tuple(norm(r[order.index(c)]) for c in df.columns) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in df.columns) for r in df.collect()) == want


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages(spark):
    """Each stage keeps columns, works on what came before, and its decisions hold in the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).union(docs.limit(3)).union(spark.createDataFrame(
        [(None, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema))
    docs = docs.union(extra)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[4] > 0
    texts = docs.groupBy(F.lower("text")).count().filter("count > 1")
    assert texts.isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1] and last.select("doc_id").distinct().count() == counts[-1]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
