import random

import pytest
from aicensus.llm import decontamination as d
from aicensus.llm.common import words
from pyspark.sql import functions as F

random.seed(2)
WORDS = [f"w{i}" for i in range(30)] + ["the"] * 10
ITEMS = [(i, " ".join(random.choices(WORDS, k=n))) for i, n in enumerate([25, 12, 10, 9, 3])] + [
    (7, "Short, ITEM"), (8, ""), (9, None), (None, "unlisted words here"), (8, "second text of eight"), (7, "Short, ITEM")]


def near(t):
    return " ".join(random.choices(WORDS, k=6)) + " " + t + "; " + " ".join(random.choices(WORDS, k=6))


ROWS = [(1, near(ITEMS[0][1][:60])), (2, near(ITEMS[1][1])), (3, ITEMS[0][1] + " " + ITEMS[0][1]), (4, "a SHORT-item b"), (5, ""),
        (6, None), (None, "unlisted words here"), (7, " ".join(random.choices(WORDS, k=40_000))), (2, near(ITEMS[1][1])),
        (8, ITEMS[0][1].split()[0]), (9, " ".join(ITEMS[1][1].split()[:5])), (10, " ".join(ITEMS[1][1].split()[5:])),
        (11, "second text of eight Short item")]


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            for p in d.phrases_of(text, d.WINDOW):
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s:s + len(p)]) == p:
                        hit |= set(range(s, s + len(p)))
                        names |= {item} - {None}
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,segment", [(1 << 20, 1 << 20), (40, 50)])
def test_against_brute_force(docs, spark, block_bytes, segment, monkeypatch):
    monkeypatch.setattr(d.build_index, "__defaults__", ("doc_id", "text", segment))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.contamination(docs(ROWS), bench, block_bytes=block_bytes)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in found.collect()]
    assert sorted(got, key=str) == brute(ROWS, ITEMS)


def test_clean_rows_stay(docs, spark):
    frame = docs(ROWS)
    kept = d.drop_contaminated(frame, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == frame.columns
    clean = [r[0] for r in brute(ROWS, ITEMS) if not r[2]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_positions_and_proximity(docs):
    index = d.build_index(docs([(1, "red x fox the quick brown"), (2, "fox red"), (3, "red a b c fox"), (4, "red")]))
    exact = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in d.search(index, [(5, "quick brown")], None).collect()}
    assert exact == {1: [(5, 4, 5)], 2: [], 3: [], 4: []}
    close = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in d.search(index, [(5, "red fox")], None, slack=1).collect()}
    assert close == {1: [(5, 0, 2)], 2: [(5, 0, 1)], 3: [], 4: []}


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs([]), none).count() == 0
    assert [r["n_hit"] for r in d.contamination(docs([(1, "a b")]), none).collect()] == [0]


def test_repeated_items_are_in_a_block_once(spark):
    items = [(i, f"item {i} of some words") for i in range(20)] + [(1, "item 1 of some words"), (None, "no id")] * 300
    found = list(d.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 200))
    assert len(found) == 3 and sorted(map(str, sum(found, []))) == sorted(map(str, set(items)))


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_item_ids_of_any_type(docs, spark, kind):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    if kind == "string":
        bench = bench.withColumn("item_id", F.concat(F.lit("item-"), "item_id"))
    found = d.contamination(docs(ROWS), bench, block_bytes=300)
    assert dict(found.dtypes)["items"] == f"array<{kind}>"
    bare = lambda i: int(str(i).removeprefix("item-"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(map(bare, r["items"]))) for r in found.collect()]
    assert sorted(got, key=str) == brute(ROWS, ITEMS)
