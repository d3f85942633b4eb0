import random

from aicensus.llm import toxicity as tox
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

random.seed(4)
PLAIN = [f"word{i}" for i in range(300)]


def text(bad):
    words = random.choices(PLAIN, k=80)
    if bad:
        for _ in range(4):
            words.insert(random.randint(20, 30), random.choice(["nasty", "vilest", "viler"]))
    return " ".join(words)


ROWS = [(i, text(i % 5 == 0)) for i in range(600)]
LABELS = [(i, int(i % 5 == 0)) for i in range(600)]


def tables(spark, rows=ROWS, labels=LABELS):
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit("x")),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def slow_segments(values):
    """Maximal-scoring segments by recursion: the best stretch, then left and right of it."""
    if not values:
        return []
    best, at = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    right = [(a + j + 1, b + j + 1, s) for a, b, s in slow_segments(values[j + 1:])]
    return slow_segments(values[:i]) + [(i, j, best)] + right


@given(st.lists(st.sampled_from([None, None, None, 0.7, 1.3, 2.9]), max_size=40))
def test_segments_as_by_recursion(scores):
    drift = 0.5
    fast = tox.segments([(i, s) for i, s in enumerate(scores) if s], drift)
    slow = slow_segments([s or -drift for s in scores])
    assert abs(sum(s for *_, s in fast) - sum(s for *_, s in slow)) < 1e-9
    assert abs(max((s for *_, s in fast), default=0) - max((s for *_, s in slow), default=0)) < 1e-9


def test_held_out_rows_and_passages(spark):
    docs, labels = tables(spark)
    model = tox.fit(docs, labels, F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r for r in tox.score(docs, model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert sum((found[i]["score"] >= 0.7) == (i % 5 == 0) for i in held) >= len(held) - 2
    for p in found[10]["passages"]:
        assert 15 <= p["first"] <= p["last"] <= 40 and p["tail"] >= 2


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs, labels = tables(spark, [*ROWS, (None, "nasty"), (700, None), (701, ""), (5, ROWS[5][1]), (702, "word1 " * 200_000)],
                          [*LABELS, (None, 1), (3, None), (0, 1), (0, 0), (9999, 1)])
    model = tox.fit(docs, labels)
    rows = tox.score(docs, model).collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["passages"] for r in rows if r["doc_id"] in (700, 701, 702)] == [[], [], []]
    kept = tox.reject(docs, model)
    assert kept.columns == docs.columns
    assert {700, 701, 702, 1, 2} <= {r["doc_id"] for r in kept.collect()} and kept.filter("doc_id = 5").count() == 0
    none, no_labels = tables(spark, [], [])
    blank = tox.fit(none, no_labels)
    assert tox.score(none, blank).count() == 0
    assert tox.reject(docs, tox.fit(docs, no_labels)).count() == docs.count()
