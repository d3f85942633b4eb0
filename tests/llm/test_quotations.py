from aicensus.llm import quotations as q
from pyspark.sql import functions as F

CONV = [(1, 0, "Hello there\nsecond line"), (1, 1, "> hello   THERE\n> second line\nMy answer"), (1, 2, ">> Hello there\n>> second line\n> My answer\n\nfine"),
        (1, 3, "> nobody said this\nok"), (1, 4, "> ok\n>> unknown\n> fine\n\nx"), (1, 5, "ok"), (1, 6, "> > my answer\n>ok\nlast"), (2, 0, "> Hello there\nq"),
        (2, 1, None), (2, 2, ""), (None, 3, "> q\nlost"), (2, None, "> q\nlost"), (1, 1, "> hello there\n> second line\nMy answer")]


def run(spark, rows, **columns):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns(
        {c: F.lit(i) for i, c in enumerate(("role", "depth", "hash", "level"))})
    return q.link_quotations(frame)


def test_levels_and_passages():
    assert q.passages("a\nb\n\n> c\n>> d\n> > e\n\n>f\r\n") == [(0, "a\nb"), (1, "c"), (2, "d\ne"), (1, "f")]
    assert q.normalised("  A\t b\nÉ ") == "a b É"


def test_links(spark):
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, CONV).collect()}
    parent = {k: r["parent_turn"] for k, r in got.items()}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 3, (1, 5): None, (1, 6): 5, (2, 0): None,
                      (2, 1): None, (2, 2): None, (None, 3): None, (2, None): None}
    assert [(got[1, t]["root_turn"], got[1, t]["depth"]) for t in (0, 1, 2, 4, 6)] == [(0, 0), (0, 1), (0, 2), (3, 1), (5, 1)]
    assert got[1, 2]["own_text"] == "fine" and got[1, 2]["max_level"] == 2 and got[1, 2]["n_linked"] == 2
    assert got[1, 4]["n_quotes"] == 3 and got[1, 4]["n_linked"] == 2


def test_rows_come_in_reply_order(spark):
    rows = [(r["root_turn"], r["depth"], r["turn"]) for r in run(spark, CONV).filter("conv_id = 1").collect()]
    assert rows == sorted(rows) and len(rows) == 8


def test_long_conversation_with_one_passage(spark, monkeypatch):
    monkeypatch.setattr(q, "RANGE", 16)
    rows = [(9, t, "same" if t % 3 == 0 else "> same\nreply") for t in range(200)]
    got = {r["turn"]: r["parent_turn"] for r in run(spark, rows).collect()}
    assert got == {t: None if t % 3 == 0 else t - t % 3 for t in range(200)}


def test_long_threads_and_texts(spark):
    rows = [(3, t, f"> m{t - 1}\n\nm{t}") for t in range(70)] + [(4, 0, "word " * 100_000), (4, 1, "> " + "word " * 100_000 + "\nyes")]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, rows).collect()}
    assert all((got[3, t]["root_turn"], got[3, t]["depth"]) == (0, t) for t in range(70)) and got[4, 1]["parent_turn"] == 0


def test_empty_table(spark):
    assert run(spark, []).count() == 0
