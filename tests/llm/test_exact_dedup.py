import hashlib

from aicensus.llm.exact_dedup import exact_dedup, keep_first_copies
from pyspark.sql import functions as F

FOLD = {c: c + 32 for c in range(65, 91)}
ROWS = [(1, "A b"), (5, "a B"), (5, "a B"), (7, "É"), (8, "é"), (None, "a b"), (None, None), (None, ""), (3, ""),
        (9, "x" * 300_000), (10, "X" * 300_000)] + [(100 + i, "Hot copy") for i in range(300)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is not None, i), reverse=True):
            out.append((i, keep, len(ids), bool(left and i == keep), hashlib.sha256(t.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=str)


def test_against_brute_force(docs):
    got = [tuple(r) for r in exact_dedup(docs(ROWS, 7), salts=4).collect()]
    assert sorted(got, key=str) == expected(ROWS)


def test_clashing_digests_do_not_merge(docs):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = [tuple(r)[:4] for r in exact_dedup(docs(ROWS), digest=weak).collect()]
    assert sorted(got, key=str) == sorted((r[:4] for r in expected(ROWS)), key=str)


def test_rows_that_stay_keep_their_columns(docs):
    frame = docs(ROWS)
    kept = keep_first_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:8]) for r in kept.collect()) == [
        (3, ""), (5, "a B"), (7, "É"), (8, "é"), (10, "X" * 8), (399, "Hot copy")]


def test_empty_table(docs):
    assert exact_dedup(docs([])).count() == 0 and keep_first_copies(docs([])).count() == 0


def test_plan_has_no_python(docs):
    plan = exact_dedup(docs(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
