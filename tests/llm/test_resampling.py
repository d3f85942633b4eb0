import hashlib
import math
import random
import zlib

import pytest
from aicensus.llm.common import words
from aicensus.llm.resampling import Head, resample

random.seed(6)
VOCABULARY = [f"w{i}" for i in range(200)] + ["é", "日本", "x" * 90]
ROWS = [(i, " ".join(random.choices(VOCABULARY, [1 / (k + 1) for k in range(len(VOCABULARY))], k=random.choice([3, 19, 20, 21, 60]))))
        for i in range(150)]
ROWS += [(None, ROWS[4][1]), (200, None), (201, ""), (202, "..."), (203, "Tail " * 5000), (3, ROWS[3][1]), (3, ROWS[3][1]),
         (None, None)]
TARGET = [(1, "w1 w2 w1 é"), (2, None), (3, ""), (3, "w9 " * 40), (None, "tail w1")]


def runs(text, n):
    w = words(text)
    return [b" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, buckets, percent, min_words):
    count = lambda texts: [zlib.crc32(f) % buckets for t in texts for f in runs(t, n)]
    s, t = count([r[1] for r in rows]), count([r[1] for r in target])
    gain = [math.floor(1000 * math.log((t.count(b) + 1) * (len(s) + buckets) / ((s.count(b) + 1) * (len(t) + buckets))))
            for b in range(buckets)]
    out = []
    for i, text in rows:
        f = runs(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score, len(words(text)) >= min_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(fit) * percent // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return sorted(ranked + [(*r[:4], None) for r in out if not r[4]], key=str)


@pytest.mark.parametrize("n, buckets, head", [(1, 97, 1000), (1, 10_000, 0), (2, 97, 10), (2, 70_000, 0), (3, 50, 10)])
def test_against_brute_force(docs, n, buckets, head):
    """The head's size changes nothing."""
    got = resample(docs(ROWS, 5), docs(TARGET), max_n=n, buckets=buckets, percent=30, min_words=20, head_words=head, head_pairs=head)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, TARGET, n, buckets, 30, 20)


def test_states_continue():
    head = Head({b"a": zlib.crc32(b"a")}, {(b"a", b"b"): zlib.crc32(b"a b") % 11}, 11)
    for n in (1, 2, 3, 4):
        assert sorted(head.feature_buckets([b"a", b"b", b"c"], n)) == sorted(zlib.crc32(f) % 11 for f in runs("a b c", n))


def test_empty_tables(docs):
    assert resample(docs([]), docs(TARGET)).count() == 0
    rows = resample(docs(ROWS), docs([]), percent=100, min_words=0).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(ROWS) + 1))
