import random

import numpy as np
import pytest
from aicensus.llm import superminhash
from aicensus.llm.superminhash import SuperMinHash, blank_words, near_copies

random.seed(9)
VOCABULARY = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def changed(t, k):
    w = t.split()
    for i in random.sample(range(len(w)), k):
        w[i] = random.choice(VOCABULARY)
    return " ".join(w)


BASE = [text(n) for n in (40, 120, 300)]
ROWS = [(i, t) for i, t in enumerate([*BASE, *[changed(t, k) for t in BASE for k in (1, 2, 3, 8, 12)],
                                      *[changed(BASE[1], random.randrange(1, 9)) for _ in range(80)], BASE[0].upper(), BASE[0] + "!",
                                      "a b", "A\tb ", "", " \n", "x", "X", "x\x85", text(4000)])]
ROWS += [(None, BASE[2]), (500, None), (7, ROWS[7][1]), (None, "only null"), (None, "only null"), (3, "a  B")]


def sets(t, n=2):
    w = blank_words(t)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    every = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(every):
        for j, b in enumerate(every[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(every[i]), least, doc == least))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_against_brute_force(docs):
    assert got(near_copies(docs(ROWS), shingle=2)) == brute(ROWS)


@pytest.mark.parametrize("block", [3, 9])
def test_small_blocks_lose_no_link(docs, monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK_NODES", block)
    assert got(near_copies(docs(ROWS), shingle=2)) == brute(ROWS)


def test_second_round_joins_what_hubs_miss(docs):
    """A chain: neighbours are linked, the ends are not, whatever node is the hub."""
    w = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 8:i * 8 + 160])) for i in range(20)]
    out = got(near_copies(docs(rows), shingle=2))
    assert out == brute(rows) and {r[2] for r in out} == {0}


def test_empty_table(docs):
    assert near_copies(docs([])).count() == 0


def slow_signature(keys, hasher):
    """The definition: one permutation an element, all steps, no early end."""
    low = [int(superminhash.EMPTY)] * hasher.size
    for key in keys:
        p = list(range(hasher.size))
        for j in range(hasher.size):
            drawn = int(superminhash.mix(np.array([key], np.uint64) + hasher.steps[j])[0])
            k = j + ((drawn & 0xFFFFFFFF) * (hasher.size - j) >> 32)
            p[j], p[k] = p[k], p[j]
            low[p[j]] = min(low[p[j]], (drawn >> 32) | (j << 32))
    return low


def test_signatures_follow_the_definition():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 0, 2, 7, 60, 300)]
    hasher = SuperMinHash(24)
    want = [slow_signature(s, hasher) for s in sets]
    assert hasher.signatures(sets).tolist() == want
    assert hasher.signatures(sets, part=50).tolist() == want


def test_variance_is_lower_than_that_of_independent_hashes():
    """Equal positions estimate the similarity; for small sets the spread is clearly below the binomial one."""
    rng, hasher, found = np.random.default_rng(4), SuperMinHash(128), []
    for _ in range(300):
        keys = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        a, b = hasher.signatures([keys[:30], keys[10:]])
        found.append((a == b).mean())
    assert abs(np.mean(found) - 0.5) < 0.01
    assert np.var(found) < 0.6 * 0.25 / 128
