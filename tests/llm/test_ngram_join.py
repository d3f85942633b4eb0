import random

from aicensus.llm import ngram_join
from aicensus.llm.common import words

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def changed(t, k):
    w = t.split()
    for i in random.sample(range(len(w)), k):
        w[i] = random.choice(VOCABULARY)
    return " ".join(w)


BASE = [text(n) for n in (60, 120, 300)]
ROWS = [(i, t) for i, t in enumerate([*BASE, *[changed(t, k) for t in BASE for k in (1, 2, 3, 8)],
                                      *[changed(BASE[1], 1) for _ in range(120)], BASE[0].upper(), BASE[0] + "!",
                                      "a b", "A  b.", "", "...", "x", text(4000)])]
ROWS += [(None, BASE[2]), (500, None), (7, ROWS[7][1]), (None, "only null"), (None, "only null")]


def sets(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    every = [sets(t) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(every):
        for j, b in enumerate(every[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in links:
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        for j in group:
            seen[j] = group
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in seen[i]]
        known = [x for x in ids if x is not None]
        out.append((doc, min(known) if len(known) == len(ids) else None, len(links[i]), len(ids)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in frame.collect()), key=str)


def test_against_brute_force(docs):
    assert got(ngram_join.near_duplicates(docs(ROWS))) == brute(ROWS)


def test_small_blocks_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    assert got(ngram_join.near_duplicates(docs(ROWS))) == brute(ROWS)


def test_one_of_each_class_stays(docs):
    frame = docs(ROWS)
    kept = ngram_join.keep_one_of_each_class(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    # A class of k rows is listed k times, so the inverse sizes count the classes.
    classes = sum(1 / size for *_, size in brute([r for r in ROWS if sets(r[1])]))
    assert len([r for r in rows if sets(r["text"])]) == round(classes)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert {0, 1} - set(ids) == set()
    assert len([t for t in (r["text"] for r in rows) if t == "only null"]) == 1


def test_depth_is_shortened_to_the_recall():
    assert ngram_join.prefix_depth(32, 8, 0.8, 0.9) == 8
    depth = ngram_join.prefix_depth(32, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_empty_table(docs):
    assert ngram_join.near_duplicates(docs([])).count() == 0
