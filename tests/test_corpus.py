"""Corpora on disk: pruned listing, ranged reading, pieces of lines, literals at borders."""
import os
import random
import struct
import time

import pytest
from aicensus.operators import rules
from aicensus.plans import pipeline
from aicensus.sources import corpus
from aicensus.sources.files import classify
from pyspark.sql import functions as F


def put(root, **files):
    for name, data in files.items():
        target = root / name.replace("__", "/").replace("_dot_", ".")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())


def gguf(*pairs, version=3):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    return b"GGUF" + struct.pack("<IQQ", version, 0, len(pairs)) + b"".join(text(k) + struct.pack("<I", 8) + text(v) for k, v in pairs)


@pytest.fixture
def tree(tmp_path):
    for name, data in {"r1/src/a.py": "x = 1\n", "r1/node_modules/m/b.py": "no", "r1/.github/ci.yml": "on: push", "r2/Dockerfile": "FROM x",
                       "r2/skip/me/c.py": "z", "r2/deep/vendor/d.py": "v", "top.txt": "t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)
    return tmp_path


def listed(df):
    return {(r["scan_id"], r["path"], r["size"]) for r in df.collect()}


@pytest.mark.parametrize("fan_out", [0, 1, 2, 5])
def test_listing_prunes(spark, tree, fan_out):
    got = listed(corpus.list_corpus(spark, str(tree), user_globs=("skip/**",), fan_out=fan_out))
    assert got == {("r1", "src/a.py", 6), ("r1", ".github/ci.yml", 8), ("r2", "Dockerfile", 6), ("top.txt", "top.txt", 1)}
    one = listed(corpus.list_corpus(spark, f"file:{tree}/r2", scan_id="only", user_globs=("skip/me/**",), fan_out=fan_out))
    assert one == {("only", "Dockerfile", 6)}


def test_ignored_folders_are_never_opened(spark, tree, monkeypatch):
    """A folder that cannot be listed fails the job, unless it is pruned; so does a folder outside pushed filters."""
    opened = []
    listing = corpus.CorpusReader(str(tree), corpus.Pruning(globs=("skip/**",)), 1)
    real = corpus.CorpusReader._listed

    def noted(self, system, base, folder):
        opened.append(folder)
        return real(self, system, base, folder)

    monkeypatch.setattr(corpus.CorpusReader, "_listed", noted)
    for part in listing.partitions():
        list(listing.read(part))
    assert not any(x in folder for folder in opened for x in ("node_modules", "vendor", "skip"))
    assert "r1/src" in opened


def test_filters_reach_the_walk(spark, tree):
    every = corpus.list_corpus(spark, str(tree))
    assert listed(every.filter("scan_id = 'r1' AND path LIKE 'src/%'")) == {("r1", "src/a.py", 6)}
    assert listed(every.filter("scan_id IN ('r2', 'none')")) == {("r2", "Dockerfile", 6), ("r2", "skip/me/c.py", 1)}
    reader = corpus.CorpusReader(str(tree), corpus.Pruning(), 1)
    assert list(reader.pushFilters([corpus.EqualTo(("scan_id",), "r1"), corpus.StringStartsWith(("path",), "src/"),
                                    corpus.EqualTo(("size",), 3)])) == [corpus.EqualTo(("size",), 3)]
    folders = [p.folder for p in reader.partitions()]
    assert "r1" in folders and "r2" not in folders
    plan = every.filter("scan_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")


def test_a_sparse_model_of_150_mib(spark, tmp_path):
    """The header is read, the file is not; detection over the corpus stays within its time."""
    put(tmp_path, **{f"r__src__m{i}_dot_py": f"import openai\nx = {i}\n" for i in range(30)})
    header = gguf(("general.architecture", "llama"), ("tokenizer.chat_template", "{{ x.__class__ }}"))
    big = tmp_path / "r" / "weights" / "model.gguf"
    big.parent.mkdir()
    big.write_bytes(header)
    os.truncate(big, 150 << 20)
    tensors = b'{"a": {"dtype": "BF16", "shape": [2, 3], "data_offsets": [0, 12]}}'
    (tmp_path / "r" / "weights" / "w.safetensors").write_bytes(struct.pack("<Q", len(tensors)) + tensors)
    os.truncate(tmp_path / "r" / "weights" / "w.safetensors", 50 << 20)
    read = corpus.read_listed(corpus.list_corpus(spark, str(tmp_path)), str(tmp_path)).persist()
    held = {r["path"]: (r["n"], r["size"], r["partial"]) for r in read.select("path", "size", "partial", F.length("content").alias("n")).collect()}
    assert sum(n for n, _, _ in held.values()) < 8 << 20
    assert held["weights/model.gguf"] == (len(header), 150 << 20, True)
    assert held["weights/w.safetensors"] == (len(tensors) + 8, 50 << 20, True)
    start = time.perf_counter()
    found, unknowns = pipeline.detect_corpus(spark, str(tmp_path), [])
    got = {r["path"]: r for r in found.filter("detector_id LIKE 'modelfile/%'").collect()}
    assert time.perf_counter() - start < 60
    assert got["weights/model.gguf"]["model"]["architecture"] == "llama" and got["weights/model.gguf"]["hashes"] is None
    assert got["weights/w.safetensors"]["model"]["param_count"] == 6 and unknowns.count() == 0


def test_headers_of_any_shape(tmp_path):
    """Long arrays, cut-off and lying headers: what the header needs is read, and never more than the file."""
    long = b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + struct.pack("<Q", 1) + b"a" + struct.pack("<IIQ", 9, 0, 300_000) + b"\1" * 300_000
    lying = b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + struct.pack("<Q", 1 << 60) + b"abc"
    strange = b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + struct.pack("<Q", 1) + b"a" + struct.pack("<I", 77)
    for raw, want in ((long + b"w" * 500_000, len(long)), (lying + b"w" * 900_000, 1 << 16), (strange + b"w" * 90_000, 1 << 16),
                      (long[:200_000], 200_000), (b"none" * 50_000, 4), (b"", 0), (b"GG", 2)):
        path = tmp_path / "x.gguf"
        path.write_bytes(raw)
        with corpus.open_root(str(tmp_path))[0].open_input_file(str(path)) as source:
            got = corpus.read_header(source, len(raw), corpus.gguf_header_size)
        assert len(got) <= max(want, 0) + 8 and raw.startswith(got) and (want != len(long) or len(got) == want)


def test_unreadable_files_are_unknown(spark, tmp_path):
    put(tmp_path, r__a_dot_py="x", r__b_dot_py="y")
    listing = corpus.list_corpus(spark, str(tmp_path))
    kept = spark.createDataFrame(listing.collect(), listing.schema)
    (tmp_path / "r" / "b.py").unlink()
    (tmp_path / "r" / "cut.gguf").write_bytes(gguf(("general.architecture", "llama"), ("b", "c"))[:-3])
    rows = {r["path"]: r for r in corpus.read_listed(kept, str(tmp_path)).collect()}
    assert rows["a.py"]["error"] is None and "FileNotFoundError" in rows["b.py"]["error"]
    _, unknowns = pipeline.detect_corpus(spark, str(tmp_path), [])
    assert [(r["path"], r["reason"]) for r in unknowns.collect()] == [("cut.gguf", "the metadata breaks off")]


RULES = [{"id": "t/a", "kind": "service", "provider": "", "keywords": ["needle  word"], "pattern": r"n(?P<model>[0-9]+)e\b",
          "claim": {"name": "${model}"}, "confidence": 0.5},
         {"id": "t/b", "kind": "service", "provider": "", "keywords": ["zebra"], "pattern": r"^x+", "claim": {"name": "x"}, "confidence": 0.5}]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_pieces_give_the_rows_of_whole_files(spark, tmp_path, size):
    """Any range size: matches, line numbers and keywords that lie across borders are those of the whole file."""
    random.seed(size)
    line = lambda: random.choice(["", "n12e", "xx n3e n4e", "Needle", "word n9e", "é" * 9 + "n7e", "y" * 90])
    texts = {f"r/f{i}.txt": "\n".join(line() for _ in range(25)) + random.choice(["", "\n", "\n\n"]) for i in range(6)}
    texts |= {"r/g.txt": "needle \n \n word\nn1e\r\nn2e", "r/h.txt": "n5e\nzebra", "r/i.txt": "", "r/j.txt": "n1e"}
    for name, text in texts.items():
        put(tmp_path, **{name.replace("/", "__").replace(".", "_dot_"): text})
    loaded = rules.load_rules(rules.rules_from(spark, RULES))
    listing = corpus.list_corpus(spark, str(tmp_path))
    whole = classify(corpus.read_listed(listing, str(tmp_path)).drop("error", "partial"))
    columns = ["path", "rule_id", "line", "col", "matched", "match_no"]
    want = sorted(map(tuple, rules.match_lines(whole, loaded).select(columns).collect()))
    found, unknowns = rules.match_pieces(spark, corpus.line_cuts(listing, str(tmp_path), range_bytes=size), str(tmp_path), loaded)
    assert sorted(map(tuple, found.select(columns).collect())) == want and want and unknowns.count() == 0
    cuts = corpus.line_cuts(listing, str(tmp_path), range_bytes=size).collect()
    for name, text in texts.items():
        rows = sorted((r for r in cuts if "r/" + r["path"] == name), key=lambda r: r["start"])
        assert b"".join(text.encode()[r["start"]:r["stop"]] for r in rows) == text.encode()
        assert [r["first_line"] for r in rows] == [text.encode()[:r["start"]].count(b"\n") + 1 for r in rows]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_literals_on_every_border(spark, tmp_path, size):
    put(tmp_path, r__a_dot_bin=b"aaaa\0Lambda\0aLambdaLambda", r__b_dot_bin=b"Lamb", r__c_dot_bin=b"")
    got = corpus.find_literals(corpus.list_corpus(spark, str(tmp_path)), str(tmp_path), ["Lambda", "aa", "b"], range_bytes=size)
    want = {("a.bin", "aa", 0), ("a.bin", "aa", 1), ("a.bin", "aa", 2), ("a.bin", "Lambda", 5), ("a.bin", "Lambda", 13), ("a.bin", "Lambda", 19),
            ("a.bin", "b", 8), ("a.bin", "b", 16), ("a.bin", "b", 22), ("b.bin", "b", 3)}
    rows = [(r["path"], r["literal"], r["at"]) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_small_ranges_share_a_task(spark, tmp_path):
    """Ranges of a few bytes are dealt by a task's bytes: their number does not give as many tasks."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"one two\n" * 2000)
    listing = corpus.list_corpus(spark, str(tmp_path))
    found = corpus.find_literals(listing, str(tmp_path), ["two"], range_bytes=100)
    cuts = corpus.line_cuts(listing, str(tmp_path), range_bytes=100)
    assert found.count() == 2000 and cuts.count() == 160
    assert found.rdd.getNumPartitions() == 1 and corpus.line_pieces(cuts, str(tmp_path)).rdd.getNumPartitions() == 1
    parts = corpus.spread(corpus.ranges(listing, 100), F.col("stop") - F.col("start"), 4000)
    assert parts.rdd.getNumPartitions() == 4
