import io
import zipfile

import pyarrow as pa
import pytest
from aicensus.operators import artifacts, regions, rule_scan, rules
from aicensus.plans import pipeline
from aicensus.operators.literals import LiteralIndex
from aicensus.reports import tables
from aicensus.rulepacks.shipped import SHIPPED
from aicensus.session import stored
from aicensus.sources import files, layers
from aicensus.sources.files import prepare
from aicensus.sources.routing import ROUTES, route, routed, with_routes
from helpers import files_frame
from pyspark.sql import functions as F

APP = '''"""Docs: client.chat.completions.create(model="gpt-4")"""
import chromadb
# import openai
EMBED_MODEL = "text-embedding-3-large"
BASE = "gpt-4.1"
model = "gpt-4.1"

def answer(client):
    return client.chat.completions.create(
        model=BASE,
        temperature=0.2,
    )
'''


def test_regions():
    src = b'x = "a # b"  # c "q"\ny = r"\\"'
    assert [k for _, _, k in regions.regions("python", src)] == ["string", "comment", "string"]
    nested = b"/* a /* b */ c */ let s = r#\"a\"b\"#;"
    assert [k for _, _, k in regions.regions("rust", nested)] == ["comment", "string"]
    for lang in regions.PATTERNS:
        for cut in range(len(nested)):
            spans = regions.regions(lang, nested[:cut])
            assert len(regions.mask(nested[:cut], spans, frozenset())) == cut


def test_shipped_rules_load(spark):
    loaded = rules.load_rules(rules.effective_rules(rules.rules_from(spark, SHIPPED)))
    assert len(loaded) == 101


def test_scan_to_inventory(spark):
    loaded = rules.load_rules(rules.effective_rules(rules.rules_from(spark, SHIPPED)))
    f = files_frame(spark, [
        ("s", "requirements.txt", "openai==1.51.0\nchromadb==0.5.5\nnumpy==1\n"), ("s", "src/app.py", APP),
        ("s", "node_modules/x/app.py", APP), ("s", "m/bad.pt", b"PK\x03\x04broken"),
    ])
    findings, unknowns = pipeline.detect(f, loaded, stage=True)
    assert [(r["path"], r["detector_id"]) for r in unknowns.collect()] == [("m/bad.pt", "modelfilex/torch")]
    scans = spark.createDataFrame([("s", "dir", "/x/Proj")], "scan_id string, kind string, target string")
    inv = pipeline.build(findings, scans, unknowns, stage=True)
    got = {(r["kind"], r["name"]): round(r["confidence"], 4) for r in inv.components.collect()}
    assert got[("library", "openai")] == 0.985
    assert ("rag-pipeline", "rag-pipeline") in got and ("application", "Proj") in got
    assert got[("hosted-llm", "gpt-4.1")] == 0.85
    assert [r["value"] for r in inv.params.filter("param = 'temperature'").collect()] == ["0.2"]


def test_cap_and_errors(spark):
    rule = dict(id="p/x", kind="prompt", provider="", keywords=["X"], pattern="x", claim={"name": "x"}, confidence=0.5)
    loaded = rules.load_rules(rules.rules_from(spark, [rule]))
    f = files.classify(files_frame(spark, [("s", "a.txt", "x" * 500)]))
    assert rule_scan.scan_rules(f, loaded, any_language=True, cap=200).count() == 200
    assert rules.cap_matches(rules.match_lines(f, loaded), 200).count() == 200
    with pytest.raises(ValueError):
        rules.load_rules(rules.rules_from(spark, [{**rule, "claim": {"name": "${nope}"}}]))


def test_content_cap(spark):
    f = files.cap_content(files_frame(spark, [("s", "a", "abcd"), ("s", "b", "abcde")]), 4)
    got = {r["path"]: (r["truncated"], r["sha256"] is None, len(r["content"])) for r in f.collect()}
    assert got == {"a": (False, False, 4), "b": (True, True, 4)}


def test_pickles_and_truncation():
    stacked = b"\x80\x04\x8c\x02os\x94\x8c\x06system\x94h\x00h\x01\x93."
    assert artifacts.pickle_globals(stacked) == ["os.system"]
    for cut in range(len(stacked)):
        artifacts.pickle_globals(stacked[:cut])
        artifacts.gguf_header(b"GGUF\x03\0\0\0" + stacked[:cut])
        artifacts.onnx_header(stacked[:cut])
        artifacts.is_savedmodel(stacked[:cut])
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a/data.pkl", stacked)
    assert artifacts.torch_facts(box.getvalue()) == {"format": "torch-zip", "globals": ["os.system"]}


def test_layers(spark):
    rows = [("i", 0, 0, "a/x", "file"), ("i", 0, 1, "a/d/y", "file"), ("i", 1, 0, "a/.wh.x", "file"), ("i", 1, 1, "a/x", "file"),
            ("i", 2, 0, "a/.wh.d", "file"), ("i", 0, 2, "b/z", "file"), ("i", 1, 2, "b/.wh..wh..opq", "file"), ("i", 1, 3, "l", "link")]
    e = spark.createDataFrame(rows, "image string, layer_idx int, entry_seq int, path string, type string")
    shown = lambda **kw: {(r["path"], r["layer_idx"]) for r in layers.squash_layers(e, **kw).collect()}
    assert shown() == {("a/x", 1), ("a/d/y", 0)}
    assert shown(whiteout_hides_subtree=True) == {("a/x", 1)}


def test_payloads_cross_no_shuffle(spark):
    """Payloads are written once and read for visible entries only; the squash itself moves narrow rows."""
    e = spark.createDataFrame([("i", 0, 1, "a", "file", bytearray(b"old"), 7), ("i", 1, 2, "./a", "file", bytearray(b"new"), 8), ("i", 0, 3, "b/.", "file", bytearray(b""), 9),
                               ("i", 0, 4, "c", "file", None, 10), ("i", 1, 5, ".wh.b", "file", bytearray(b"x"), 11), ("j", 0, 6, "b", "file", bytearray(b"j" * 70000), 12)],
                              "image string, layer_idx int, entry_seq long, path string, type string, content binary, mode int").repartition(3)
    shown = layers.squash_layers(e)
    assert shown.columns == e.columns
    got = {(r["image"], r["path"]): (r["content"], r["mode"]) for r in shown.collect()}
    assert got == {("i", "a"): (b"new", 8), ("i", "c"): (None, 10), ("j", "b"): (b"j" * 70000, 12)}
    packed = layers.pack_payloads(e)
    assert set(layers.HANDLE) <= set(packed.columns) and "content" not in packed.columns
    plan = layers.squash_layers(packed)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "Join" in plan
    below = shown._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert "content" not in below and "blob" in below  # the fetch moves and sorts handles


def test_detectors_read_their_partitions(spark):
    """Selectors are evaluated when the files are routed and never again."""
    f = files_frame(spark, [("s", "requirements.txt", "openai==1\n"), ("s", "package.json", "{}"), ("s", "x.go", "package x"), ("s", "notes.md", "n")])
    held = stored(with_routes(prepare(f), {}).filter(F.col(ROUTES) != ""), "routed", (ROUTES,))
    assert {(r["path"], r[ROUTES]) for r in held.collect()} == {
        ("requirements.txt", "|manifest/pypi-requirements|"), ("package.json", "|manifest/npm|"), ("x.go", "|gosrc/ast|ruleengine|")}
    for detector in ("manifest/npm", "gosrc/ast"):
        plan = routed(held, detector)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and f"|{detector}|" in plan and "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_literal_index():
    words = [b"openai", b"ai", b"", b"import torch", b"torch", b"\xff\xfe\xfd\xfc"]
    index = LiteralIndex(words)
    for text in (b"", b"a", b"xopenaix", b"import  torch", b"import torch", b"OPENAI", b"\0\xff\xfe\xfd\xfc", b"torc", b"zzzz" * 5000 + b"openai"):
        assert [index.literals[i] for i in index.present(text)] == [w for w in index.literals if w in text], text
        assert index.any(text) == any(w in text for w in words)


def test_counts_come_from_the_detection(spark):
    """One pass: the counts of a detection are those of routing and findings computed on their own."""
    f = files_frame(spark, [("s", "requirements.txt", "openai==1\nchromadb\n"), ("s", "a/requirements.txt", "torch"), ("t", "x.go", "package x"),
                            ("t", "notes.md", "n"), ("t", "app.py", "import openai\nopenai.chat.completions.create(model='gpt-4o')\n")])
    loaded = rules.load_rules(rules.effective_rules(rules.rules_from(spark, SHIPPED)))
    watch = pipeline.Watch()
    found, _ = pipeline.detect(f, loaded, watch=watch)
    assert watch.totals() == {"files": 5, "bytes": sum(r["size"] for r in f.collect()), "routed": 4}
    stats = {r["detector_id"]: (r["invocations"], r["findings"]) for r in tables.detector_stats(
        route(prepare(f)), found.filter("detector_id NOT LIKE 'project/%'")).groupBy("detector_id").agg(
        F.sum("invocations").alias("invocations"), F.sum("findings").alias("findings")).collect()}
    assert {d: v for d, v in watch.detectors().items() if v != (0, 0)} == stats and stats["ruleengine"][0] == 2


def test_gate_as_a_column(spark):
    """Files that hold the longest word of a keyword, in any case; null contents hold none."""
    given = [{"keywords": ["Open AI", "torch"]}, {"keywords": ["é x"]}]
    texts = ["import TORCH", "open", "OPEN", "tor ch", "", "é", "É", "x", "x" * 70_000 + "Torch"]
    f = files_frame(spark, [("s", str(i), t) for i, t in enumerate(texts)])
    f = f.unionByName(f.limit(1).withColumns({"path": F.lit("null"), "content": F.lit(None).cast("binary")}))
    held = {r["path"] for r in f.filter(rule_scan.may_match(F.col("content"), given)).collect()}
    assert held == {"0", "1", "2", "5", "8"}


def test_matches_are_handed_on_in_parts(spark):
    """However many files a batch holds and matches a file has, few matches are Python values at once; a bad file stays a row."""
    from aicensus.schemas import struct_type
    from pyspark.sql.pandas.types import to_arrow_schema
    rule = {"id": "r", "kind": "prompt", "provider": "", "risk": "", "languages": [], "keywords": ["le"], "pattern": "(?P<model>le)",
            "regions": [], "claim": {"name": "${model}", "group": "", "version": ""}, "relations": [], "within_lines": None,
            "param_names": [], "confidence": 0.5}
    arrow = to_arrow_schema(struct_type(f"{rule_scan.MATCHES}, {rule_scan.AROUND}"))
    batch = pa.RecordBatch.from_pydict({"scan_id": ["s"] * 4, "path": list("abcd"), "language": [""] * 4,
                                        "content": [b"le " * 1200, b"x", b"le\n" * 3, b"le " * 600]})
    parts = list(rule_scan._scan_batches(iter([batch]), arrow, rule_scan._Compiled(rule_scan._frozen([rule])), True, None))
    assert [p.num_rows for p in parts] == [500, 500, 500, 303]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["path"], r["match_seq"]) for r in rows] == [("a", i) for i in range(1200)] + [("c", i) for i in range(3)] + [("d", i) for i in range(600)]
