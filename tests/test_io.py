import json
from pathlib import Path

from aicensus import session
from aicensus.operators import controls, rulecheck, rules
from aicensus.plans import pipeline
from aicensus.reports import inventory
from aicensus.sources import files
from aicensus.sources.routing import Selector, route
from helpers import files_frame, findings, sighting


def test_read_corpus(spark, tmp_path):
    for name, text in [("r1/src/a.py", "x"), ("r1/vendor/b.py", "y"), ("r2/Dockerfile", "FROM x"), ("r2/skip/me/c.py", "z")]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    f = files.prepare(files.read_corpus(spark, str(tmp_path)), user_globs=("skip/**",))
    assert {(r["scan_id"], r["path"], r["language"]) for r in f.collect()} == {
        ("r1", "src/a.py", "python"), ("r2", "Dockerfile", "")}
    one = files.read_corpus(spark, str(tmp_path / "r1"), scan_id="only")
    assert {(r["scan_id"], r["path"]) for r in one.select("scan_id", "path").collect()} == {
        ("only", "src/a.py"), ("only", "vendor/b.py")}


def test_routing_dimensions(spark):
    f = files.classify(files_frame(spark, [("s", "a/x.bin", b"\x80\x02"), ("s", "b/x.bin", b"zz"), ("s", "c/x.bin", b"\x80" * 9)]))
    sel = Selector("d", basenames=("x.bin",), extensions=(".bin",), magics=((0, "80"),), max_size=5)
    assert [r["path"] for r in route(f, [sel]).collect()] == ["a/x.bin"]


def test_present_and_json(spark, tmp_path):
    f = findings(spark, [sighting(1, name="a", confidence=0.9), sighting(2, name="b", kind="prompt", confidence=0.5, path="p")])
    scans = spark.createDataFrame([("s", "dir", "/x/Y")], "scan_id string, kind string, target string")
    ctl = controls.shipped_controls(spark, ["nist-ai-rmf"])
    inv = pipeline.present(pipeline.build(f, scans), 0.8, ctl)
    assert {r["name"] for r in inv.components.collect()} == {"a", "Y"}
    assert inv.occurrences.count() == 1
    state = {r["control"]: r["state"] for r in inv.outcomes.collect()}
    assert state["MAP-4.1"] == "met" and state["MAP-2.1"] == "gap" and state["MEASURE-2.7"] == "met"
    inventory.write_json(inv, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted(Path(tmp_path / "out").glob("bucket=*/*.json")) for x in p.read_text().splitlines()]
    assert [x["section"] for x in lines] == sorted(x["section"] for x in lines)
    assert json.loads(lines[1]["record"])["kind"] in ("library", "application")


def test_rule_layers_and_coverage(spark):
    base = dict(kind="prompt", provider="", keywords=["x"], pattern="x", claim={"name": "x"}, confidence=0.5)
    layers = rules.rules_from(spark, [
        {**base, "id": "p/a"}, {**base, "id": "p/b"}, {**base, "id": "p/a", "layer_seq": 1, "confidence": 0.9},
        {**base, "id": "p/b", "layer_seq": 2, "disable": True}, {**base, "id": "p/c", "layer_seq": 1, "disable": True},
    ])
    loaded = rules.load_rules(rules.effective_rules(layers))
    assert [(r["id"], r["confidence"]) for r in loaded] == [("p/a", 0.9)]
    assert [r["id"] for r in rules.layer_errors(layers).collect()] == ["p/c"]
    f = files_frame(spark, [("s", "a.py", "# expect: p/a\n# expect: p/z\nx\ny  # expect-ok: p/a\n")])
    got = rulecheck.expectations(f)
    assert {(r["line"], r["rule_id"], r["positive"]) for r in got.collect()} == {
        (3, "p/a", True), (3, "p/z", True), (4, "p/a", False)}
    assert rulecheck.coverage_gaps(got, loaded).count() == 0


def test_stored_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_FOLDERS", [])
    kept = session.stored(spark.range(3), "kept")
    folder = Path(session._FOLDERS[0])
    assert kept.count() == 3 and folder.is_dir()
    session.shared_folder(spark, "never-written")
    assert session.drop_stored(spark) == 1 and not folder.exists() and session._FOLDERS == []
