"""Nothing is left out silently: whole contents, and an unknown row for what could not be read."""
import io
import zipfile

import duckdb
from aicensus.operators import artifacts, manifests, rule_scan, rules
from aicensus.plans import pipeline
from aicensus.queries import registry
from aicensus.sources import files
from helpers import files_frame
from pyspark.sql import functions as F

STACKED = b"\x80\x04\x8c\x02os\x94\x8c\x06system\x94h\x00h\x01\x93."


def test_files_read_in_part_are_unknown(spark):
    f = files_frame(spark, [("s", "requirements.txt", "openai==1\n" * 20), ("s", "go.mod", "x")])
    _, unknowns = pipeline.detect(f, [], max_bytes=50)
    assert [(r["path"], r["reason"]) for r in unknowns.collect()] == [("requirements.txt", "read 50 of 200 bytes")]
    assert pipeline.detect(f, [])[1].count() == 0


def test_large_archives_and_any_opcode(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a/data.pkl", STACKED)
        z.writestr("a/data/0", bytes(2 << 20))
    f = files.prepare(files_frame(spark, [("s", "m/x.pt", box.getvalue())]))
    assert artifacts.artifact_facts(f).first()["globals"] == ["os.system"]
    assert artifacts.pickle_globals(b"I1\n0cos\nsystem\n.") == ["os.system"]
    assert artifacts.pickle_globals(b"\x80\x04F1.5\n\x8c\x02os\x94K\x010\x8c\x06system\x93.") == ["os.system"]


def test_broken_headers_and_manifests_are_unknown(spark):
    f = files_frame(spark, [("s", "a.safetensors", (99).to_bytes(8, "little") + b"{}"), ("s", "b.safetensors", b"x"),
                            ("s", "c.safetensors", (3).to_bytes(8, "little") + b"no!"), ("s", "package.json", '{"dependencies": {"openai": "1"')])
    _, unknowns = pipeline.detect(f, [])
    assert sorted((r["path"], r["reason"]) for r in unknowns.collect()) == [
        ("a.safetensors", "the header is cut off"), ("b.safetensors", "no header"), ("c.safetensors", "the header does not parse"),
        ("package.json", "the manifest is no JSON object")]


def test_package_json_lines_and_strings(spark):
    f = files_frame(spark, [("s", "package.json", '{"openai": "1", "dependencies":\n{"a":"file:{x}","openai":\n "2"}, "x": {"dependencies": {"no": "1"}}}')])
    assert sorted((r["declared"], r["line"], r["version"]) for r in manifests.npm_deps(f).collect()) == [
        ("a", 2, "file:{x}"), ("openai", 2, "2")]


def test_package_json_with_repeated_keys(spark):
    texts = {
        "a": '{"dependencies":{"a":"1",\n"openai":"2",\n"a":"3"}}',
        "b": '{"scripts":{"t":"1","t":"2"},"dependencies":{"openai":{"x":1,"x":2}},"devDependencies":{"openai":"4","openai":null}}',
        "c": '{"dependencies":{"a":"1"},"x":1,\n"dependencies":{"b":"2"}} ',
        "cut": '{"dependencies":{"a":"1","a":"2"}', "list": '[{"dependencies":{"a":"1"}}]', "quotes": "{'dependencies':{'a':'1'}}"}
    f = files_frame(spark, [(s, "package.json", t) for s, t in texts.items()])
    assert sorted((r["scan_id"], r["declared"], r["line"], r["version"]) for r in manifests.npm_deps(f).collect()) == [
        ("a", "a", 3, "3"), ("a", "openai", 2, "2"), ("b", "openai", 1, ""), ("b", "openai", 1, ""), ("c", "b", 2, "2")]
    assert sorted(r["scan_id"] for r in manifests.npm_unknowns(f).collect()) == ["cut", "list", "quotes"]


CALL = dict(id="sdk/call", kind="library", provider="", languages=["python"], keywords=["chat.create"], pattern=r"chat\.create\(",
            regions=["code"], claim={"name": "acme"}, within_lines=3, param_names=["temperature", "top_p"], confidence=0.7)


def test_parameters_around_a_call(spark):
    source = ('model_id: str = "gpt-x"\nother = "a"; other = "b"\nn = 4 // 2\n"temperature = 9"\nr = chat.create(\n  model=model_id,\n'
              '  temperature=\n    0.5, top_p=other)\n# temperature=7\ntemperature = 0.1\n')
    filler = "".join(f"v{i} = {i}\n" for i in range(5000))
    f = files.classify(files_frame(spark, [("s", "a.py", source), ("s", "b.py", filler + source), ("s", "c.py", "nothing here")]))
    rows = rule_scan.scan_rules(f, rules.load_rules(rules.rules_from(spark, [CALL]))).orderBy("path").collect()
    assert [(r["path"], r["line"]) for r in rows] == [("a.py", 5), ("b.py", 5005)]
    for r in rows:
        assert r["fields"] == {"model": "gpt-x", "param.temperature": "0.5", "param.top_p": "other"}


def test_documents_are_scanned_for_all_they_name(spark, tmp_path):
    """License names, token literals, email and IPv4 addresses, alone in a document or with others; as its SQL tells."""
    texts = ["é 10.0.0.1, 192.168.1.254\nversion 1.2.3\n8.8.8.8", f'MIT, token  = "{"0f" * 20}"\nto a.b@c.example or 1.2.3.4', "1.2.3", "", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["rule_scan_documents"](spark, str(tmp_path)).collect()
    got = sorted((r["path"], r["line"], r["rule_id"], r["n"], r["col"]) for r in rows)
    assert got == [
        ("doc_0.txt", 1, "docs/ipv4", 2, 3), ("doc_0.txt", 3, "docs/ipv4", 1, 1), ("doc_1.txt", 1, "docs/license", 1, 1),
        ("doc_1.txt", 1, "docs/token", 1, 6), ("doc_1.txt", 2, "docs/email", 1, 4), ("doc_1.txt", 2, "docs/ipv4", 1, 21)]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"select path, line, rule_id, n, col from ({registry.ORACLES['rule_scan_documents']})").fetchall()) == got


def test_one_corpus_scan_and_user_detectors(spark):
    f = files_frame(spark, [("s", "requirements.txt", "openai==1\n"), ("s", "notes.md", "\n  our model: x1\n")])

    def notes(rows):
        return rows.filter("path = 'notes.md'").select(
            "scan_id", "path", F.lit("ai-config").alias("kind"), F.lit("x1").alias("name"), F.lit("user/notes").alias("detector_id"),
            F.lit("filename").alias("method"), F.lit(0.5).alias("confidence"), F.lit(2).alias("line"), F.lit(0).alias("col"))

    findings, _ = pipeline.detect(f, [], user_detectors=(notes,))
    got = {r["name"]: r["snippet"] for r in findings.collect()}
    assert got == {"openai": "openai==1", "x1": "our model: x1"}
    plan = findings._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # only stored tables are read again
