"""Files made of a small table's rows are work of many tasks, and what a line tells is found once."""
import pytest
from aicensus.operators import infra, literals, project, rule_scan, rulecheck
from aicensus.queries import derive, detection, overlays
from aicensus.sources import files, routing
from helpers import files_frame
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of one Parquet file each; keys and brands may be null or repeat."""
    folder = str(tmp_path_factory.mktemp("tables"))
    n = F.col("id")
    part = spark.range(0, 25_000, 1, 1).select(
        F.when(n % 1000 != 7, n - n % 2).alias("p_partkey"), F.concat(F.lit("name"), (n % 9).cast("string")).alias("p_name"),
        F.when(n % 5 > 0, F.concat(F.lit("b"), (n % 3).cast("string"))).alias("p_brand"), F.lit("T").alias("p_type"), (n % 50).cast("int").alias("p_size"))
    part.write.parquet(f"{folder}/part.parquet")
    supplier = spark.range(0, 600, 1, 1).select(n.alias("s_suppkey"), (n % 25).cast("int").alias("s_nationkey"), F.lit(0.5).alias("s_acctbal"))
    supplier.write.parquet(f"{folder}/supplier.parquet")
    return folder


def shares(rows):
    """Rows of each task that has some."""
    return sorted(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_files_of_one_parquet_file_are_dealt(spark, tables):
    built = detection.built_files(spark, tables, "part", "p_brand", "concat('f', CAST(p_partkey AS VARCHAR(10)))", "p_name")
    got = shares(built)
    assert len(got) == 3 and sum(got) == 25_000 and got[-1] <= derive.ROWS_PER_TASK
    assert built.filter("path IS NULL").count() == 25


def test_go_lines_are_read_once(spark):
    source = ('package m\nimport oa "github.com/tmc/langchaingo/llms" // x\nimport (\n  "fmt" // "github.com/milvus-io/a"\n'
              '  q "github.com/qdrant/go-client/v2"\n)\nfunc (r R) Ask() {\n  a, b := f(Model: "m1"), g(modelID = `m2`)\n}\nvar model = "m3"\n')
    rows = infra.go_findings(files.classify(files_frame(spark, [
        ("s", "a.go", source), ("s", "b.go", 'package m\nvar model = "github.com/tmc/langchaingo"\n'), ("s", "c.go", "")])))
    got = sorted((r["path"], r["line"], r["kind"], r["name"], r["symbol"]) for r in rows.collect())
    assert got == [("a.go", 2, "framework", "github.com/tmc/langchaingo", ""), ("a.go", 5, "vector-db", "github.com/qdrant/go-client", ""),
                   ("a.go", 8, "hosted-llm", "m1", "Ask"), ("a.go", 8, "hosted-llm", "m2", "Ask"), ("a.go", 10, "hosted-llm", "m3", "")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(^|\s)//.*$") <= 4


def test_large_headers_are_built_once(spark, tables):
    rows = detection.large_safetensors(spark, tables)
    got = {r["path"]: (r["tensor_count"], r["param_count"], r["metadata_format"]) for r in rows.collect()}
    assert len(got) == 600 and got["m/n40.safetensors"] == (1, 16, "pt") and got["m/n7.safetensors"] == (1, 8, "pt")
    assert len(shares(rows)) == 3
    assert "repeat(" not in rows._jdf.queryExecution().optimizedPlan().toString()


# Queries over files made of parts.
DEALT = ["call_site_params", "dockerfile_infra", "config_bindings", "compose_infra", "rule_expectations"]


@pytest.mark.parametrize("name", DEALT)
def test_part_queries_read_dealt_rows(spark, tables, name):
    assert len(detection.QUERIES[name](spark, tables).inputFiles()) >= 3


def test_manifests_are_dealt(spark, tables):
    assert len(shares(detection._manifest_files(spark, tables, "npm"))) == 3


def test_config_is_parsed_once(spark):
    given = [("s", "generation_config.json", '{"top_k": 5.0, "model": "m"}'), ("t", "generation_config.json", '{"top_k": null, "model": 5}'),
             ("u", "model_config.json", '{"x": 1, "model_name": "n"}'), ("v", "model_config.json", '{"do_sample": true')]
    rows = project.config_bindings(files.classify(files_frame(spark, given)))
    got = sorted((r["scan_id"], r["fields"], r["relations"] and r["relations"][0]["name"]) for r in rows.collect())
    assert got == [("s", {"param.top_k": "5"}, "m"), ("u", {}, "n")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 6


def test_installed_components_are_dealt(spark, tables):
    got = shares(overlays.installed(spark, tables))
    assert len(got) == 3 and sum(got) == 25_000


def test_findings_of_one_parquet_file_are_dealt(spark, tmp_path):
    n = F.col("id")
    spark.range(0, 250_000, 1, 1).select(n.alias("o_orderkey"), (n % 900).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = shares(derive.findings(spark, str(tmp_path)))
    assert len(got) == 3 and sum(got) == 250_000 and got[-1] <= derive.FINDINGS_PER_TASK


def test_lines_around_a_match_are_split_once(spark):
    """The nearest binding wins, at equal distance the one at or behind the match; an empty or unreadable value is none."""
    keys = "\n".join(f'k="v{i}"' for i in range(400))
    given = [(1, ["k"], "k=1\nx\nk=2", 1, 2, None), (2, ["k"], "k=one\nx\n\nk=''", 1, 2, [("one", "lit")]), (3, ["k", "m"], "k==3, m: (", 1, 1, None),
             (4, ["k"], keys, 10, 300, None), (5, ["k"], "k=4\x01x, k = 'b'", 7, 7, None), (6, None, None, None, 3, None)]
    rows = spark.createDataFrame([(i, w, a, f, at, dict(known or []), {"own": "x"}) for i, w, a, f, at, known in given],
                                 "i int, wanted array<string>, around string, around_line int, line int, literals map<string,string>, fields map<string,string>")
    found = rule_scan.with_parameters(rows)
    got = {r["i"]: {k: v for k, v in r["fields"].items() if k != "own"} for r in found.collect()}
    assert got == {1: {"param.k": "2"}, 2: {"param.k": "lit"}, 3: {}, 4: {"param.k": "v290"}, 5: {"param.k": "4x"}, 6: {}}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def told_once(rows):
    """No union of passes over the files, and no text of a line cut up more than once."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return "Union" not in plan and plan.count("Generate") == 1


def test_dockerfiles_are_read_in_one_pass(spark):
    text = "FROM a\nFROM vllm/vllm\nEXPOSE x 80/tcp\nENV MODEL_ID 'org/m'\nENV MODEL_ID=/x\nFROM b\nENV OLLAMA_HOST=1 MODEL_ID=n\nENV MODEL_ID=w.gguf\n"
    rows = infra.dockerfile_findings(files.classify(files_frame(spark, [
        ("s", "Dockerfile", text), (None, "a/Dockerfile", "ENV MODEL_ID k"), ("s", "Dockerfile", text), ("t", "Dockerfile", "FROM x")])))
    got = sorted((r["scan_id"] or "", r["line"], r["kind"], r["name"], r["infra"] and r["infra"]["endpoint"], r["fields"], r["snippet"]) for r in rows.collect())
    assert got == [("", 1, "hosted-llm", "k", None, None, "ENV MODEL_ID k")] + [
        row for row in [("s", 2, "infra", "vllm", "80", {"env": "MODEL_ID"}, "FROM vllm/vllm"), ("s", 4, "hosted-llm", "org/m", None, None, "ENV MODEL_ID 'org/m'"),
                        ("s", 7, "infra", "ollama", None, {"env": "MODEL_ID,OLLAMA_HOST"}, "ENV OLLAMA_HOST=1 MODEL_ID=n")] for _ in range(2)]
    assert told_once(rows) and rows._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_compose_files_are_read_in_one_pass(spark):
    text = "image: 'ollama/ollama'\n- \"81:80\"\n- MODEL_ID=m\nimage: x\nMODEL_ID: ${M}\n- 5:5\n"
    rows = infra.compose_findings(files.classify(files_frame(spark, [("s", "compose.yml", text), ("s", "compose.yml", text), ("t", None, text)])))
    got = sorted((r["scan_id"], r["line"], r["kind"], r["name"], r["infra"] and r["infra"]["endpoint"], r["fields"], r["snippet"]) for r in rows.collect())
    assert got == [row for row in [("s", 1, "infra", "ollama", "81", {"env": "MODEL_ID"}, "image: 'ollama/ollama'"),
                                   ("s", 3, "hosted-llm", "m", None, None, "- MODEL_ID=m")] for _ in range(2)]
    assert told_once(rows) and rows._jdf.queryExecution().optimizedPlan().toString().count("^([0-9]+)(?:/[^:]*)?(?::|$)") == 1


def test_selectors_are_evaluated_once(spark):
    """Files that nobody reads are left out without a second look at the paths; rows may repeat, paths may be null."""
    paths = ["a/package.json", "x/Dockerfile", "m.BIN", "README", None, "", "a/package.json", "b/prompts/c.py", "web.csproj"]
    given = files.classify(files_frame(spark, [("s", p, b"\x80" if p == "m.BIN" else "t") for p in paths]))
    routed = routing.with_routes(given, {"longer": F.length("path") > 9})
    assert routed.columns == [*given.columns, routing.ROUTES]
    assert [r[routing.ROUTES] for r in routed.collect()] == [
        "|manifest/npm|longer|", "|infra/dockerfile|longer|", "|modelfilex/torch|", "", "", "", "|manifest/npm|longer|",
        "|prompt/file|ruleengine|longer|", "|manifest/nuget|longer|"]
    held = routing.read_by_some(routed)
    assert held.columns == routed.columns and held.count() == 6
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index(") == 1 and plan.count("manifest/npm") == 1


def test_annotations_are_found_inside_the_file(spark):
    """A standalone annotation means the next line that is none, behind the last line at the end; no line is shuffled."""
    text = "// expect: a\n  # expect-ok: b\nx # expect: c\n\n# expect: d\n# expect: e\n"
    given = files_frame(spark, [("s", "f", text), ("s", "f", text), (None, None, "#expect: z"), ("s", "g", "plain")])
    found = rulecheck.expectations(given)
    got = sorted((r["scan_id"] or "", r["line"], r["rule_id"], r["positive"]) for r in found.collect())
    assert got == [("", 2, "z", True)] + [row for row in [
        ("s", 3, "a", True), ("s", 3, "b", False), ("s", 3, "c", True), ("s", 7, "d", True), ("s", 7, "e", True)] for _ in range(2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_few_literals_are_searched_for():
    index = literals.LiteralIndex([b"chat.create", b"gguf"])
    assert index.candidates(b"nothing of it") == [0, 1] and index.present(b"a gguf") == [1] and not index.any(b"")


def test_matches_are_not_broadcast(spark, tables):
    plan = detection.rule_expectations(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
