"""Queries over files: preparation, rule scans, manifests, classifiers, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_glob
from ..operators import artifacts, assets, infra, manifests, project, rule_scan, rulecheck, rules
from ..plans import pipeline
from ..reports import tables
from ..schemas import FINDINGS, conform
from ..session import shared_folder, stored
from ..sources import files as files_mod
from ..sources import k8s, layers, routing
from .derive import LARGE_ROWS_PER_TASK, ROWS_PER_TASK, duck_sql, pick, spark_sql, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = duck_sql(sql)
        return fn
    return add


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files_mod.from_text(d, F.col("source"), path, F.col("text"))


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    path = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))
    return files_mod.from_text(p, F.lit("pages"), path, F.col("html"))


def built_files(spark: SparkSession, sf: str, name: str, scan: str, path: str, text: str) -> DataFrame:
    """Files whose path and text are SQL expressions over a driver table."""
    return _built(spread(table(spark, sf, name)), scan, path, text)


def _built(given: DataFrame, scan: str, path: str, text: str) -> DataFrame:
    rows = given.selectExpr(
        f"{spark_sql(scan)} AS s", f"{spark_sql(path)} AS p", f"{spark_sql(text)} AS t")
    return files_mod.classify(
        files_mod.from_text(rows, F.col("s"), F.col("p"), F.col("t")).withColumn("truncated", F.lit(False)))


# ── file table ───────────────────────────────────────────────────────────────

_EXT = pick("doc_id", [".py", ".TS", ".go", ".txt", ".yaml", "", ".tar.kts"])
_LANG = pick("doc_id", ["python", "typescript", "go", "", "yaml", "", "kotlin"])
_DIR = pick("IDIV(doc_id, 7)", ["src/", "node_modules/x/", "a/.git/", "vendor/", "venv2/", ""])


@query(
    f"SELECT source AS scan_id, concat({_DIR}, 'd', doc_id, {_EXT}) AS path, octet_length(encode(text)) AS size, "
    f"sha256(text) AS sha256, false AS truncated, {_LANG} AS language, contains(text, chr(0)) AS is_binary "
    f"FROM documents WHERE {_DIR} IN ('src/', 'venv2/', '')")
def file_table(spark, sf):
    raw = built_files(spark, sf, "documents", "source", f"concat({_DIR}, 'd', CAST(doc_id AS STRING), {_EXT})", "text")
    return files_mod.prepare(raw.select("scan_id", "path", "size", "mod_time", "content")).select(
        "scan_id", "path", "size", "sha256", "truncated", "language", "is_binary")


_PATHS = ("concat(" + pick("p_partkey", ["src/", "a/prompts/", "prompts/", "a/b/", ""]) + ", 'f', "
          "CAST(p_partkey AS VARCHAR(10)), " + pick("IDIV(p_partkey, 5)", [".py", ".js", ".j2", ".ts", ".prompt.txt"]) + ")")


@query(
    f"SELECT path, regexp_matches(path, '^(.*/)?prompts/.*$') AS in_prompts, regexp_matches(path, '^src/[^/]*[.]py$') AS src_py, "
    f"regexp_matches(path, '[.][jt]s$') AS js_or_ts, regexp_matches(path, '^a/[^/]+/f[0-9][^/]*$') AS one_deep "
    f"FROM (SELECT {_PATHS} AS path FROM part)")
def path_globs(spark, sf):
    p = F.col("path")
    return table(spark, sf, "part").selectExpr(f"{spark_sql(_PATHS)} AS path").select(
        "path", matches_glob(p, "**/prompts/**").alias("in_prompts"), matches_glob(p, "src/*.py").alias("src_py"),
        matches_glob(p, "**/*.[jt]s").alias("js_or_ts"), matches_glob(p, "a/*/f[0-9]*").alias("one_deep"))


_NAMES = ["requirements.txt", "sub/requirements-dev.txt", "package.json", "go.mod", "x/Dockerfile", "prompts/a.md",
          "m/model.gguf", "d/train.csv", "src/main.go", "web/app.csproj", "README"]
_ROUTES = {
    "requirements.txt": ["manifest/pypi-requirements"], "sub/requirements-dev.txt": ["manifest/pypi-requirements"],
    "package.json": ["manifest/npm"], "go.mod": ["manifest/gomod"], "x/Dockerfile": ["infra/dockerfile"],
    "prompts/a.md": ["prompt/file"], "m/model.gguf": ["modelfile/gguf"], "d/train.csv": ["dataset/file"],
    "src/main.go": ["gosrc/ast", "ruleengine"], "web/app.csproj": ["manifest/nuget"], "README": [],
}


@query(
    "SELECT scan_id, detector_id, count(*) AS n_files FROM (SELECT p_brand AS scan_id, "
    + pick("p_partkey", _NAMES) + " AS path FROM part) JOIN (VALUES "
    + ", ".join(f"('{p}', '{d}')" for p, ds in _ROUTES.items() for d in ds)
    + ") r(path, detector_id) USING (path) GROUP BY ALL")
def routing_counts(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", pick("p_partkey", _NAMES), "p_name")
    return routing.route(f).groupBy("scan_id", "detector_id").agg(F.count("*").alias("n_files"))


_MAGIC = ["47475546AA", "894844460D0A1A0A00", "0000000054464C33", "504B0304", "08AA", "8002", "41"]


@query("SELECT p_partkey, " + pick("p_partkey", ["gguf", "hdf5", "tflite", "zip", "onnx-protobuf", "pickle", ""])
       + " AS magic_id, p_partkey % 7 IN (1, 2) AS is_binary FROM part")
def magic_ids(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.unhex(F.expr(pick("p_partkey", _MAGIC))).alias("content"))
    c = F.col("content")
    return raw.select("p_partkey", files_mod.magic_of(c).alias("magic_id"), files_mod.is_binary(c).alias("is_binary"))


# ── rules ────────────────────────────────────────────────────────────────────

DOC_RULES = [
    {"id": "docs/license", "kind": "dataset", "provider": "spdx", "keywords": ["apache", "gpl", "cc by", "mit"],
     "pattern": r"(?P<model>Apache-2\.0|GPL-3|CC BY-NC|MIT)", "claim": {"name": "${model}"}, "confidence": 0.7},
    {"id": "docs/token", "kind": "service", "provider": "vault", "keywords": ["token  ="],
     "pattern": r"token\s*=\s*\"(?P<model>[0-9a-f]{40})\"", "claim": {"name": "${model}"}, "confidence": 0.8},
    {"id": "docs/email", "kind": "service", "provider": "mail", "keywords": ["@"],
     "pattern": r"[A-Za-z0-9._]+@(?P<model>[A-Za-z0-9.]+)", "claim": {"name": "${model}"}, "confidence": 0.6},
]
# What the scan of documents looks for: the rules above and IPv4 addresses.
SCAN_RULES = [
    *DOC_RULES,
    {"id": "docs/ipv4", "kind": "service", "provider": "", "keywords": ["."],
     "pattern": r"(?P<model>[0-9]{1,3}(?:\.[0-9]{1,3}){3})", "claim": {"name": "${model}"}, "confidence": 0.5},
]
PAGE_RULES = [
    {"id": "pages/script", "kind": "infra", "provider": "js", "keywords": ["<SCRIPT"], "pattern": r"<script[^>]*>",
     "claim": {"name": "script"}, "confidence": 0.7},
    {"id": "pages/lang", "kind": "dataset", "provider": "", "keywords": ["lang="],
     "pattern": r"<html lang=\"(?P<model>[a-z]+)\"", "claim": {"name": "lang-${model}"}, "confidence": 0.6},
    {"id": "pages/link", "kind": "service", "provider": "", "keywords": ["href="],
     "pattern": r"href=\"/(?P<model>[A-Za-z]+)[^\"]*\"", "claim": {"name": "${model}"}, "confidence": 0.5},
]


def _load(spark, given):
    return rules.load_rules(rules.effective_rules(rules.rules_from(spark, given)))


def _plain(pattern: str) -> str:
    return pattern.replace("?P<model>", "").replace("'", "''")


def _hits(src: str, given: list[dict]) -> str:
    """One row per (line, rule) with its matches, in SQL."""
    lines = f"SELECT scan_id, path, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({src})"
    per_rule = " UNION ALL ".join(
        f"SELECT scan_id, path, line, '{r['id']}' AS rule_id, line_text, regexp_extract_all(line_text, '{_plain(r['pattern'])}', 0) AS found, "
        + (f"regexp_extract_all(line_text, '{_plain(r['pattern'])}', 1)" if "?P" in r["pattern"] else "[]")
        + f" AS groups FROM l WHERE regexp_matches(line_text, '{_plain(r['pattern'])}')" for r in given)
    return f"WITH l AS MATERIALIZED ({lines}), h AS ({per_rule}) "


_DOC_SRC = "SELECT source AS scan_id, 'doc_' || doc_id || '.txt' AS path, text FROM documents"
_PAGE_SRC = "SELECT 'pages' AS scan_id, 'page_' || page_id || '.html' AS path, html AS text FROM pages"
_PER_LINE = ("SELECT scan_id, path, CAST(line AS INT) AS line, rule_id, CAST(len(found) AS BIGINT) AS n, "
             "CAST(strpos(line_text, found[1]) AS INT) AS col FROM h")


def _per_line(matches: DataFrame) -> DataFrame:
    rule = F.regexp_replace("detector_id", "^rules/", "")
    return matches.groupBy("scan_id", "path", "line", rule.alias("rule_id")).agg(
        F.count("*").alias("n"), F.min("col").alias("col"))


@query(_hits(_DOC_SRC, SCAN_RULES) + _PER_LINE)
def rule_scan_documents(spark, sf):
    f = files_mod.classify(document_files(spark, sf))
    return _per_line(rule_scan.scan_rules(f, _load(spark, SCAN_RULES), any_language=True))


@query(_hits(_PAGE_SRC, PAGE_RULES) + _PER_LINE)
def rule_scan_pages(spark, sf):
    f = files_mod.classify(page_files(spark, sf))
    return _per_line(rule_scan.scan_rules(f, _load(spark, PAGE_RULES), any_language=True))


@query(_hits(_PAGE_SRC, PAGE_RULES) + _PER_LINE)
def line_matches_pages(spark, sf):
    f = files_mod.classify(page_files(spark, sf))
    m = rules.match_lines(f, _load(spark, PAGE_RULES))
    return m.groupBy("scan_id", "path", "line", "rule_id").agg(F.count("*").alias("n"), F.min("col").alias("col"))


@query(_hits(_DOC_SRC, DOC_RULES)
       + "SELECT scan_id, rule_id, name, count(*) AS n FROM (SELECT scan_id, rule_id, unnest(groups) AS name FROM h) GROUP BY ALL")
def claim_names(spark, sf):
    f = files_mod.classify(document_files(spark, sf))
    loaded = _load(spark, DOC_RULES)
    got = rules.claim_findings(rules.match_lines(f, loaded), loaded)
    return got.groupBy("scan_id", F.regexp_replace("detector_id", "^rules/", "").alias("rule_id"), "name").agg(
        F.count("*").alias("n"))


_FOLD = "lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query("SELECT scan_id, path, rule_id FROM (" + " UNION ALL ".join(
    f"SELECT scan_id, path, '{r['id']}' AS rule_id FROM f WHERE " + " OR ".join(
        f"contains(folded, '{' '.join(k.split()).lower()}')" for k in r["keywords"]) for r in DOC_RULES)
    + ")")
def keyword_candidates(spark, sf):
    return rules.candidate_rules(files_mod.classify(document_files(spark, sf)), _load(spark, DOC_RULES), any_language=True)


ORACLES["keyword_candidates"] = (
    f"WITH f AS (SELECT scan_id, path, {_FOLD} AS folded FROM ({_DOC_SRC})) " + ORACLES["keyword_candidates"])

CAP_RULES = [{"id": "docs/le", "kind": "prompt", "provider": "", "keywords": ["LE"], "pattern": "(?P<model>le)",
              "claim": {"name": "${model}"}, "confidence": 0.5}]


@query("SELECT source AS scan_id, 'doc_' || doc_id || '.txt' AS path, "
       "CAST(least(200, len(regexp_extract_all(text, 'le'))) AS BIGINT) AS n FROM documents WHERE contains(text, 'le')")
def match_cap(spark, sf):
    f = files_mod.classify(document_files(spark, sf))
    return rule_scan.scan_rules(f, _load(spark, CAP_RULES), any_language=True, cap=200).groupBy("scan_id", "path").agg(
        F.count("*").alias("n"))


_LAYERS = ("SELECT concat('pack/', p_brand, '-', p_size % 7) AS id, CAST(p_partkey AS INT) AS layer_seq, "
           "p_partkey % 5 = 0 AS disable, p_name AS pattern FROM part")


@query(f"SELECT id, layer_seq, pattern FROM ({_LAYERS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer_seq DESC) = 1 "
       "AND NOT disable")
def effective_rules(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "concat('pack/', p_brand, '-', CAST(p_size % 7 AS STRING)) AS id", "CAST(p_partkey AS INT) AS layer_seq",
        "p_partkey % 5 = 0 AS disable", "p_name AS pattern")
    return rules.effective_rules(rows).select("id", "layer_seq", "pattern")


# Source text per part: regions, bindings and variables of a call site.
_CALL = (
    "concat('# model = \"commented-', CAST(p_partkey AS VARCHAR(10)), '\"', chr(10), "
    "'BASE = \"base-', CAST(p_size AS VARCHAR(10)), '\"', chr(10), "
    "'note = \"\"\" client.chat.create( \"\"\"', chr(10), "
    "'r = client.chat.create(', chr(10), '    model=', CASE WHEN p_partkey % 2 = 0 THEN 'BASE' ELSE concat('\"lit-', CAST(p_size AS VARCHAR(10)), '\"') END, "
    "',', chr(10), '    temperature=0.', CAST(p_partkey % 9 AS VARCHAR(10)), ',', chr(10), ')', chr(10))"
)
CALL_RULES = [
    {"id": "sdk/call", "kind": "library", "provider": "acme", "languages": ["python"], "keywords": ["chat.create"],
     "pattern": r"\.chat\.create\s*\(", "regions": ["code"], "claim": {"name": "acme"},
     "relations": [{"type": "uses", "target_kind": "hosted-llm", "from_field": "model"}],
     "within_lines": 4, "param_names": ["temperature", "top_p"], "confidence": 0.7},
]


@query("SELECT p_brand AS scan_id, 'f' || p_partkey || '.py' AS path, 4 AS line, 11 AS col, "
       "CASE WHEN p_partkey % 2 = 0 THEN 'base-' ELSE 'lit-' END || p_size AS model, '0.' || (p_partkey % 9) AS temperature, "
       "'r = client.chat.create(' AS snippet FROM part")
def call_site_params(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", "concat('f', CAST(p_partkey AS VARCHAR(10)), '.py')", _CALL)
    m = rule_scan.scan_rules(f, _load(spark, CALL_RULES))
    return m.select("scan_id", "path", "line", "col", F.try_element_at("fields", F.lit("model")).alias("model"),
                    F.try_element_at("fields", F.lit("param.temperature")).alias("temperature"), "snippet")


_NOTED = ("concat('# expect: sdk/call', chr(10), CASE WHEN p_partkey % 4 = 0 THEN 'x = 1' ELSE 'r = client.chat.create(' END, chr(10), "
          "'y = \"client.chat.create(\"  # expect-ok: sdk/call', chr(10))")


@query("SELECT 'f' || p_partkey || '.py' AS path, 2 AS line, 'sdk/call' AS rule_id, 'annotated line is not matched' AS reason "
       "FROM part WHERE p_partkey % 4 = 0")
def rule_expectations(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", "concat('f', CAST(p_partkey AS VARCHAR(10)), '.py')", _NOTED)
    loaded = _load(spark, CALL_RULES)
    return rulecheck.failures(rulecheck.expectations(f), rule_scan.scan_rules(f, loaded), loaded).select(
        "path", "line", "rule_id", "reason")


# ── manifests: text built from part, expected rows by construction ───────────

_V = "concat('1.', CAST(p_size AS VARCHAR(10)))"
_MANIFESTS = {
    "requirements": ("requirements.txt", f"concat('# c', chr(10), 'openai==', {_V}, chr(10), 'numpy', chr(10), "
                     f"'LangChain_Community[x] >= ', {_V}, ',<9 ; python_version > \"3\"', chr(10), '-e .')",
                     manifests.requirements_deps,
                     [(2, "pypi", "", "openai", _V), (3, "pypi", "", "numpy", "''"), (4, "pypi", "", "langchain-community", _V)]),
    "pyproject": ("pyproject.toml", f"concat('[project]', chr(10), 'dependencies = [', chr(10), '  \"torch>=', {_V}, '\",', chr(10), "
                  f"'  \"vllm[extra]\",', chr(10), ']', chr(10), '[tool.poetry.dependencies]', chr(10), 'python = \"^3\"', chr(10), "
                  f"'Mlflow = {{ version = \"^', {_V}, '\" }}', chr(10), '[other]', chr(10), 'x = \"1\"')",
                  manifests.pyproject_deps,
                  [(3, "pypi", "", "torch", _V), (4, "pypi", "", "vllm", "''"), (8, "pypi", "", "mlflow", _V)]),
    "npm": ("package.json", f"concat('{{\"name\": \"x\",', chr(10), '\"dependencies\": {{\"openai\": \"^', {_V}, '\", \"left\": \"*\"}},', chr(10), "
            f"'\"devDependencies\": {{', chr(10), '  \"@LangChain/core\": \"', {_V}, '\"', chr(10), '}}}}')",
            manifests.npm_deps,
            [(2, "npm", "", "openai", _V), (2, "npm", "", "left", "''"), (4, "npm", "", "@langchain/core", _V)]),
    "gomod": ("go.mod", f"concat('module m', chr(10), 'require github.com/ollama/ollama v', {_V}, chr(10), 'require (', chr(10), "
              f"'  github.com/qdrant/go-client/v2 v', {_V}, ' // indirect', chr(10), ')', chr(10), 'exclude (', chr(10), '  a/b v1', chr(10), ')')",
              manifests.gomod_deps,
              [(2, "golang", "", "github.com/ollama/ollama", f"concat('v', {_V})"),
               (4, "golang", "", "github.com/qdrant/go-client", f"concat('v', {_V})")]),
    "cargo": ("Cargo.toml", f"concat('[package]', chr(10), 'ort = \"no\"', chr(10), '[dependencies]', chr(10), 'ort = \"', {_V}, '\"', chr(10), "
              f"'Tokenizers = {{ version = \"', {_V}, '\", features = [] }}')", manifests.cargo_deps,
              [(4, "cargo", "", "ort", _V), (5, "cargo", "", "tokenizers", _V)]),
    "maven": ("pom.xml", f"concat('<project>', chr(10), '<!-- <dependency> -->', chr(10), '<dependency>', chr(10), '<groupId>io.milvus</groupId>', "
              f"'<artifactId>milvus-sdk-java</artifactId><version>', {_V}, '</version>', chr(10), '</dependency><dependency><groupId> dev.langchain4j </groupId>"
              f"<artifactId>core</artifactId><version>${{v}}</version></dependency>')", manifests.maven_deps,
              [(3, "maven", "io.milvus", "io.milvus:milvus-sdk-java", _V), (5, "maven", "dev.langchain4j", "dev.langchain4j:core", "''")]),
    "gradle": ("build.gradle", f"concat('implementation \"io.milvus:milvus-sdk-java:', {_V}, '\"', chr(10), "
               f"'api group: \"dev.langchain4j\", name: \"core\", version: \"', {_V}, '\"')", manifests.gradle_deps,
               [(1, "maven", "io.milvus", "io.milvus:milvus-sdk-java", _V), (2, "maven", "dev.langchain4j", "dev.langchain4j:core", _V)]),
    "nuget": ("app.csproj", f"concat('<Project>', chr(10), '<PackageReference Include=\"OpenAI\" Version=\"', {_V}, '\" />', chr(10), "
              f"'<PackageReference Include=\"Pinecone.NET\">', chr(10), '<Version>', {_V}, '</Version></PackageReference>')", manifests.nuget_deps,
              [(2, "nuget", "", "openai", _V), (3, "nuget", "", "pinecone.net", _V)]),
}


def _manifest_files(spark, sf, name):
    base, text, *_ = _MANIFESTS[name]
    base_dir = "concat('p', CAST(p_partkey AS VARCHAR(10)), '/"
    return built_files(spark, sf, "part", "p_brand", f"{base_dir}{base}')", text)


def _manifest_query(name: str):
    base, _, reader, expected = _MANIFESTS[name]

    def run(spark, sf):
        return reader(_manifest_files(spark, sf, name)).select(
            "scan_id", "path", "line", "ecosystem", "group", "key", "version")

    run.__name__ = f"{name}_deps"
    sql = " UNION ALL ".join(
        f"SELECT p_brand AS scan_id, concat('p', p_partkey, '/{base}') AS path, {line} AS line, '{eco}' AS ecosystem, "
        f"'{group}' AS \"group\", '{key}' AS key, {version} AS version FROM part"
        for line, eco, group, key, version in expected)
    return query(sql)(run)


for _name in _MANIFESTS:
    _manifest_query(_name)


# Shapes of a manifest, dealt to the rows by their key: text (@ stands for the row's version), expected (line, key, version).
_SHAPES = {
    "npm": ("package.json", manifests.npm_deps, [
        ('{"dependencies":{"a":"file:{x}","openai":"@"}}', [(1, "a", "file:{x}"), (1, "openai", "@")]),
        ('{\n "config": {"dependencies": {"no": "1"}},\n "dependencies": {\n  "openai": "^@"\n }\n}', [(4, "openai", "@")]),
        ('{\r\n"devDependencies":{\r\n"x y":"~@",\r\n"B/c" : "@"\r\n}}', [(3, "x y", "@"), (4, "b/c", "@")]),
        ('{"name":"n","dependencies":{},"devDependencies":null}', []),
        ('{"dependencies": {"openai": "@"', []),
        ('', []),
        ('{"openai": "1", "dependencies":\n{"say \\"hi\\"": "1", "openai":\n "@"}}', [(2, 'say "hi"', "1"), (2, "openai", "@")]),
        ('{"dependencies":{"openai":"0","openai":"@"},\n"devDependencies":{"openai":"@"}}', [(1, "openai", "@"), (2, "openai", "@")]),
    ]),
    "requirements": ("requirements.txt", manifests.requirements_deps, [
        ("openai==@", [(1, "openai", "@")]),
        ("# openai==1\n\n-r other.txt\nOpenAI >= @\n", [(4, "openai", "@")]),
        ("openai[extra]==@ ; python_version < '4'\r\nnumpy\r\n", [(1, "openai", "@"), (2, "numpy", "")]),
        ("  some_pkg.name~=@   # why\n", [(1, "some-pkg-name", "@")]),
        ("pkg ; x\n", [(1, "pkg", "")]),
        ("", []),
        ("a==@\nb==@\na==@", [(1, "a", "@"), (2, "b", "@"), (3, "a", "@")]),
        ("--index-url https://x\nchromadb", [(2, "chromadb", "")]),
    ]),
    "pyproject": ("pyproject.toml", manifests.pyproject_deps, [
        ('[project]\ndependencies = ["torch>=@", \'vllm[x]\']\n', [(2, "torch", "@"), (2, "vllm", "")]),
        ('[project]\nname = "x"\ndependencies = [\n  "Torch.Audio == @",\n\n  # "no",\n]\nother = ["z"]\n', [(4, "torch-audio", "@"), (6, "no", "")]),
        ('[project]\ndependencies = [\n  "a[b]>=@",\n  "c",\n]\n[other]\ndependencies = ["d"]', [(3, "a", "@"), (4, "c", "")]),
        ('[tool.poetry.dependencies]\npython = "^3"\nopenai = "^@"\n# x = "1"\nll = { git = "g" }\n[x]\ny = "1"', [(3, "openai", "@"), (5, "ll", "")]),
        ('[tool.poetry.dependencies]\r\n"quoted" = {extras = ["e"], version = "~@"}\r\n', [(2, "quoted", "@")]),
        ('dependencies = ["none"]\n[build]\ndependencies = ["none"]', []),
        ('', []),
        ('[project]\ndependencies = [\n"x ; y",\n[\n"z==@"]\n[tool.poetry.dependencies]\nq="@"', [(3, "x", ""), (5, "z", "@"), (7, "q", "@")]),
    ]),
    "gomod": ("go.mod", manifests.gomod_deps, [
        ("require a/b v@", [(1, "a/b", "v@")]),
        ("module m\n\nrequire (\n\ta/b v@ // indirect\n\tc/d/v3 v@\n)\n", [(4, "a/b", "v@"), (5, "c/d", "v@")]),
        ("exclude (\n a/b v1\n)\nrequire (\n c/d v@\n)\nreplace e/f => g/h v1", [(5, "c/d", "v@")]),
        ("require(\n a/b v@\n)", [(2, "a/b", "v@")]),
        ("// require a/b v1\nrequire  c/d   v@ // require e/f v2", [(2, "c/d", "v@")]),
        ("module only\ngo 1.22\n", []),
        ("", []),
        ('require (\r\n "a/b/v2" v@\r\n c\r\n)\r\nrequire d/e v@', [(2, "a/b", "v@"), (5, "d/e", "v@")]),
    ]),
    "cargo": ("Cargo.toml", manifests.cargo_deps, [
        ('[dependencies]\nort = "@"', [(2, "ort", "@")]),
        ('[package]\nort = "1"\n[dependencies]\nCandle-Core = { version = "@", features = ["x"] }\n[dev-dependencies]\nno = "1"', [(4, "candle-core", "@")]),
        ('[dependencies]\n# a = "1"\n\nb = "^@"\n[dependencies.c]\nversion = "1"', [(4, "b", "@")]),
        ('[dependencies] # c\n"d" = "=@"', [(2, "d", "@")]),
        ('[workspace.dependencies]\ne = "1"', []),
        ('[dependencies]\nf = { path = "../f" }\ng = { git = "h" }', [(2, "f", ""), (3, "g", "")]),
        ('', []),
        ('[dependencies]\r\ni = "@"\r\n[x]\r\nj = "1"\r\n[dependencies]\r\nk="@"', [(2, "i", "@"), (6, "k", "@")]),
    ]),
    "maven": ("pom.xml", manifests.maven_deps, [
        ('<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>@</version></dependency></dependencies></project>',
         [(1, "g:a", "@")]),
        ('<?xml version="1.0" encoding="UTF-8"?>\n<m:project xmlns:m="urn:x">\n<m:dependency>\n<m:groupId> g </m:groupId>\n<m:artifactId>a</m:artifactId>\n</m:dependency></m:project>',
         [(3, "g:a", "")]),
        ('<project><dependencyManagement><dependencies>\n<dependency><artifactId><![CDATA[a]]></artifactId><groupId>g&#46;h</groupId>'
         '<version>@</version></dependency></dependencies></dependencyManagement></project>', [(2, "g.h:a", "@")]),
        ('<p><dependency>\n<exclusions><exclusion><groupId>no</groupId></exclusion></exclusions><groupId>g</groupId><artifactId>a</artifactId>'
         '<version>${v}</version></dependency></p>', [(1, "g:a", "")]),
        ('<p><!-- <dependency><groupId>no</groupId></dependency> -->\n<dependency\n>\n<groupId>g</groupId><artifactId>a</artifactId><version>@</version></dependency></p>',
         [(3, "g:a", "@")]),
        ('<p>\n<dependency><groupId>g</groupId><artifactId>a</artifactId><version>@</version></dependency>\n<dependency><groupId>h</groupId></p>', [(2, "g:a", "@")]),
        ('', []),
        ('<p><plugin><dependency><groupId>g</groupId><groupId>h</groupId><artifactId>a</artifactId><version>1<x>2</x>@</version></dependency></plugin></p>',
         [(1, "h:a", "1@")]),
    ]),
    "nuget": ("app.csproj", manifests.nuget_deps, [
        ('<Project><ItemGroup><PackageReference Include="OpenAI" Version="@" /></ItemGroup></Project>', [(1, "openai", "@")]),
        ('<Project>\n<PackageReference Include="A.B">\n<Version> @ </Version>\n</PackageReference></Project>', [(2, "a.b", "@")]),
        ("<Project xmlns='urn:m'>\n<PackageReference\n  Version='@'\n  Include='x &amp; y'/></Project>", [(4, "x & y", "@")]),
        ('<Project><PackageReference Update="u" Version="1"/><PackageReference Include="v"/></Project>', [(1, "v", "")]),
        ('<Project><!-- <PackageReference Include="no"/> --><PackageReference Include="w" Version=""><Version>@</Version></PackageReference></Project>', [(1, "w", "@")]),
        ('<Project>\n<PackageReference Include="x" Version="@"/>\n<PackageReference Include="y"', [(2, "x", "@")]),
        ('not xml', []),
        ('<Project><PackageReference Include="z>" Version="@">\n<PrivateAssets>all</PrivateAssets></PackageReference></Project>', [(1, "z>", "@")]),
    ]),
    "gradle": ("build.gradle", manifests.gradle_deps, [
        ("implementation 'g:a:@'", [(1, "g:a", "@")]),
        ('dependencies {\n  api("g:a:@")\n  testImplementation "h:b"\n}', [(2, "g:a", "@"), (3, "h:b", "")]),
        ("api group: 'g', name: 'a', version: '@'", [(1, "g:a", "@")]),
        ("compile group:'g',name:'a'", [(1, "g:a", "")]),
        ("implementation 'g:a:@:classifier'\nid 'java'", []),
        ("", []),
        ("implementation ' g : a : @ '\r\nimplementation ':b:1'", [(1, "g:a", "@")]),
        ("implementation project(':x')\nruntimeOnly 'g:a:@', 'h:b:1'", [(2, "g:a", "@")]),
    ]),
}


def _shape_version(version: str) -> str:
    before, at, behind = version.partition("@")
    return f"concat({before!r}, {_V}, {behind!r})" if at else repr(version)


def _shapes_query(name: str):
    base, reader, shapes = _SHAPES[name]

    def run(spark, sf):
        version = F.concat(F.lit("1."), F.col("p_size").cast("string"))
        text = F.coalesce(*[F.when(F.col("p_partkey") % len(shapes) == i, F.replace(F.lit(t), F.lit("@"), version))
                            for i, (t, _) in enumerate(shapes)])
        path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(f"/{base}"))
        f = files_mod.classify(files_mod.from_text(table(spark, sf, "part"), F.col("p_brand"), path, text))
        return reader(f).select("scan_id", "path", "line", "key", "version")

    run.__name__ = f"{name}_shapes"
    sql = " UNION ALL ".join(
        f"SELECT p_brand AS scan_id, concat('p', p_partkey, '/{base}') AS path, {line} AS line, '{key}' AS key, "
        f"{_shape_version(version)} AS version FROM part WHERE p_partkey % {len(shapes)} = {i}"
        for i, (_, rows) in enumerate(shapes) for line, key, version in rows)
    return query(sql)(run)


for _name in _SHAPES:
    _shapes_query(_name)


@query(" UNION ALL ".join(
    f"SELECT p_brand AS scan_id, {line} AS line, '{kind}' AS kind, '{name}' AS name, '{prov}' AS provider, {_V} AS version FROM part"
    for line, kind, name, prov in ((2, "library", "openai", "OpenAI"), (4, "framework", "langchain-community", "LangChain"))))
def catalog_lookup(spark, sf):
    deps = manifests.requirements_deps(_manifest_files(spark, sf, "requirements"))
    return manifests.catalog_lookup(deps).select("scan_id", "line", "kind", "name", "provider", "version")


_SPEC = "concat(" + pick("p_partkey", ["==", ">= ", "^", "~=", "", "*"]) + ", CASE WHEN p_partkey % 6 = 5 THEN '' ELSE concat('1.', CAST(p_size AS VARCHAR(10))) END, " \
        + pick("IDIV(p_partkey, 6)", ["", ",<9", " ; x", "|2", "  # c"]) + ")"


@query(f"SELECT p_partkey, {_SPEC} AS spec, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE '1.' || p_size END AS version FROM part")
def clean_versions(spark, sf):
    from ..functions.text import clean_version
    return table(spark, sf, "part").selectExpr("p_partkey", f"{spark_sql(_SPEC)} AS spec").withColumn(
        "version", clean_version(F.col("spec")))


# ── classifiers ──────────────────────────────────────────────────────────────

_PPATH = "concat(" + pick("conv_id", ["prompts/", "src/", "a/prompts/b/", "tmpl/"]) + ", 'c', CAST(conv_id AS VARCHAR(10)), '_', CAST(turn AS VARCHAR(10)), " \
         + pick("IDIV(conv_id, 4)", [".txt", ".j2", ".prompt", ".py", ".prompt.txt"]) + ")"
_PTEXT = "concat(" + pick("turn", ["", "You are a judge. ", "{{ x }} role: user ", "{% for %} assistants "]) + ", text)"


@query(
    f"WITH t AS (SELECT role AS scan_id, {_PPATH} AS path, {_PTEXT} AS text FROM conversations), "
    "c AS (SELECT *, lower(text) AS low, contains(text, '{{') OR contains(text, '{%') AS tpl FROM t "
    "WHERE regexp_matches(path, '[.]prompt$') OR regexp_matches(path, '(^|/)prompts/') OR regexp_matches(path, '[.](prompt[.]txt|j2)$')), "
    "d AS (SELECT *, contains(low, 'you are a') OR contains(low, 'your task is') OR contains(low, '###instruction') OR contains(low, '### instruction') "
    "OR tpl AND (regexp_matches(low, '\\brole\\b[\"'']?\\s*(?:==|!=|=|:|\\bin\\b)\\s*[\\[(\"'']*\\s*(?:system|user|assistant)\\b') "
    "OR regexp_matches(low, '(^|[^a-z0-9_])assistant([^a-z0-9_]|$)') OR (regexp_matches(low, '(^|[^a-z0-9_])messages([^a-z0-9_]|$)') "
    "AND regexp_matches(low, '(^|[^a-z0-9_])role([^a-z0-9_]|$)'))) AS sure, "
    "regexp_matches(path, '(^|/)prompts?/') OR contains(regexp_extract(path, '[^/]*$'), 'prompt') AS named FROM c WHERE NOT regexp_matches(path, '[.]py$')) "
    "SELECT scan_id, path, CASE WHEN sure THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence, CASE WHEN sure THEN 'config-analysis' ELSE 'filename' END AS method, "
    "CASE WHEN tpl THEN 'prompt-template' ELSE 'prompt' END AS format FROM d WHERE sure OR named")
def prompt_assets(spark, sf):
    f = built_files(spark, sf, "conversations", "role", _PPATH, _PTEXT)
    return assets.prompt_findings(f).select("scan_id", "path", "confidence", "method", F.col("data.format").alias("format"))


_DPATH = "concat(" + pick("IDIV(doc_id, 3)", ["data/", "x/", "y/Corpora/z/", ""]) + ", " + pick("IDIV(doc_id, 5)", ["train", "part", "test-linux"]) \
         + ", " + pick("doc_id", [".csv", ".jsonl", ".csv", ".parquet"]) + ")"
_DHEAD = pick("IDIV(doc_id, 2)", ["Prompt,other", "text,Label ", "text,x", "id;name"])
_DTEXT = (f"CASE WHEN doc_id % 4 = 1 THEN CASE WHEN IDIV(doc_id, 2) % 2 = 0 THEN '{{\"messages\": [], \"a\": 1}}' ELSE '{{\"text\": 1, \"b\": 2}}' END "
          f"WHEN doc_id % 4 = 3 THEN CASE WHEN IDIV(doc_id, 2) % 2 = 0 THEN 'PAR1xx' ELSE 'nope' END ELSE concat({_DHEAD}, chr(10), text) END")


@query(
    f"WITH t AS (SELECT source AS scan_id, doc_id, {_DPATH} AS path, doc_id % 4 IN (0, 2) AND IDIV(doc_id, 2) % 4 IN (0, 1) OR "
    "doc_id % 4 = 1 AND IDIV(doc_id, 2) % 2 = 0 AS fields, doc_id % 4 = 3 AND IDIV(doc_id, 2) % 2 = 0 AS magic, "
    "IDIV(doc_id, 3) % 4 IN (0, 2) OR IDIV(doc_id, 5) % 3 = 0 AS named FROM documents) "
    "SELECT scan_id, path, CASE WHEN (fields OR magic) AND named THEN 0.85::DOUBLE WHEN fields THEN 0.75 WHEN magic THEN 0.7 ELSE 0.65 END AS confidence, "
    "CASE WHEN fields THEN 'source-code-analysis' WHEN magic THEN 'binary-analysis' ELSE 'filename' END AS method, "
    "regexp_extract(path, '[a-z]+$') AS format FROM t WHERE fields OR magic OR named")
def dataset_files(spark, sf):
    f = built_files(spark, sf, "documents", "source", _DPATH, _DTEXT)
    return assets.dataset_findings(f).select("scan_id", "path", "confidence", "method", F.col("data.format").alias("format"))


_DOCKER = ("concat('FROM python:3', chr(10), 'EXPOSE 1', chr(10), 'FROM ', " + pick("p_partkey", [
    "ollama/ollama:1", "vllm/vllm-openai", "nvidia/tritonserver:2", "alpine"])
    + ", ' AS s', chr(10), 'EXPOSE x ', CAST(8000 + p_size AS VARCHAR(10)), '/tcp', chr(10), 'ENV OLLAMA_HOST=0 MODEL_ID=y', chr(10), "
      "'ENV MODEL_ID \"m-', CAST(p_size AS VARCHAR(10)), '\"', chr(10), 'FROM scratch', chr(10), 'EXPOSE 9')")


# Shapes of service files: text, expected (line, tool or model, confidence, endpoint, env).
_INFRA_SHAPES = {
    "dockerfile": ("Dockerfile", infra.dockerfile_findings, [
        ("FROM ollama/ollama\nEXPOSE 1@\n", [(1, "ollama", 0.75, "1@", "")]),
        ("from vllm/vllm-openai:v1 as a\nENV MODEL_ID=org/m@\nFROM alpine\nEXPOSE 9\nENV HUGGING_FACE_HUB_TOKEN x",
         [(1, "vllm", 0.75, "", "MODEL_ID"), (2, "org/m@", 0.6, "", "")]),
        ("FROM ollama/ollama\nFROM ollama/ollama\nEXPOSE 7", [(1, "ollama", 0.75, "", "")]),
        ("# c\nFROM python\nENV OLLAMA_HOST=x\nEXPOSE 80/tcp 90", [(3, "ollama", 0.7, "80", "OLLAMA_HOST")]),
        ("ENV OLLAMA_HOST=0\nEXPOSE 1@\nFROM ollama/ollama\nEXPOSE 3", [(1, "ollama", 0.7, "1@", "OLLAMA_HOST")]),
        ("FROM scratch\nRUN x", []),
        ("", []),
        ("FROM nvidia/tritonserver\r\nFROM rayproject/ray\r\n  EXPOSE 1@/udp 5\r\nENV MODEL_ID ${X}", [(1, "triton", 0.75, "", ""), (2, "ray", 0.75, "1@", "MODEL_ID")]),
    ]),
    "compose": ("compose.yml", infra.compose_findings, [
        ("services:\n  a:\n    image: ollama/ollama\n    ports:\n      - '1@:80'\n", [(3, "ollama", 0.75, "1@", "")]),
        ("image: vllm/vllm\nenvironment:\n  - MODEL_ID=m@\nimage: x\n  - 5:5", [(1, "vllm", 0.75, "", "MODEL_ID"), (3, "m@", 0.6, "", "")]),
        ("image: 'rayproject/ray'\nimage: rayproject/ray\n- 9:9", [(1, "ray", 0.75, "", "")]),
        ("# image: ollama/ollama\nOLLAMA_HOST: x", []),
        ("image: nvidia/tritonserver\n- 1@/tcp:4\n- 6:6\nHUGGING_FACE_HUB_TOKEN: t", [(1, "triton", 0.75, "1@", "HUGGING_FACE_HUB_TOKEN")]),
        ("MODEL_ID: /local/path\n", []),
        ("", []),
        ("image:ollama/ollama\r\nMODEL_ID: \"q@\"\r\n", [(1, "ollama", 0.75, "", "MODEL_ID"), (2, "q@", 0.6, "", "")]),
    ]),
}


def _infra_shapes_query(name: str):
    base, reader, shapes = _INFRA_SHAPES[name]

    def run(spark, sf):
        size = F.col("p_size").cast("string")
        text = F.coalesce(*[F.when(F.col("p_partkey") % len(shapes) == i, F.replace(F.lit(t), F.lit("@"), size))
                            for i, (t, _) in enumerate(shapes)])
        path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(f"/{base}"))
        f = files_mod.classify(files_mod.from_text(table(spark, sf, "part"), F.col("p_brand"), path, text))
        return reader(f).select("scan_id", "path", "line", "name", "confidence", F.coalesce("infra.endpoint", F.lit("")).alias("endpoint"),
                                F.coalesce(F.try_element_at("fields", F.lit("env")), F.lit("")).alias("env"))

    run.__name__ = f"{name}_shapes"
    filled = lambda v: "concat({0!r}, CAST(p_size AS VARCHAR), {2!r})".format(*v.partition("@")) if "@" in v else repr(v)
    sql = " UNION ALL ".join(
        f"SELECT p_brand AS scan_id, concat('p', p_partkey, '/{base}') AS path, {line} AS line, {filled(tool)} AS name, {sure}::DOUBLE AS confidence, "
        f"{filled(endpoint)} AS endpoint, {env!r} AS env FROM part WHERE p_partkey % {len(shapes)} = {i}"
        for i, (_, rows) in enumerate(shapes) for line, tool, sure, endpoint, env in rows)
    return query(sql)(run)


for _name in _INFRA_SHAPES:
    _infra_shapes_query(_name)


@query(
    "SELECT scan_id, path, line, kind, name, confidence, endpoint, env FROM ("
    "SELECT p_brand AS scan_id, 'd' || p_partkey || '/Dockerfile' AS path, CASE WHEN p_partkey % 4 = 3 THEN 5 ELSE 3 END AS line, 'infra' AS kind, "
    + pick("p_partkey", ["ollama", "vllm", "triton", "ollama"]) + " AS name, CASE WHEN p_partkey % 4 = 3 THEN 0.7::DOUBLE ELSE 0.75::DOUBLE END AS confidence, "
    "CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(8000 + p_size AS VARCHAR) END AS endpoint, 'MODEL_ID,OLLAMA_HOST' AS env FROM part "
    "UNION ALL SELECT p_brand, 'd' || p_partkey || '/Dockerfile', 6, 'hosted-llm', 'm-' || p_size, 0.6, NULL, NULL FROM part)")
def dockerfile_infra(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", "concat('d', CAST(p_partkey AS VARCHAR(10)), '/Dockerfile')", _DOCKER)
    return infra.dockerfile_findings(f).select(
        "scan_id", "path", "line", "kind", "name", "confidence", F.col("infra.endpoint").alias("endpoint"),
        F.try_element_at("fields", F.lit("env")).alias("env"))


_COMPOSE = ("concat('services:', chr(10), '  a:', chr(10), '    image: \"', " + pick("p_partkey", [
    "ollama/ollama", "redis", "rayproject/ray:2"]) + ", '\"', chr(10), '    ports:', chr(10), '      - \"', CAST(9000 + p_size AS VARCHAR(10)), ':80\"', chr(10), "
    "'    environment:', chr(10), '      - \"MODEL_ID=', CASE WHEN p_partkey % 5 = 0 THEN '/w/x.gguf' ELSE 'gpt-x' END, '\"', chr(10), '    image: nginx', chr(10), '      - 1:2')")


@query(
    "SELECT p_brand AS scan_id, 'c' || p_partkey || '/compose.yml' AS path, 3 AS line, 'infra' AS kind, "
    + pick("p_partkey", ["ollama", "none", "ray"]) + " AS name, CAST(9000 + p_size AS VARCHAR) AS endpoint, 'MODEL_ID' AS env FROM part WHERE p_partkey % 3 <> 1 "
    "UNION ALL SELECT p_brand, 'c' || p_partkey || '/compose.yml', 7, 'hosted-llm', 'gpt-x', NULL, NULL FROM part WHERE p_partkey % 5 <> 0")
def compose_infra(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", "concat('c', CAST(p_partkey AS VARCHAR(10)), '/compose.yml')", _COMPOSE)
    return infra.compose_findings(f).select(
        "scan_id", "path", "line", "kind", "name", F.col("infra.endpoint").alias("endpoint"),
        F.try_element_at("fields", F.lit("env")).alias("env"))


_GO = ("concat('package main', chr(10), 'import (', chr(10), '  \"fmt\"', chr(10), '  oa \"', " + pick("p_partkey", [
    "github.com/sashabaranov/go-openai", "github.com/tmc/langchaingo/llms", "os"]) + ", '\"', chr(10), ')', chr(10), "
    "'func Ask() {', chr(10), '  r := R{Model: \"m-', CAST(p_size AS VARCHAR(10)), '\"}', chr(10), '  modelName == \"no\"', chr(10), '}', chr(10))")


@query(
    "SELECT p_brand AS scan_id, 'g' || p_partkey || '.go' AS path, 4 AS line, " + pick("p_partkey", ["library", "framework", "x"]) + " AS kind, "
    + pick("p_partkey", ["github.com/sashabaranov/go-openai", "github.com/tmc/langchaingo", "x"]) + " AS name, '' AS symbol FROM part WHERE p_partkey % 3 <> 2 "
    "UNION ALL SELECT p_brand, 'g' || p_partkey || '.go', 7, 'hosted-llm', 'm-' || p_size, 'Ask' FROM part WHERE p_partkey % 3 <> 2")
def go_usage(spark, sf):
    f = built_files(spark, sf, "part", "p_brand", "concat('g', CAST(p_partkey AS VARCHAR(10)), '.go')", _GO)
    return infra.go_findings(f).select("scan_id", "path", "line", "kind", "name", "symbol")


# ── artifacts: bytes built from rows ─────────────────────────────────────────


def _binary_files(spark, sf, name: str, path: str, content, per_task: int = ROWS_PER_TASK) -> DataFrame:
    rows = spread(table(spark, sf, name), per_task).withColumn("path", F.expr(path)).withColumn("content", content)
    built = rows.select(
        F.lit("models").alias("scan_id"), "path", F.length("content").cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"), "content")
    # Filters on a header would be moved in front of the content and build a large one again wherever they use it.
    return files_mod.prepare(stored(built, "large-files") if per_task < ROWS_PER_TASK else built)


def _le(value, width: int):
    """Little-endian bytes of an integer column."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


@query(
    "SELECT 'm/e' || vec_id || '.safetensors' AS path, 3 AS tensor_count, CAST((vec_id + 1) * 4 + 6 * (label + 1) AS BIGINT) AS param_count, "
    "CASE WHEN (vec_id + 1) * 4 >= 6 * (label + 1) THEN 'BF16' ELSE 'F32' END AS dtype, 'pt' AS metadata_format, 'arch' || label AS architecture FROM embeddings")
def safetensors_facts(spark, sf):
    doc = F.concat(
        F.lit('{"__metadata__": {"format": "pt", "model_type": "arch'), F.col("label").cast("string"),
        F.lit('"}, "a": {"dtype": "BF16", "shape": [4, '), (F.col("vec_id") + 1).cast("string"),
        F.lit('], "data_offsets": [0, 1]}, "b": {"dtype": "F32", "shape": [2, 3, '), (F.col("label") + 1).cast("string"),
        F.lit(']}, "c": {"dtype": "F32", "shape": [-1]}}'))
    content = F.concat(_le(F.length(doc), 8), F.encode(doc, "UTF-8"), F.unhex(F.lit("00FF")))
    f = _binary_files(spark, sf, "embeddings", "concat('m/e', CAST(vec_id AS STRING), '.safetensors')", content)
    return artifacts.safetensors_facts(routing.routed(f, "modelfile/safetensors")).select(
        "path", "tensor_count", "param_count", "dtype", "metadata_format", "architecture")


def _gguf_text(key: str, value):
    return F.concat(_le(F.lit(len(key)), 8), F.encode(F.lit(key), "UTF-8"), _le(F.lit(8), 4),
                    _le(F.length(value), 8), F.encode(value, "UTF-8"))


def _gguf_int(key: str, value):
    return F.concat(_le(F.lit(len(key)), 8), F.encode(F.lit(key), "UTF-8"), _le(F.lit(4), 4), _le(value, 4))


@query(
    "SELECT 'm/g' || p_partkey || '.gguf' AS path, 'gguf' AS format, 'arch-' || p_size AS architecture, " + pick("p_partkey", ["F32", "F16", "ftype_99"])
    + " AS quantization, CASE WHEN p_partkey % 4 = 0 THEN '__class__,os.system' END AS risk_detail, 0.95::DOUBLE AS confidence FROM part")
def gguf_artifacts(spark, sf):
    template = F.when(F.col("p_partkey") % 4 == 0, F.lit("{{ x.__class__ }} os.system")).otherwise(F.lit("hi"))
    kind = F.when(F.col("p_partkey") % 3 == 2, 99).otherwise(F.col("p_partkey") % 3)
    content = F.concat(
        F.unhex(F.lit("47475546")), _le(F.lit(3), 4), _le(F.lit(0), 8), _le(F.lit(3), 8),
        _gguf_text("general.architecture", F.concat(F.lit("arch-"), F.col("p_size").cast("string"))),
        _gguf_int("general.file_type", kind), _gguf_text("tokenizer.chat_template", template))
    f = _binary_files(spark, sf, "part", "concat('m/g', CAST(p_partkey AS STRING), '.gguf')", content)
    out = artifacts.walked_findings(artifacts.artifact_facts(f), artifacts.savedmodel_ops(f))
    return out.select("path", F.col("model.format").alias("format"), F.col("model.architecture").alias("architecture"),
                      F.col("model.quantization").alias("quantization"),
                      F.array_join(F.get("risks", F.lit(0))["detail"], ",").alias("risk_detail"), "confidence")


@query(
    "SELECT 'm/p' || p_partkey || '.bin' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'os.system' WHEN p_partkey % 3 = 1 THEN 'subprocess.run' END AS risk_detail, "
    "CASE WHEN p_partkey % 3 < 2 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM part")
def pickle_artifacts(spark, sf):
    direct = F.encode(F.lit("cos\nsystem\n."), "UTF-8")
    stacked = F.concat(F.unhex(F.lit("8C0A")), F.encode(F.lit("subprocess"), "UTF-8"), F.unhex(F.lit("8C03")),
                       F.encode(F.lit("run"), "UTF-8"), F.unhex(F.lit("932E")))
    benign = F.encode(F.lit("ccollections\nOrderedDict\n."), "UTF-8")
    key = F.col("p_partkey") % 3
    content = F.concat(F.unhex(F.lit("8002")), F.when(key == 0, direct).when(key == 1, stacked).otherwise(benign))
    f = _binary_files(spark, sf, "part", "concat('m/p', CAST(p_partkey AS STRING), '.bin')", content)
    return artifacts.walked_findings(artifacts.artifact_facts(f)).select(
        "path", F.array_join(F.get("risks", F.lit(0))["detail"], ",").alias("risk_detail"), "confidence")


@query(
    "SELECT 'm/o' || p_partkey || '.onnx' AS path, CAST(p_size AS VARCHAR) AS ir_version, 'prod' AS producer_name, 'true' AS graph FROM part WHERE p_size < 128")
def onnx_artifacts(spark, sf):
    content = F.concat(F.unhex(F.lit("08")), _le(F.col("p_size"), 1), F.unhex(F.lit("1204")), F.encode(F.lit("prod"), "UTF-8"),
                       F.unhex(F.lit("3A0100")))
    f = _binary_files(spark, sf, "part", "concat('m/o', CAST(p_partkey AS STRING), '.onnx')", content)
    fact = lambda k: F.try_element_at("facts", F.lit(k)).alias(k)
    return artifacts.artifact_facts(f).select("path", fact("ir_version"), fact("producer_name"), fact("graph"))


@query(
    "SELECT 'm' || p_partkey || " + pick("p_partkey", [".h5", ".tflite", ".engine"]) + " AS path, " + pick("p_partkey", ["hdf5", "tflite", "tensorrt"])
    + " AS format, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'Lambda' END AS risk_detail FROM part")
def signature_artifacts(spark, sf):
    key = F.col("p_partkey") % 3
    lam = F.when(F.col("p_size") % 2 == 0, F.encode(F.lit('{"class_name": "Lambda"}'), "UTF-8")).otherwise(F.encode(F.lit("{}"), "UTF-8"))
    content = F.when(key == 0, F.concat(F.unhex(F.lit("894844460D0A1A0A")), lam)).when(
        key == 1, F.unhex(F.lit("1C00000054464C33"))).otherwise(F.unhex(F.lit("41424344454647484950515253540080")))
    f = _binary_files(spark, sf, "part", "concat('m', CAST(p_partkey AS STRING), " + pick("p_partkey", [".h5", ".tflite", ".engine"]) + ")", content)
    return artifacts.signature_findings(f).select(
        "path", F.col("model.format").alias("format"), F.array_join(F.get("risks", F.lit(0))["detail"], ",").alias("risk_detail"))


@query(
    "SELECT 'm' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'EagerPyFunc,PyFunc' WHEN p_partkey % 2 = 1 THEN NULL END AS risk_detail FROM part WHERE p_partkey % 5 <> 0")
def savedmodel_artifacts(spark, sf):
    ops = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.unhex(F.lit("06")), F.encode(F.lit("PyFunc"), "UTF-8"), F.unhex(F.lit("0B")),
                 F.encode(F.lit("EagerPyFunc"), "UTF-8"))).otherwise(F.encode(F.lit("xPyFunc"), "UTF-8"))
    bad = F.when(F.col("p_partkey") % 5 == 0, F.unhex(F.lit("1801"))).otherwise(F.unhex(F.lit("0801")))
    content = F.concat(bad, F.unhex(F.lit("12")), _le(F.length(ops), 1), ops)
    f = _binary_files(spark, sf, "part", "concat('x/m', CAST(p_partkey AS STRING), '/saved_model.pb')", content)
    out = artifacts.walked_findings(artifacts.artifact_facts(f), artifacts.savedmodel_ops(f))
    return out.select("name", F.array_join(F.get("risks", F.lit(0))["detail"], ",").alias("risk_detail"))


# ── cross-file ───────────────────────────────────────────────────────────────


def _project_files(spark, sf) -> DataFrame:
    """Five files per part directory: configs and weights."""
    files = [
        ("config.json", "concat('{\"model_type\": \"', p_type, '\", \"architectures\": [\"A\"]', CASE WHEN p_partkey % 3 = 0 THEN ', \"_name_or_path\": \"org/m\"' ELSE '' END, '}')"),
        ("model_index.json", "'{\"_class_name\": \"Pipe\"}'"),
        ("adapter_config.json", "concat('{\"base_model_name_or_path\": \"base-', CAST(p_size AS STRING), '\", \"peft_type\": \"LORA\"}')"),
        ("generation_config.json", "concat('{\"temperature\": 0.', CAST(p_size AS STRING), ', \"top_k\": 5', CAST(p_size AS STRING), '.0, \"do_sample\": true, \"model\": \"', p_brand, '\"}')"),
    ]
    out = None
    rows = spread(table(spark, sf, "part"))
    for base, text in files:
        part = _built(rows, "p_brand", f"concat('m/p', CAST(p_partkey AS STRING), '/{base}')", text)
        out = part if out is None else out.unionByName(part)
    weights = _built(rows, "p_brand", "concat('m/p', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 "
                          "THEN '/model-1-of-2.safetensors' ELSE '/unet/x.bin' END)", "'w'")
    return out.unionByName(weights)


@query(
    "SELECT p_brand AS scan_id, CASE WHEN p_partkey % 2 = 1 THEN 'p' || p_partkey WHEN p_partkey % 3 = 0 THEN 'org/m' ELSE 'p' || p_partkey END AS name, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Pipe' END AS architecture, CASE WHEN p_partkey % 2 = 0 THEN 'safetensors' ELSE 'pytorch' END AS format FROM part")
def model_directories(spark, sf):
    return project.model_directories(_project_files(spark, sf)).select(
        "scan_id", "name", F.col("model.architecture").alias("architecture"), F.col("model.format").alias("format"))


@query("SELECT p_brand AS scan_id, 'p' || p_partkey AS name, 'base-' || p_size AS base, 'LORA' AS peft FROM part")
def adapters(spark, sf):
    return project.adapters(_project_files(spark, sf)).select(
        "scan_id", "name", F.get("relations", F.lit(0))["name"].alias("base"), F.try_element_at("fields", F.lit("peft_type")).alias("peft"))


@query(
    "SELECT p_brand AS scan_id, 'm/p' || p_partkey || '/generation_config.json' AS path, CAST(CAST('0.' || p_size AS DOUBLE) AS VARCHAR) AS temperature, "
    "'5' || p_size AS top_k, 'true' AS do_sample, p_brand AS model FROM part")
def config_bindings(spark, sf):
    f = lambda k: F.try_element_at("fields", F.lit(f"param.{k}")).alias(k)
    return project.config_bindings(_project_files(spark, sf)).select(
        "scan_id", "path", f("temperature"), f("top_k"), f("do_sample"), F.get("relations", F.lit(0))["name"].alias("model"))


# Shapes of generation configs: file, text (@ stands for a number of the row), (temperature, top_k, do_sample, model) or the failure.
_CONFIG_SHAPES = [
    ("generation_config.json", '{"temperature": 0.5, "temperature": 0.@5, "x": {"a": 1, "a": 2}, "model": "m"}', ("0.@5", "", "", "m")),
    ("model_config.yaml", "temperature: 0.@5\ntop_k: 7\nmodel: 'org/m'\n", ("0.@5", "7", "", "org/m")),
    ("my_generation_config.yml", "do_sample: true\ntop_k: '@'\n", ("", "@", "true", "")),
    ("model_config.json", '{"top_k": 40.0, "do_sample": false, "model": 5, "model_name": "n@"}', ("", "40", "false", "n@")),
    ("generation_config.json", '{"temperature": 1e-5', "the config is no JSON object"),
    ("model_config.yml", "a: [1,\nb", "the config does not parse: ParserError"),
    ("model_config.yaml", "- just\n- a list\n", "the config is no mapping"),
    ("generation_config.json", '{"other": 1}', None),
    ("x_generation_y_config.yaml", "", None),
    ("generation_config.json", '{"temperature": {"no": 1}, "top_k": null, "model": ""}', ('{"no":1}', "", "", "")),
]


def _config_files(spark, sf) -> DataFrame:
    n, size = F.col("p_partkey") % len(_CONFIG_SHAPES), F.col("p_size").cast("string")
    by_shape = lambda values: F.coalesce(*[F.when(n == i, v) for i, v in enumerate(values)])
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), by_shape([F.lit(name) for name, *_ in _CONFIG_SHAPES]))
    text = by_shape([F.replace(F.lit(t), F.lit("@"), size) for _, t, _ in _CONFIG_SHAPES])
    return files_mod.classify(files_mod.from_text(spread(table(spark, sf, "part")), F.col("p_brand"), path, text))


def _config_sql(rows: str, wanted) -> str:
    filled = lambda v: "concat({0!r}, CAST(p_size AS VARCHAR), {2!r})".format(*v.partition("@")) if "@" in v else repr(v)
    return " UNION ALL ".join(
        f"SELECT p_brand AS scan_id, concat('p', p_partkey, '/{name}') AS path, " + ", ".join(
            f"{filled(v)} AS {c}" for c, v in zip(rows.split(), wanted(found))) + f" FROM part WHERE p_partkey % {len(_CONFIG_SHAPES)} = {i}"
        for i, (name, _, found) in enumerate(_CONFIG_SHAPES) if wanted(found))


@query(_config_sql("temperature top_k do_sample model", lambda found: found if isinstance(found, tuple) else ()))
def config_shapes(spark, sf):
    """JSON and YAML configs, with repeated keys, other types and texts that do not parse."""
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(f"param.{k}")), F.lit("")).alias(k)
    return project.config_bindings(_config_files(spark, sf)).select(
        "scan_id", "path", f("temperature"), f("top_k"), f("do_sample"),
        F.coalesce(F.get("relations", F.lit(0))["name"], F.lit("")).alias("model"))


@query(_config_sql("reason", lambda found: (found,) if isinstance(found, str) else ()))
def config_unknowns(spark, sf):
    return project.config_unknowns(_config_files(spark, sf)).select("scan_id", "path", "reason")


@query(
    "WITH f AS (SELECT 'scan-' || (o_custkey % 900) AS scan_id, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'embedding-model' WHEN 1 THEN 'vector-db' ELSE 'prompt' END AS kind, "
    "'n' || (o_orderkey % 50) AS name, 'f' || (o_orderkey % 9) AS path FROM orders), "
    "m AS (SELECT scan_id, arg_min(name, path || lpad(CAST(seq AS VARCHAR), 12, '0')) FILTER (WHERE kind = 'embedding-model') AS e, arg_min(path, path || lpad(CAST(seq AS VARCHAR), 12, '0')) FILTER (WHERE kind = 'embedding-model') AS path, "
    "arg_min(name, path || lpad(CAST(seq AS VARCHAR), 12, '0')) FILTER (WHERE kind = 'vector-db') AS v FROM f GROUP BY ALL) "
    "SELECT scan_id, path, e AS embeds, v AS contains FROM m WHERE e IS NOT NULL AND v IS NOT NULL")
def rag_pipelines(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "concat('scan-', CAST(o_custkey % 900 AS STRING)) AS scan_id", "o_orderkey AS finding_seq",
        "CASE o_orderkey % 7 WHEN 0 THEN 'embedding-model' WHEN 1 THEN 'vector-db' ELSE 'prompt' END AS kind",
        "concat('n', CAST(o_orderkey % 50 AS STRING)) AS name", "concat('f', CAST(o_orderkey % 9 AS STRING)) AS path")
    return project.rag_pipelines(conform(rows, FINDINGS)).select(
        "scan_id", "path", F.get("relations", F.lit(0))["name"].alias("embeds"), F.get("relations", F.lit(1))["name"].alias("contains"))


# ── statistics over files ────────────────────────────────────────────────────


@query(
    "SELECT source AS scan_id, count(*) AS files_walked, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) FILTER (WHERE length(text) < 200) AS files_failed, "
    "count(*) FILTER (WHERE length(text) >= 200) AS files_processed FROM documents GROUP BY source")
def scan_stats(spark, sf):
    f = document_files(spark, sf)
    text = files_mod.text_of(F.col("content"))
    bad = f.filter(F.length(text) < 200).select("scan_id", "path", F.lit("det").alias("detector_id"), F.lit("short").alias("reason"))
    return tables.scan_stats(f, bad.unionByName(bad))


# ── images ───────────────────────────────────────────────────────────────────

_LAYER = {
    "image": "concat('img-', CAST(l_orderkey % 700 AS VARCHAR(10)))", "layer_idx": "l_linenumber",
    "entry_seq": "l_orderkey * 1000000 + l_partkey * 100 + l_suppkey",
    "path": "concat('./a/', " + pick("l_partkey", ["", "b/../", "c/"]) + ", CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_partkey % 11 = 0 THEN '.wh..wh..opq' "
            "WHEN l_returnflag = 'R' THEN concat('.wh.f', CAST(l_partkey % 9 AS VARCHAR(10))) ELSE concat('f', CAST(l_partkey % 9 AS VARCHAR(10))) END)",
    "type": "CASE WHEN l_quantity = 7 THEN 'dir' ELSE 'file' END",
}


@query(
    "WITH e AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _LAYER.items()) + " FROM lineitem), "
    "c AS (SELECT *, replace(replace(path, './a/b/../', 'a/'), './a/', 'a/') AS p FROM e), "
    "f AS (SELECT image, layer_idx, p AS path, min(entry_seq) AS entry_seq FROM c WHERE type = 'file' AND NOT contains(p, '.wh.') GROUP BY ALL), "
    "w AS (SELECT DISTINCT image, layer_idx, replace(p, '.wh.', '') AS path FROM c WHERE contains(p, '/.wh.f')), "
    "o AS (SELECT DISTINCT image, layer_idx, replace(p, '/.wh..wh..opq', '') AS dir FROM c WHERE contains(p, '.wh..wh..opq')) "
    "SELECT image, path, layer_idx, entry_seq FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.image = f.image AND w.path = f.path AND w.layer_idx > f.layer_idx) "
    "AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = f.image AND o.layer_idx > f.layer_idx AND starts_with(f.path, o.dir || '/')) "
    "QUALIFY row_number() OVER (PARTITION BY image, path ORDER BY layer_idx DESC) = 1")
def layer_squash(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr(*[f"{spark_sql(v)} AS {k}" for k, v in _LAYER.items()])
    return layers.visible_versions(e)


@query(
    "WITH e AS (SELECT source AS image, doc_id % 4 AS layer_idx, doc_id AS entry_seq, 'd/f' || (IDIV(doc_id, 4) % 50) AS path, text, "
    "doc_id % 11 = 0 AS gone FROM documents), "
    "f AS (SELECT image, path, max(layer_idx) AS layer_idx FROM e WHERE NOT gone GROUP BY ALL), "
    "w AS (SELECT image, path, max(layer_idx) AS out FROM e WHERE gone GROUP BY ALL) "
    "SELECT image, path, layer_idx, min(entry_seq) AS entry_seq, sha256(arg_min(text, entry_seq)) AS sha256 FROM e JOIN f USING (image, path, layer_idx) "
    "LEFT JOIN w USING (image, path) WHERE NOT gone AND (out IS NULL OR out <= layer_idx) GROUP BY ALL")
def squash_payloads(spark, sf):
    """Documents as files of image layers, some removed again: digests of the payloads that the squashed image holds."""
    name = "concat('f', CAST(IDIV(doc_id, 4) % 50 AS STRING))"
    entries = table(spark, sf, "documents").selectExpr(*map(spark_sql, (
        "source AS image", "doc_id % 4 AS layer_idx", "doc_id AS entry_seq", "'file' AS type",
        f"CASE WHEN doc_id % 11 = 0 THEN concat('./d/.wh.', {name}) ELSE concat('/d/./', {name}) END AS path", "encode(text, 'UTF-8') AS content")))
    return layers.squash_layers(entries).select("image", "path", "layer_idx", "entry_seq", F.sha2("content", 256).alias("sha256"))


@query("SELECT p_partkey, " + pick("p_partkey", ["a/c", "c", "a/b", "", "x"]) + " AS path FROM part")
def clean_paths(spark, sf):
    raw = F.expr(pick("p_partkey", ["a/./b/../c", "../../c", "/a//b/", "a/..", "\\\\\\\\x"]))
    return table(spark, sf, "part").select("p_partkey", layers.clean_path(raw).alias("path"))


def _manifests(spark, sf):
    o = table(spark, sf, "orders")
    box = F.struct(
        F.lit("c").alias("name"),
        F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("img-"), (F.col("o_custkey") % 40).cast("string"))).alias("image"),
        F.array(F.struct(F.lit("MODEL_ID").alias("name"), F.col("o_orderkey").cast("string").alias("value")),
                F.struct(F.lit("OTHER").alias("name"), F.lit("x").alias("value"))).alias("env"))
    pod = F.struct(F.array(box).alias("containers"))
    kind = F.expr(pick("o_orderkey", ["Pod", "Deployment", "CronJob", "Service"]))
    meta = F.struct(F.concat(F.lit("w"), (F.col("o_custkey") % 90).cast("string")).alias("name"),
                    F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("ns"), (F.col("o_custkey") % 3).cast("string"))).alias("namespace"))
    doc = lambda spec: F.to_json(F.struct(kind.alias("kind"), meta.alias("metadata"), spec.alias("spec")))
    body = F.when(kind == "Deployment", doc(F.struct(F.struct(pod.alias("spec")).alias("template")))).when(
        kind == "CronJob", doc(F.struct(F.struct(F.struct(F.struct(pod.alias("spec")).alias("template")).alias("spec")).alias("jobTemplate")))
    ).otherwise(doc(pod))
    return o.select(F.lit("cluster").alias("scan_id"), F.col("o_orderkey").alias("doc_order"), body.alias("doc"))


@query(
    "WITH d AS (SELECT o_orderkey, 'img-' || (o_custkey % 40) AS image, " + pick("o_orderkey", ["Pod", "Deployment", "CronJob", "Service"])
    + " || CASE WHEN o_custkey % 3 > 0 THEN '/ns' || (o_custkey % 3) ELSE '' END || '/w' || (o_custkey % 90) AS w FROM orders "
    "WHERE o_orderkey % 4 < 3 AND o_orderkey % 10 <> 0) SELECT image, count(DISTINCT w) AS workloads, min(w) AS first_workload, max(w) AS last_workload, "
    "CAST(max(o_orderkey) AS VARCHAR) AS model_id FROM d GROUP BY image")
def k8s_images(spark, sf):
    return k8s.images(_manifests(spark, sf)).select(
        "image", "workloads", "first_workload", "last_workload", F.try_element_at("signals", F.lit("MODEL_ID")).alias("model_id"))


# ── corpora, selection, risks ────────────────────────────────────────────────


@query("SELECT 'source=' || source AS scan_id, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE lang <> 'de' GROUP BY source")
def corpus_files(spark, sf):
    """Documents written as files by source and language, read as a corpus without one language's folder."""
    folder = shared_folder(spark, "corpus")
    table(spark, sf, "documents").select("text", "source", "lang").write.partitionBy("source", "lang").text(folder)
    f = files_mod.drop_ignored(files_mod.read_corpus(spark, folder), user_globs=("lang=de/**",))
    return f.groupBy("scan_id").agg(F.sum(F.length("content")).cast("bigint").alias("bytes"))


RISK_RULES = [{"id": "docs/risky", "kind": "library", "provider": "", "keywords": ["tion"], "pattern": "tion", "claim": {"name": "risky"},
               "risk": "RISK-PICKLE-IMPORT", "confidence": 0.5}]


@query("SELECT source AS scan_id, 'doc_' || doc_id || '.txt' AS path, 'RISK-PICKLE-IMPORT' AS risk_id, "
       "CAST(len(regexp_extract_all(text, 'tion')) AS BIGINT) AS n FROM documents WHERE contains(text, 'tion')")
def rule_risks(spark, sf):
    f = files_mod.classify(document_files(spark, sf))
    found = rule_scan.match_findings(rule_scan.scan_rules(f, _load(spark, RISK_RULES), any_language=True))
    return found.select("scan_id", "path", F.explode("risks").alias("r")).groupBy("scan_id", "path", F.col("r.id").alias("risk_id")).agg(
        F.count("*").alias("n"))


@query("SELECT p_brand AS scan_id, 'p' || p_partkey || '/package.json' AS path, 'manifest/npm' AS detector_id, CAST(2 AS BIGINT) AS n FROM part")
def selected_detectors(spark, sf):
    """Only the detectors that a selection expression leaves run."""
    f = _manifest_files(spark, sf, "npm").unionByName(_manifest_files(spark, sf, "cargo"))
    found, _ = pipeline.detect(f.drop("truncated", "language", "magic_id", "is_binary"), [], detectors="manifest,-manifest/cargo")
    return found.groupBy("scan_id", "path", "detector_id").agg(F.count("*").alias("n"))


# ── artifacts over one MiB ───────────────────────────────────────────────────


# Lengths that grow with the row; every fortieth is over a MiB.
_LONG = "CAST(CASE WHEN s_suppkey % 40 = 0 THEN 1100000 + s_suppkey ELSE s_suppkey * 37 % 5000 END AS INT)"


@query("SELECT 'm/n' || s_suppkey || '.gguf' AS path, 'arch-' || s_nationkey AS architecture, '__class__,os.system' AS risk_detail FROM supplier")
def gguf_long_array(spark, sf):
    """A tokenizer array, often of over a million values, stands before the template that the screen must see."""
    n, arch = F.expr(_LONG), F.concat(F.lit("arch-"), F.col("s_nationkey").cast("string"))
    key = lambda k: F.concat(_le(F.lit(len(k)), 8), F.encode(F.lit(k), "UTF-8"))
    array = F.concat(key("tokenizer.ggml.token_type"), _le(F.lit(9), 4), _le(F.lit(0), 4), _le(n, 8), F.unhex(F.repeat(F.lit("01"), n)))
    content = F.concat(
        F.unhex(F.lit("47475546")), _le(F.lit(3), 4), _le(F.lit(0), 8), _le(F.lit(3), 8), _gguf_text("general.architecture", arch), array,
        _gguf_text("tokenizer.chat_template", F.lit("{{ x.__class__ }} os.system")))
    f = _binary_files(spark, sf, "supplier", "concat('m/n', CAST(s_suppkey AS STRING), '.gguf')", content, LARGE_ROWS_PER_TASK)
    return artifacts.walked_findings(artifacts.artifact_facts(f)).select(
        "path", F.col("model.architecture").alias("architecture"), F.array_join(F.get("risks", F.lit(0))["detail"], ",").alias("risk_detail"))


@query("SELECT 'm/n' || s_suppkey || '.safetensors' AS path, 1 AS tensor_count, CAST(s_nationkey + 1 AS BIGINT) AS param_count, 'pt' AS metadata_format FROM supplier")
def large_safetensors(spark, sf):
    """Headers that grow with the row, some over a million bytes."""
    doc = F.concat(F.lit('{"__metadata__": {"format": "pt", "note": "'), F.repeat(F.lit("x"), F.expr(_LONG)), F.lit('"}, "a": {"dtype": "BF16", "shape": ['),
                   (F.col("s_nationkey") + 1).cast("string"), F.lit('], "data_offsets": [0, 1]}}'))
    content = F.concat(_le(F.length(doc), 8), F.encode(doc, "UTF-8"), F.unhex(F.lit("00FF")))
    f = _binary_files(spark, sf, "supplier", "concat('m/n', CAST(s_suppkey AS STRING), '.safetensors')", content, LARGE_ROWS_PER_TASK)
    return artifacts.safetensors_facts(routing.routed(f, "modelfile/safetensors")).select(
        "path", "tensor_count", "param_count", "metadata_format")
