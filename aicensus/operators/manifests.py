"""Dependency extraction from eight manifest formats, and the package catalog.

Each reader turns routed files into dependency rows (declared name, lookup key, version,
line); one shared step looks the keys up. State that runs down a file (sections, blocks) is a
fold over the lines inside the file's row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_version, json_object, lines_of, pep503, snippet, strip
from ..sources.files import text_of
from ..sources.routing import routed
from .xml_elements import xml_elements

DECLARED_CONFIDENCE = 0.95

# Known packages (ecosystem, key, kind, provider, canonical name).
CATALOG = [
    ("pypi", "langchain", "framework", "LangChain", ""),
    ("pypi", "langchain-core", "framework", "LangChain", ""),
    ("pypi", "langchain-community", "framework", "LangChain", ""),
    ("pypi", "llama-index", "framework", "LlamaIndex", ""),
    ("pypi", "haystack-ai", "framework", "deepset", ""),
    ("pypi", "dspy-ai", "framework", "", ""),
    ("pypi", "crewai", "framework", "", ""),
    ("pypi", "pyautogen", "framework", "Microsoft", ""),
    ("pypi", "autogen", "framework", "Microsoft", ""),
    ("pypi", "semantic-kernel", "framework", "Microsoft", ""),
    ("pypi", "transformers", "framework", "Hugging Face", ""),
    ("pypi", "sentence-transformers", "library", "Hugging Face", ""),
    ("pypi", "torch", "framework", "PyTorch", ""),
    ("pypi", "tensorflow", "framework", "Google", ""),
    ("pypi", "vllm", "framework", "", ""),
    ("pypi", "mlflow", "framework", "", ""),
    ("pypi", "guidance", "framework", "", ""),
    ("pypi", "outlines", "framework", "", ""),
    ("pypi", "onnxruntime", "library", "Microsoft", ""),
    ("pypi", "openai", "library", "OpenAI", ""),
    ("pypi", "tiktoken", "library", "OpenAI", ""),
    ("pypi", "anthropic", "library", "Anthropic", ""),
    ("pypi", "google-generativeai", "library", "Google", ""),
    ("pypi", "google-genai", "library", "Google", ""),
    ("pypi", "cohere", "library", "Cohere", ""),
    ("pypi", "mistralai", "library", "Mistral AI", ""),
    ("pypi", "groq", "library", "Groq", ""),
    ("pypi", "voyageai", "library", "Voyage AI", ""),
    ("pypi", "instructor", "library", "", ""),
    ("pypi", "litellm", "library", "", ""),
    ("pypi", "chromadb", "vector-db", "Chroma", ""),
    ("pypi", "pinecone-client", "vector-db", "Pinecone", ""),
    ("pypi", "qdrant-client", "vector-db", "Qdrant", ""),
    ("pypi", "weaviate-client", "vector-db", "Weaviate", ""),
    ("pypi", "faiss-cpu", "vector-db", "Meta", ""),
    ("pypi", "faiss-gpu", "vector-db", "Meta", ""),
    ("pypi", "pymilvus", "vector-db", "Milvus", ""),
    ("pypi", "redis", "vector-db", "Redis", ""),
    ("pypi", "pgvector", "vector-db", "", ""),
    ("npm", "openai", "library", "OpenAI", ""),
    ("npm", "@anthropic-ai/sdk", "library", "Anthropic", ""),
    ("npm", "@google/generative-ai", "library", "Google", ""),
    ("npm", "langchain", "framework", "LangChain", ""),
    ("npm", "llamaindex", "framework", "LlamaIndex", ""),
    ("npm", "ai", "library", "Vercel", ""),
    ("npm", "cohere-ai", "library", "Cohere", ""),
    ("npm", "@mistralai/mistralai", "library", "Mistral AI", ""),
    ("npm", "groq-sdk", "library", "Groq", ""),
    ("npm", "@pinecone-database/pinecone", "vector-db", "Pinecone", ""),
    ("npm", "chromadb", "vector-db", "Chroma", ""),
    ("npm", "@qdrant/js-client-rest", "vector-db", "Qdrant", ""),
    ("npm", "weaviate-ts-client", "vector-db", "Weaviate", ""),
    ("npm", "onnxruntime-node", "library", "Microsoft", ""),
    ("npm", "@xenova/transformers", "framework", "Hugging Face", ""),
    ("golang", "github.com/sashabaranov/go-openai", "library", "OpenAI", ""),
    ("golang", "github.com/tmc/langchaingo", "framework", "LangChain", ""),
    ("golang", "github.com/philippgille/chromem-go", "vector-db", "Chroma", ""),
    ("golang", "github.com/pinecone-io/go-pinecone", "vector-db", "Pinecone", ""),
    ("golang", "github.com/qdrant/go-client", "vector-db", "Qdrant", ""),
    ("golang", "github.com/milvus-io/milvus-sdk-go", "vector-db", "Milvus", ""),
    ("golang", "github.com/ollama/ollama", "library", "Ollama", ""),
    ("cargo", "async-openai", "library", "OpenAI", ""),
    ("cargo", "langchain-rust", "framework", "LangChain", ""),
    ("cargo", "qdrant-client", "vector-db", "Qdrant", ""),
    ("cargo", "candle-core", "framework", "Hugging Face", ""),
    ("cargo", "ort", "library", "Microsoft", ""),
    ("cargo", "tokenizers", "library", "Hugging Face", ""),
    ("nuget", "azure.ai.openai", "library", "Microsoft", "Azure.AI.OpenAI"),
    ("nuget", "openai", "library", "OpenAI", "OpenAI"),
    ("nuget", "microsoft.semantickernel", "framework", "Microsoft", "Microsoft.SemanticKernel"),
    ("nuget", "langchain", "framework", "LangChain", "LangChain"),
    ("nuget", "betalgo.openai", "library", "OpenAI", "Betalgo.OpenAI"),
    ("nuget", "pinecone.net", "vector-db", "Pinecone", "Pinecone.NET"),
    ("maven", "io.milvus:milvus-sdk-java", "vector-db", "Milvus", ""),
]
# Families of packages by key prefix, tried where no exact key matches.
CATALOG_PREFIXES = [
    ("pypi", "langchain-", "framework", "LangChain", ""),
    ("npm", "@langchain/", "framework", "LangChain", ""),
    ("maven", "dev.langchain4j:", "framework", "LangChain", ""),
    ("maven", "com.theokanning.openai-gpt3-java", "library", "OpenAI", ""),
]


def _entry(kind: str, provider: str, canon: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), F.lit(canon).alias("canon"))


def catalog_entry(ecosystem: Column, key: Column) -> Column:
    """Catalog row of a package as a struct, null when unknown. Literals only, no join."""
    table = F.create_map(*[
        x for eco, k, *rest in CATALOG for x in (F.lit(f"{eco}|{k}"), _entry(*rest))
    ])
    out = F.lit(None).cast("struct<kind:string,provider:string,canon:string>")
    for eco, prefix, *rest in reversed(CATALOG_PREFIXES):
        out = F.when((ecosystem == eco) & key.startswith(prefix), _entry(*rest)).otherwise(out)
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", ecosystem, key)), out)


def catalog_lookup(deps: DataFrame) -> DataFrame:
    """Dependency rows known to the catalog, as findings."""
    found = deps.withColumn("_e", catalog_entry(F.col("ecosystem"), F.col("key"))).filter("_e IS NOT NULL")
    return found.select(
        "scan_id", "path", "line",
        F.col("_e.kind").alias("kind"),
        F.when(F.col("_e.canon") != "", F.col("_e.canon")).otherwise(F.col("declared")).alias("name"),
        "group", "version", F.col("_e.provider").alias("provider"), "ecosystem", "detector_id",
        F.lit("manifest-analysis").alias("method"), F.lit(DECLARED_CONFIDENCE).alias("confidence"),
        snippet(F.col("source_line")).alias("snippet"),
    )


def file_lines(files: DataFrame) -> DataFrame:
    return files.select(
        "scan_id", "path", F.posexplode(lines_of(text_of(F.col("content")))).alias("_i", "raw")
    ).select("scan_id", "path", (F.col("_i") + 1).alias("line"), "raw", strip(F.col("raw")).alias("text"))


def _deps(df: DataFrame, detector_id: str, ecosystem: str, **cols: Column) -> DataFrame:
    """Project to dependency rows."""
    return df.select(
        "scan_id", "path", "line",
        F.lit(detector_id).alias("detector_id"), F.lit(ecosystem).alias("ecosystem"),
        cols.get("group", F.lit("")).alias("group"),
        cols["declared"].alias("declared"), cols["key"].alias("key"), cols["version"].alias("version"),
        cols.get("source_line", F.col("raw")).alias("source_line"),
    ).filter("key <> ''")


def requirement_name(spec: Column) -> Column:
    return F.regexp_extract(strip(F.regexp_extract(spec, "^([^;@]*)", 1)), r"^([A-Za-z0-9._-]*)", 1)


def requirement_version(spec: Column) -> Column:
    rest = F.regexp_replace(strip(F.regexp_extract(spec, "^([^;@]*)", 1)), r"^[A-Za-z0-9._-]*\s*", "")
    return clean_version(F.regexp_replace(rest, r"^\[[^\]]*\]", ""))


def _pypi(df: DataFrame, detector_id: str, name: Column, version: Column) -> DataFrame:
    key = F.regexp_replace(pep503(name), "^-+|-+$", "")
    return _deps(df, detector_id, "pypi", declared=key, key=key, version=version)


def requirements_deps(files: DataFrame) -> DataFrame:
    det = "manifest/pypi-requirements"
    lines = file_lines(routed(files, det)).filter(~F.col("text").rlike("^(#|-|$)"))
    spec = strip(F.regexp_replace("text", " #.*$", ""))
    return _pypi(lines, det, requirement_name(spec), requirement_version(spec))


def quoted(text: Column) -> Column:
    """Quoted string literals of a line, in order, without their quotes."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"\"[^\"]*\"|'[^']*'"), F.lit(0)),
        lambda q: F.substring(q, F.lit(2), F.length(q) - 2),
    )


def unquoted(text: Column) -> Column:
    """The line without its quoted literals."""
    return F.regexp_replace(text, r"\"[^\"]*\"|'[^']*'", "")


def _section(text: Column) -> Column:
    return F.when(text.startswith("["), strip(F.regexp_extract(text, r"^\[{1,2}([^\]]*)", 1)))


def _key_of(text: Column) -> Column:
    return strip(F.regexp_extract(text, "^([^=]*)=", 1))


def _value_of(text: Column) -> Column:
    return strip(F.regexp_extract(text, "^[^=]*=(.*)$", 1))


def _table_version(value: Column) -> Column:
    """Version of a TOML value: a bare string or an inline table's version."""
    inline = F.when(value.contains("version"), F.regexp_extract(value, r"version(.*)$", 1)).otherwise("")
    return clean_version(F.coalesce(F.get(quoted(F.when(value.startswith("{"), inline).otherwise(value)), F.lit(0)), F.lit("")))


def line_array(files: DataFrame) -> DataFrame:
    """scan_id, path and the lines of each file as one array of (line, raw, text)."""
    return files.select("scan_id", "path", F.transform(lines_of(text_of(F.col("content"))), lambda raw, i: F.struct(
        (i + 1).alias("line"), raw.alias("raw"), strip(raw).alias("text"))).alias("lines"))


def folded_lines(rows: DataFrame, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]],
                 entry: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """A fold over each file's lines inside its row: no line is shuffled or sorted.

    ``step`` maps the state and a line to the next state and what the line contributes (a struct of type ``entry``, or
    null). Contributions become rows, of files only whose last state is ``wanted``.
    """
    def merge(acc: Column, line: Column) -> Column:
        following, given = step(acc, line)
        kept = F.when(given.isNotNull(), F.concat(acc["out"], F.array(given))).otherwise(acc["out"])
        return F.struct(*(following.get(n, acc[n]).alias(n) for n in state), kept.alias("out"))

    zero = F.struct(*(v.alias(n) for n, v in state.items()), F.array().cast(f"array<{entry}>").alias("out"))
    out = lambda acc: acc["out"] if wanted is None else F.when(wanted(acc), acc["out"])
    return rows.select("scan_id", "path", F.explode(F.aggregate("lines", zero, merge, out)).alias("_e")).select("scan_id", "path", "_e.*")


def pyproject_deps(files: DataFrame) -> DataFrame:
    """[project] dependencies (arrays over several lines included) and poetry dependencies."""
    det = "manifest/pypi-pyproject"

    def step(at: Column, line: Column) -> tuple[dict[str, Column], Column]:
        t, raw, inside = line["text"], line["raw"], at["inside"]
        seen = F.coalesce(_section(t), at["seen"])
        # A bracket line inside an open array is not a section header.
        section = F.when(inside, at["section"]).otherwise(F.coalesce(_section(t), at["section"]))
        listing = t.rlike(r"^dependencies\s*=") & _value_of(t).contains("[")
        opens = listing & (seen == "project") & ~unquoted(_value_of(t)).contains("]")
        closes = unquoted(raw).contains("]")
        name = F.regexp_replace(_key_of(t), "^[\"']+|[\"']+$", "")
        entry = lambda kind, specs: F.struct(line["line"].alias("line"), raw.alias("raw"), F.lit(kind).alias("kind"), specs.alias("specs"))
        given = F.when(inside, entry("array", quoted(raw))).when(
            listing & (section == "project"), entry("array", quoted(_value_of(t)))).when(
            (section == "tool.poetry.dependencies") & t.contains("=") & ~t.rlike(r"^[\[#]") & ~name.isin("", "python"),
            entry("table", F.array(t)))
        return {"seen": seen, "section": section, "inside": ~closes & (inside | opens)}, given

    rows = folded_lines(line_array(routed(files, det)), {"seen": F.lit(""), "section": F.lit(""), "inside": F.lit(False)}, step,
                        "struct<line:int,raw:string,kind:string,specs:array<string>>").withColumn("spec", F.explode("specs"))
    table = F.col("kind") == "table"
    name = F.when(table, F.regexp_replace(_key_of(F.col("spec")), "^[\"']+|[\"']+$", "")).otherwise(requirement_name(F.col("spec")))
    version = F.when(table, _table_version(_value_of(F.col("spec")))).otherwise(requirement_version(F.col("spec")))
    return _pypi(rows, det, name, version)


def cargo_deps(files: DataFrame) -> DataFrame:
    det = "manifest/cargo"

    def step(at: Column, line: Column) -> tuple[dict[str, Column], Column]:
        t = line["text"]
        section = F.coalesce(_section(t), at["section"])
        given = F.when((section == "dependencies") & ~t.rlike(r"^(#|\[|$)") & t.contains("="), F.struct(line["line"], line["raw"], t.alias("text")))
        return {"section": section}, given

    rows = folded_lines(line_array(routed(files, det)), {"section": F.lit("")}, step, "struct<line:int,raw:string,text:string>")
    name = F.regexp_replace(_key_of(F.col("text")), "^[\"']+|[\"']+$", "")
    return _deps(rows, det, "cargo", declared=name, key=F.lower(name), version=_table_version(_value_of(F.col("text"))))


def gomod_deps(files: DataFrame) -> DataFrame:
    """Required modules; a trailing major-version element is dropped for the lookup only."""
    det = "manifest/gomod"

    def step(at: Column, line: Column) -> tuple[dict[str, Column], Column]:
        t = strip(F.regexp_replace(line["raw"], r"//.*$", ""))
        block = F.when(t.rlike(r"^\w+\s*\("), F.regexp_extract(t, r"^(\w+)", 1)).when(t.startswith(")"), "").otherwise(at["block"])
        body = F.when(t.rlike(r"^require\s+[^\s(]"), F.regexp_replace(t, r"^require\s+", "")).when(
            (block == "require") & ~t.rlike(r"^require\s*\("), t)
        given = F.when(body.rlike(r"^\S+\s+\S+"), F.struct(line["line"], line["raw"], body.alias("body")))
        return {"block": block}, given

    rows = folded_lines(line_array(routed(files, det)), {"block": F.lit("")}, step, "struct<line:int,raw:string,body:string>")
    path = F.regexp_replace(F.regexp_extract("body", r"^(\S+)", 1), '^"|"$', "")
    version = F.regexp_extract("body", r"^\S+\s+(\S+)", 1)
    return _deps(rows, det, "golang", declared=path, key=F.regexp_replace(path, "/v[0-9]+$", ""), version=version)


def npm_deps(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies of the top level; the line is that of the quoted name in its section.

    The file is parsed as JSON, so braces in texts and sections nested elsewhere do not matter. Of a repeated key the
    last value counts, as for npm. A name's line is the first one behind the section's key on which the quoted name
    and its value stand.
    """
    det = "manifest/npm"
    sections = ("dependencies", "devDependencies")
    # A value that is an object or a list is read as its JSON text, which is no version.
    parsed = F.from_json("_text", "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">")
    # A map read from JSON holds all entries of a repeated key, in order.
    later = lambda s, i: F.slice(F.map_keys(f"_json.{s}"), i + 2, F.size(f"_json.{s}"))
    entry = lambda s: lambda e, i: F.struct(
        F.lit(s).alias("section"), e["key"].alias("name"), e["value"].alias("spec"),
        F.array_contains(later(s, i), e["key"]).alias("repeated"))
    texts = routed(files, det).select("scan_id", "path", text_of(F.col("content")).alias("_text"))
    rows = texts.filter(json_object(F.col("_text"))).withColumn("_json", parsed).withColumn("_lines", lines_of(F.col("_text"))).select(
        "scan_id", "path", "_lines",
        F.explode(F.flatten(F.filter(F.array(*[
            F.transform(F.map_entries(f"_json.{s}"), entry(s)) for s in sections]), lambda x: x.isNotNull()))).alias("_d")).filter("NOT _d.repeated")
    name, spec = F.col("_d.name"), F.coalesce("_d.spec", F.lit(""))
    spec = F.when(spec.rlike(r"^[\[{]"), "").otherwise(spec)
    stands = lambda line, key: F.rlike(line, F.concat(F.lit(r'"\Q'), key, F.lit(r'\E"\s*:')))
    written = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))  # noqa: E731 - as JSON text
    bound = lambda line: F.rlike(line, F.concat(  # noqa: E731 - the name with its value, which may stand on the next line
        F.lit(r'"\Q'), written(name), F.lit(r'\E"\s*:\s*(?:$|"\Q'), written(F.coalesce("_d.spec", F.lit(""))), F.lit(r'\E")')))
    # What stands before the section's key on its line is not looked at.
    numbered = F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line"), F.when(
        i + 1 == F.col("_open"), F.call_function(
            "substring_index", line, F.concat(F.lit('"'), F.col("_d.section"), F.lit('"')), F.lit(-1))).otherwise(line).alias("raw")))
    opens = F.array_min(F.filter(F.transform("_lines", lambda line, i: F.when(stands(line, F.col("_d.section")), i + 1)), lambda n: n.isNotNull()))
    behind = F.filter(numbered, lambda x: (x["line"] >= F.col("_open")) & stands(x["raw"], written(name)))
    at = F.coalesce(F.get(F.filter(behind, lambda x: bound(x["raw"])), F.lit(0)), F.get(behind, F.lit(0)))
    rows = rows.withColumn("_open", F.coalesce(opens, F.lit(1))).withColumn("_at", at).withColumn(
        "line", F.coalesce("_at.line", F.lit(1)).cast("int"))
    pair = F.concat(F.lit('"'), name, F.lit('": "'), spec, F.lit('"'))
    return _deps(rows, det, "npm", declared=name, key=F.lower(name), version=clean_version(spec), source_line=pair)


def npm_unknowns(files: DataFrame) -> DataFrame:
    """Manifests that are not JSON objects."""
    text = text_of(F.col("content"))
    return routed(files, "manifest/npm").filter(~json_object(text)).select(
        "scan_id", "path", F.lit("manifest/npm").alias("detector_id"), F.lit("the manifest is no JSON object").alias("reason"))


def _text_of(kind: str, name: str) -> Column:
    return strip(F.coalesce(F.try_element_at(kind, F.lit(name)), F.lit("")))


def maven_deps(files: DataFrame) -> DataFrame:
    """Every ``dependency`` element, managed ones too; its own children only, so exclusions do not count."""
    det = "manifest/maven"
    rows = xml_elements(routed(files, det), "dependency").filter("error IS NULL")
    group, artifact, version = (_text_of("children", n) for n in ("groupId", "artifactId", "version"))
    return _deps(rows, det, "maven", declared=artifact, group=group, key=F.concat_ws(":", group, artifact),
                 version=F.when(version.startswith("${"), "").otherwise(version))


def nuget_deps(files: DataFrame) -> DataFrame:
    """Every ``PackageReference``; the version is an attribute or a child."""
    det = "manifest/nuget"
    rows = xml_elements(routed(files, det), "PackageReference").filter("error IS NULL")
    name, given = _text_of("attributes", "Include"), F.coalesce(F.try_element_at("attributes", F.lit("Version")), F.lit(""))
    version = F.when(given != "", strip(given)).otherwise(_text_of("children", "Version"))
    return _deps(rows, det, "nuget", declared=name, key=F.lower(name), version=version)


def xml_unknowns(files: DataFrame) -> DataFrame:
    """XML manifests that do not parse to their end."""
    broken = [xml_elements(routed(files, det), tag).filter("error IS NOT NULL").withColumn("detector_id", F.lit(det))
              for det, tag in (("manifest/maven", "dependency"), ("manifest/nuget", "PackageReference"))]
    return reduce(DataFrame.unionByName, broken).select("scan_id", "path", "detector_id", F.col("error").alias("reason"))


def gradle_deps(files: DataFrame) -> DataFrame:
    """group:artifact[:version] literals, else the map notation."""
    det = "manifest/gradle"
    rows = file_lines(routed(files, det))
    coords = F.filter(
        F.transform(quoted(F.col("raw")), lambda q: F.transform(F.split(q, ":"), lambda p: strip(p))),
        lambda p: F.size(p).isin(2, 3) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != ""),
    )
    after = lambda k: F.coalesce(
        F.get(quoted(F.regexp_extract("raw", rf"{k}:(.*)$", 1)), F.lit(0)), F.lit(""))
    noted = F.when(
        F.col("raw").contains("group:") & F.col("raw").contains("name:"),
        F.array(after("group"), after("name"), after("version")),
    )
    rows = rows.withColumn("_c", F.coalesce(F.get(coords, F.lit(0)), noted)).filter("_c[0] <> '' AND _c[1] <> ''")
    part = lambda i: F.coalesce(F.get("_c", F.lit(i)), F.lit(""))
    return _deps(rows, det, "maven", declared=part(1), group=part(0),
                 key=F.concat_ws(":", part(0), part(1)), version=strip(part(2)))


READERS = [
    nuget_deps, cargo_deps, gomod_deps, gradle_deps, maven_deps, npm_deps, pyproject_deps, requirements_deps,
]


def dependencies(files: DataFrame) -> DataFrame:
    """All declared dependencies. Give it staged manifest files: every reader scans its input."""
    return reduce(DataFrame.unionByName, [read(files) for read in READERS])


def dependency_findings(files: DataFrame) -> DataFrame:
    return catalog_lookup(dependencies(files))
