"""Serving infrastructure in Dockerfiles and compose files, and Go source usage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, snippet, strip
from ..sources.files import text_of
from ..sources.routing import routed
from .manifests import folded_lines, line_array

# Image signatures in match order, and environment variables of serving tools.
IMAGE_SIGNATURES = [
    ("ollama/ollama", "ollama"),
    ("vllm/vllm-openai", "vllm"),
    ("vllm/vllm", "vllm"),
    ("huggingface/text-generation-inference", "tgi"),
    ("nvidia/tritonserver", "triton"),
    ("rayproject/ray", "ray"),
]
ENV_KEYS = ["HUGGING_FACE_HUB_TOKEN", "MODEL_ID", "OLLAMA_HOST"]
WEIGHT_SUFFIXES = r"\.(?:gguf|bin|safetensors|pt|onnx)$"

# Go import prefixes of AI clients and the kind they imply.
GO_MODULES = [
    ("github.com/sashabaranov/go-openai", "library"),
    ("github.com/tmc/langchaingo", "framework"),
    ("github.com/pinecone-io/go-pinecone", "vector-db"),
    ("github.com/qdrant/go-client", "vector-db"),
    ("github.com/ollama/ollama/api", "library"),
    ("github.com/milvus-io", "vector-db"),
]


def image_tool(ref: Column) -> Column:
    """Serving tool named by an image reference; null if none."""
    out = F.lit(None).cast("string")
    for part, tool in reversed(IMAGE_SIGNATURES):
        out = F.when(ref.contains(part), F.lit(tool)).otherwise(out)
    return out


def model_id_value(assignment: Column) -> Column:
    """Model id assigned to MODEL_ID in any of the usual shapes; null if none or not an id."""
    def of(bare: Column) -> Column:
        key = F.regexp_extract(bare, r"^([^=: \t]+)[=: \t]", 1)
        value = F.regexp_replace(strip(F.regexp_extract(bare, r"^[^=: \t]+[=: \t](.*)$", 1)), "^[\"']+|[\"']+$", "")
        return F.when(key == "MODEL_ID", once(F.regexp_extract(value, r"^([^ \t]*)", 1), lambda v: F.when(
            (v != "") & ~v.contains("${") & ~v.contains("$(") & ~v.rlike(r"^[/.~]") & ~v.rlike(WEIGHT_SUFFIXES), v)))

    return once(F.regexp_replace(strip(assignment), "^[\"']+|[\"']+$", ""), of)


# What a line of a Dockerfile or a compose file can contribute.
_LINE = "struct<line:int,raw:string,opens:boolean,tool:string,port:string,env_text:string,model_id:string>"


def _config_lines(files: DataFrame, detector_id: str, read: Callable[[Column, Column], Column]) -> DataFrame:
    """scan_id, path and ``lines``: what each line that is no comment contributes, in one array."""
    rows = line_array(routed(files, detector_id))
    told = F.transform(F.filter("lines", lambda x: ~x["text"].rlike("^(#|$)")), lambda x: read(x, x["text"]))
    return rows.select("scan_id", "path", told.cast(f"array<{_LINE}>").alias("lines"))


def dockerfile_lines(files: DataFrame) -> DataFrame:
    def read(line: Column, text: Column) -> Column:
        said = F.struct(F.upper(F.regexp_extract(text, r"^([^ ]*)", 1)).alias("word"), F.regexp_extract(text, r"^[^ ]* (.*)$", 1).alias("arg"))
        return once(said, lambda w: told(line, text, w["word"], w["arg"]))

    def told(line: Column, text: Column, word: Column, arg: Column) -> Column:
        ports = F.filter(F.transform(F.split(strip(arg), r"\s+"), lambda p: F.regexp_extract(p, r"^([0-9]+)(?:/.*)?$", 1)), lambda p: p != "")
        return F.struct(
            line["line"].alias("line"), line["raw"].alias("raw"), (word == "FROM").alias("opens"), F.when(word == "FROM", image_tool(arg)).alias("tool"),
            F.when((word == "EXPOSE") & arg.rlike(r"(?:^|\s)[0-9]+(?:/\S*)?(?:\s|$)"), F.get(ports, F.lit(0))).alias("port"),
            F.when(word == "ENV", text).alias("env_text"), F.when(word == "ENV", model_id_value(arg)).alias("model_id"))

    return _config_lines(files, "infra/dockerfile", read)


def compose_lines(files: DataFrame) -> DataFrame:
    bare = lambda c: F.regexp_replace(strip(c), "^[\"']+|[\"']+$", "")

    def read(line: Column, text: Column) -> Column:
        item = F.when(text.startswith("-"), bare(F.substring(text, 2, 1 << 30)))
        port = F.regexp_extract(item, r"^([0-9]+)(?:/[^:]*)?(?::|$)", 1)
        return once(port, lambda p: told(line, text, F.when(p != "", p)))

    def told(line: Column, text: Column, port: Column) -> Column:
        image = text.startswith("image:")
        return F.struct(
            line["line"].alias("line"), line["raw"].alias("raw"), image.alias("opens"),
            F.when(image, once(bare(F.regexp_replace(text, "^image:", "")), image_tool)).alias("tool"), port.alias("port"),
            F.when(~image & port.isNull(), text).alias("env_text"), model_id_value(strip(F.regexp_replace(text, "^-", ""))).alias("model_id"))

    return _config_lines(files, "infra/compose", read)


_LAST = (1 << 31) - 1


def serving_hits(lines: DataFrame, lone_env: bool) -> DataFrame:
    """One row per serving tool of a file: where it was named, endpoint and environment keys; and one per model id.

    A stage (or service) runs from one opening line to the next. A tool counts once per file, at its first line; ports and
    variables go to the tool of their own stage. With ``lone_env``, a lone OLLAMA_HOST counts in a stage that names no new
    tool. All of it happens inside the file's row, in one pass over its lines.
    """
    stages = F.transform("opening", lambda o, i: F.struct(
        o["line"].alias("line"), F.coalesce(o["tool"], F.lit("")).alias("tool"),
        F.coalesce(F.get("opening", i + 1)["line"], F.lit(_LAST)).alias("end")))
    rows = lines.withColumn("opening", F.filter("lines", lambda x: x["opens"])).withColumn("opened", stages)
    # Lines in front of the first stage are a stage without a tool.
    rows = rows.withColumn("opened", F.concat(F.array(F.struct(
        F.lit(0).alias("line"), F.lit("").alias("tool"), F.coalesce(F.get("opened", F.lit(0))["line"], F.lit(_LAST)).alias("end"))), "opened"))
    rows = rows.withColumn("stages", F.transform("opened", lambda s: F.struct(
        s["line"].alias("line"), s["tool"].alias("tool"), s["end"].alias("end"),
        ((s["tool"] != "") & ~F.exists("opened", lambda o: (o["tool"] == s["tool"]) & (o["line"] < s["line"]))).alias("is_new"))))
    between = lambda s, first: F.filter("lines", lambda x: (x["line"] >= first) & (x["line"] < s["end"]))
    first_ollama = F.array_min(F.transform(F.filter("stages", lambda s: s["tool"] == "ollama"), lambda s: s["line"]))
    quiet = F.filter("stages", lambda s: ~s["is_new"] & (s["tool"] != "ollama"))
    lone = F.array_min(F.flatten(F.transform(quiet, lambda s: F.transform(
        F.filter(between(s, s["line"]), lambda x: F.coalesce(x["env_text"].contains("OLLAMA_HOST"), F.lit(False))), lambda x: x["line"]))))
    rows = rows.withColumn("lone", F.when(F.lit(lone_env), lone)).withColumn(
        "lone", F.when(first_ollama.isNull() | (F.col("lone") < first_ollama), F.col("lone")))
    entry = lambda kind, name, at, sure, own: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), at.alias("line"), F.lit(sure).alias("confidence"), own.alias("own"))
    hit = lambda s, tool, at, sure: entry("infra", tool, at, sure, between(s, at))
    named = F.transform(F.filter("stages", lambda s: s["is_new"] & ~((s["tool"] == "ollama") & F.col("lone").isNotNull())),
                        lambda s: hit(s, s["tool"], s["line"], 0.75))
    by_env = F.transform(F.filter("stages", lambda s: (s["line"] <= F.col("lone")) & (F.col("lone") < s["end"])),
                         lambda s: hit(s, F.lit("ollama"), F.col("lone"), 0.7))
    models = F.transform(F.filter("lines", lambda x: x["model_id"].isNotNull()),
                         lambda x: entry("hosted-llm", x["model_id"], x["line"], 0.6, F.array(x)))
    found = rows.select("scan_id", "path", F.explode(F.concat(named, by_env, models)).alias("h")).select("scan_id", "path", "h.*")
    tool = F.col("kind") == "infra"
    held = lambda k: F.exists("own", lambda x: F.coalesce(x["env_text"].contains(k), F.lit(False)))
    at_line = F.filter("own", lambda x: x["line"] == F.col("line"))
    return found.select(
        "scan_id", "path", "kind", "name", "line", "confidence",
        F.when(tool, F.get(F.filter("own", lambda x: x["port"].isNotNull()), F.lit(0))["port"]).alias("endpoint"),
        F.when(tool, F.concat_ws(",", *[F.when(held(k), F.lit(k)) for k in ENV_KEYS])).alias("env"), F.get(at_line, F.lit(0))["raw"].alias("raw"))


def infra_findings(lines: DataFrame, detector_id: str) -> DataFrame:
    hits = serving_hits(lines, detector_id == "infra/dockerfile")
    return hits.select(
        "scan_id", "path", "line", "kind", "name", "confidence",
        F.when(F.col("endpoint").isNotNull(), F.struct(
            "endpoint", F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("deployment")
        )).alias("infra"),
        F.when(F.col("env") != "", F.create_map(F.lit("env"), F.col("env"))).alias("fields"),
        snippet(F.col("raw")).alias("snippet"), F.lit(detector_id).alias("detector_id"), F.lit("config-analysis").alias("method"))


def dockerfile_findings(files: DataFrame) -> DataFrame:
    return infra_findings(dockerfile_lines(files), "infra/dockerfile")


def compose_findings(files: DataFrame) -> DataFrame:
    return infra_findings(compose_lines(files), "infra/compose")


_GO_NAMED = r"""(?i)(?:^|[^A-Za-z0-9_])(?:model|modelname|modelid)(?:\s+string)?\s*(?::=|:|=)\s*(?:"([^"]+)"|`([^`]+)`)"""


def _go_kind(imported: Column) -> Column:
    """What an import path stands for; null if no AI client."""
    kind = F.lit(None).cast("string")
    for prefix, k in reversed(GO_MODULES):
        kind = F.when((imported == prefix) | imported.startswith(prefix + "/"), F.lit(k)).otherwise(kind)
    return kind


def go_findings(files: DataFrame) -> DataFrame:
    """AI client imports, and model-named string literals in files that import one."""
    det = "gosrc/ast"
    source = text_of(F.col("content"))
    holds = reduce(lambda a, b: a | b, [source.contains(prefix) for prefix, _ in GO_MODULES])

    # What a line tells by itself is found once, before the fold that would evaluate it wherever it is used.
    code = F.transform("lines", lambda x: F.struct(x["line"], x["raw"], strip(F.regexp_replace(x["raw"], r"(^|\s)//.*$", "")).alias("text")))
    told = F.transform(code, lambda x: F.struct(
        x["line"], x["raw"], x["text"],
        F.when(x["text"].rlike(r"^import\s*\("), "import").when(x["text"].rlike(r"^(\)|func |type |var |const )"), "").alias("block"),
        F.when(x["text"].rlike("^func "), F.regexp_extract(x["text"], r"^func\s+(?:\([^)]*\)\s*)?(\w+)", 1)).when(
            x["raw"].rlike(r"^(\}|var|const|type)"), "").alias("func"),
        x["text"].rlike(r"^import\s").alias("imports"),
        F.regexp_extract(x["text"], r"^(?:import\s*\(?\s*)?(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]", 1).alias("quoted"),
        x["text"].rlike(_GO_NAMED).alias("names")))
    told = F.transform(told, lambda x: F.struct(
        x["line"], x["raw"], x["text"], x["block"], x["func"], x["imports"], x["quoted"], _go_kind(x["quoted"]).alias("kind"), x["names"]))

    def step(at: Column, line: Column) -> tuple[dict[str, Column], Column]:
        block, func = F.coalesce(line["block"], at["block"]), F.coalesce(line["func"], at["func"])
        inside = (block == "import") | line["imports"]
        kind = F.when(inside, line["kind"])
        given = F.when(kind.isNotNull() | line["names"], F.struct(
            line["line"], line["raw"], line["text"], func.alias("_func"), F.when(inside, line["quoted"]).alias("_import"), kind.alias("_kind")))
        return {"block": block, "func": func, "uses": at["uses"] | kind.isNotNull()}, given

    rows = folded_lines(
        line_array(routed(files, det).filter(holds)).withColumn("lines", told), {"block": F.lit(""), "func": F.lit(""), "uses": F.lit(False)}, step,
        "struct<line:int,raw:string,text:string,_func:string,_import:string,_kind:string>", lambda acc: acc["uses"])
    module = F.when(
        F.col("_import").rlike(r"^(?:github\.com|gitlab\.com|bitbucket\.org)/[^/]+/[^/]+"),
        F.substring_index("_import", "/", 3),
    ).otherwise(F.col("_import"))
    imports = rows.filter("_kind IS NOT NULL").select(
        "scan_id", "path", "line", F.col("_kind").alias("kind"), module.alias("name"),
        F.lit("golang").alias("ecosystem"), F.lit(0.8).alias("confidence"), F.lit("").alias("symbol"),
        snippet(F.col("raw")).alias("snippet"),
    )
    value = lambda g: F.regexp_extract_all("text", F.lit(_GO_NAMED), F.lit(g))
    literals = rows.filter(F.col("text").rlike(_GO_NAMED)).select(
        "*", F.explode(F.zip_with(value(1), value(2), lambda a, b: F.when(a != "", a).otherwise(b))).alias("name")
    ).select(
        "scan_id", "path", "line", F.lit("hosted-llm").alias("kind"), "name", F.lit(0.75).alias("confidence"),
        F.coalesce("_func", F.lit("")).alias("symbol"), snippet(F.col("raw")).alias("snippet"),
    )
    return imports.unionByName(literals, allowMissingColumns=True).withColumn(
        "detector_id", F.lit(det)
    ).withColumn("method", F.lit("ast-fingerprint"))
