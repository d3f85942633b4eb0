"""Cross-file findings: model directories, adapters, generation configs, RAG pipelines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, blank_to_null, dirname, extension, json_object, matches_glob
from ..session import ship_package
from ..sources.files import text_of
from .artifacts import model_facet
from .assets import parent_name

# Generation parameters captured, and fields that name the configured model.
PARAM_KEYS = [
    "temperature", "top_p", "top_k", "max_tokens", "max_new_tokens", "max_length", "do_sample",
    "num_beams", "repetition_penalty", "presence_penalty", "frequency_penalty", "typical_p",
]
MODEL_KEYS = ["_name_or_path", "model", "model_name"]
CONFIG_GLOBS = [
    "**/generation_config.json", "**/*generation*config*.yaml", "**/*generation*config*.yml",
    "**/model_config.json", "**/model_config.yaml", "**/model_config.yml",
]


def _relation(kind: str, target_kind: str, name: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"), F.lit(target_kind).alias("target_kind"), name.alias("name"),
        null.alias("from_field"), null.alias("local_ref"),
    )


def model_directories(files: DataFrame) -> DataFrame:
    """One finding per directory that holds a model config and weights.

    Weights are reduced to the first path per (scan, family, directory) before the join, so
    a directory with any number of shards is one row.
    """
    base, path = basename(F.col("path")), F.col("path")
    family = F.when(base == "config.json", "transformers").when(base == "model_index.json", "diffusers")
    text = text_of(F.col("content"))
    configs = (
        files.filter(base.isin("config.json", "model_index.json"))
        .select("scan_id", "path", family.alias("family"), dirname(path).alias("dir"), F.from_json(
            text, "_class_name string, model_type string, architectures array<string>, _name_or_path string"
        ).alias("c"))
        .withColumn("arch", F.when(
            F.col("family") == "diffusers", blank_to_null(F.col("c._class_name"))
        ).otherwise(F.coalesce(blank_to_null(F.col("c.model_type")), F.get("c.architectures", F.lit(0)))))
        .filter("arch IS NOT NULL")
    )
    # Which files count as weights, beside the config or one directory below.
    transformers = base.isin("model.safetensors", "pytorch_model.bin") | base.rlike(
        r"^model-.*-of-.*\.safetensors$") | base.endswith(".gguf")
    tensors = base.endswith(".safetensors") | base.endswith(".bin")
    spot = lambda fam, d: F.struct(F.lit(fam).alias("family"), d.alias("dir"))
    below = dirname(path) != ""
    spots = F.array(
        F.when(transformers, spot("transformers", dirname(path))),
        F.when(tensors, spot("diffusers", dirname(path))),
        F.when(below & (tensors | base.endswith(".gguf")), spot("diffusers", dirname(dirname(path)))),
    )
    weights = (
        files.filter(base.rlike(r"\.(safetensors|bin|gguf)$"))
        .select("scan_id", "path", F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("s"))
        .groupBy("scan_id", "s.family", "s.dir")
        .agg(F.min("path").alias("weights"))
    )
    one = configs.join(weights, ["scan_id", "family", "dir"]).groupBy("scan_id", "dir").agg(
        F.min_by(F.struct("path", "arch", "weights", F.col("c._name_or_path").alias("given")), "path").alias("m")
    ).select("scan_id", "m.*")
    ext = extension(F.col("weights"))
    fmt = F.when(ext.isin(".bin", ".pt", ".pth"), "pytorch").otherwise(F.regexp_replace(ext, r"^\.", ""))
    return one.select(
        "scan_id", "path", F.lit("local-model-file").alias("kind"), F.lit("local").alias("provider"),
        F.coalesce(blank_to_null(F.col("given")), parent_name(F.col("path"))).alias("name"),
        model_facet(architecture=F.col("arch"), format=fmt).alias("model"),
        F.lit("project/hfdir").alias("detector_id"), F.lit("binary-analysis").alias("method"),
        F.lit(0.9).alias("confidence"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def adapters(files: DataFrame) -> DataFrame:
    """One finding per adapter config, derived from its declared base model."""
    rows = files.filter(basename(F.col("path")) == "adapter_config.json").withColumn(
        "c", F.from_json(text_of(F.col("content")), "base_model_name_or_path string, peft_type string, _bad string",
                         {"columnNameOfCorruptRecord": "_bad"})
    ).filter("c._bad IS NULL")
    base = blank_to_null(F.col("c.base_model_name_or_path"))
    peft = blank_to_null(F.col("c.peft_type"))
    return rows.select(
        "scan_id", "path", F.lit("local-model-file").alias("kind"), F.lit("local").alias("provider"),
        parent_name(F.col("path")).alias("name"), model_facet(base_model=base).alias("model"),
        F.when(peft.isNotNull(), F.create_map(F.lit("peft_type"), peft)).alias("fields"),
        F.when(base.isNotNull(), F.array(_relation("derived-from", "local-model-file", base))).alias("relations"),
        F.lit("project/adapter").alias("detector_id"), F.lit("config-analysis").alias("method"),
        F.lit(0.9).alias("confidence"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def _yaml_as_json(rows: DataFrame) -> DataFrame:
    """YAML configs as JSON text, or the reason why there is none; an empty document is neither."""
    ship_package(rows.sparkSession)

    def read(raw: bytes) -> tuple[str | None, str | None]:
        try:
            import yaml
        except ImportError:
            return None, "no YAML parser is installed"
        try:
            doc = yaml.safe_load(raw)
            if isinstance(doc, dict):
                return json.dumps({str(k): v for k, v in doc.items()}, default=str), None
            return None, None if doc is None else "the config is no mapping"
        except (yaml.YAMLError, ValueError, RecursionError) as failed:
            return None, f"the config does not parse: {type(failed).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(scan_id, path, *read(bytes(raw))) for scan_id, path, raw in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(out, columns=["scan_id", "path", "json", "error"])

    return rows.select("scan_id", "path", "content").mapInPandas(run, "scan_id string, path string, json string, error string")


def config_unknowns(files: DataFrame) -> DataFrame:
    """Configs that do not parse to an object, whichever detector reads them."""
    base = basename(F.col("path"))
    bound = matches_glob(F.col("path"), *CONFIG_GLOBS)
    is_json = F.col("path").endswith(".json")
    bad = files.filter((is_json & bound | base.isin("config.json", "model_index.json", "adapter_config.json")) & ~json_object(
        text_of(F.col("content")))).select("scan_id", "path", F.lit("the config is no JSON object").alias("reason"))
    yaml = _yaml_as_json(files.filter(~is_json & bound)).filter("error IS NOT NULL").select("scan_id", "path", F.col("error").alias("reason"))
    return bad.unionByName(yaml).select("scan_id", "path", F.lit("project/configbind").alias("detector_id"), "reason")


def scalar_text(value: Column) -> Column:
    """A JSON scalar (variant) as text: integral numbers without decimals, small ones in e-notation."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    shown = number.cast("string")
    expo = F.concat(
        F.regexp_replace(F.regexp_extract(shown, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.lit("e-"),
        F.lpad(F.regexp_extract(shown, r"E-([0-9]+)$", 1), 2, "0"),
    )
    numeric = (
        F.when(number == F.floor(number), F.format_string("%.0f", number))
        .when(F.abs(number) < 1e-4, expo)
        .otherwise(shown)
    )
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), numeric).otherwise(text)


def config_bindings(files: DataFrame) -> DataFrame:
    """One finding per generation config that sets a parameter or names a model."""
    rows = files.filter(matches_glob(F.col("path"), *CONFIG_GLOBS))
    is_json = F.col("path").endswith(".json")
    # Only the keys that count are parsed; of a repeated key the last value counts.
    shape = "struct<" + ",".join(f"`{k}`:variant" for k in (*PARAM_KEYS, *MODEL_KEYS)) + ">"
    docs = rows.filter(is_json).select("scan_id", "path", text_of(F.col("content")).alias("json")).unionByName(
        _yaml_as_json(rows.filter(~is_json)).select("scan_id", "path", "json")
    ).filter(json_object(F.col("json"))).withColumn("doc", F.from_json("json", shape))
    params = F.map_filter(
        F.create_map(*[x for k in PARAM_KEYS for x in (F.lit(f"param.{k}"), scalar_text(F.col(f"doc.{k}")))]),
        lambda k, v: v.isNotNull(),
    )
    is_text = lambda k: F.schema_of_variant(F.col(f"doc.{k}")) == "STRING"
    named = F.coalesce(*[
        F.when(is_text(k), blank_to_null(F.try_variant_get(F.col(f"doc.{k}"), "$", "string"))) for k in MODEL_KEYS
    ])
    # One value that is kept or not: a filter on it would be moved below the parsed document and parse it for every key.
    bound = F.filter(F.array(F.struct(params.alias("fields"), named.alias("_model"))),
                     lambda b: (F.size(b["fields"]) > 0) | b["_model"].isNotNull())
    return docs.select("scan_id", "path", F.explode(bound).alias("b")).select("scan_id", "path", "b.*").select(
        "scan_id", "path", F.lit("ai-config").alias("kind"), basename(F.col("path")).alias("name"), "fields",
        F.when(F.col("_model").isNotNull(), F.array(
            _relation("configures", "local-model-file", F.col("_model")))).alias("relations"),
        F.lit("project/configbind").alias("detector_id"), F.lit("config-analysis").alias("method"),
        F.lit(0.7).alias("confidence"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def rag_pipelines(findings: DataFrame) -> DataFrame:
    """One rag-pipeline per scan that has an embedding model and a vector database.

    Only the first of each kind is kept per scan, by a partially aggregated ``min_by``.
    """
    order = F.struct("path", "finding_seq")
    spot = F.struct("path", "line", "col", "end_line", "end_col", "name")
    first = lambda kind: F.min_by(spot, F.when(F.col("kind") == kind, order))
    pairs = (
        findings.filter(F.col("kind").isin("embedding-model", "vector-db"))
        .groupBy("scan_id")
        .agg(first("embedding-model").alias("e"), first("vector-db").alias("v"))
        .filter("e IS NOT NULL AND v IS NOT NULL")
    )
    return pairs.select(
        "scan_id", "e.path", "e.line", "e.col", "e.end_line", "e.end_col",
        F.lit("rag-pipeline").alias("kind"), F.lit("rag-pipeline").alias("name"),
        F.lit("project/raglink").alias("detector_id"), F.lit("source-code-analysis").alias("method"),
        F.lit(0.6).alias("confidence"),
        F.array(
            _relation("embeds-with", "embedding-model", F.col("e.name")),
            _relation("contains", "vector-db", F.col("v.name")),
        ).alias("relations"),
    )
