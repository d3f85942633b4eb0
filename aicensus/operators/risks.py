"""The fixed catalog of artifact risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

# The risk catalog (id, severity, slug, title, description).
RISK_CATALOG = [
    ("RISK-PICKLE-IMPORT", "high", "pickle-import", "Unsafe pickle import",
     "A pickle global names a callable that runs code while the artifact is being loaded."),
    ("RISK-KERAS-LAMBDA", "high", "keras-lambda", "Keras Lambda layer",
     "The model config declares a Lambda layer, arbitrary Python that runs when the model is loaded."),
    ("RISK-GGUF-TEMPLATE", "medium", "gguf-template", "Unsafe GGUF chat template",
     "The chat template holds template-engine escape gadgets; rendering it can run code."),
    ("RISK-SAVEDMODEL-PYFUNC", "medium", "savedmodel-pyfunc", "SavedModel Python-callback op",
     "The graph holds a Python-callback op that runs arbitrary Python during inference."),
    ("RISK-UNSAFE-LOAD", "medium", "unsafe-load", "Unsafe model deserialization",
     "A call site loads a model through an unsafe path; a malicious checkpoint would run code."),
]
RISK_SEVERITIES = ["low", "medium", "high"]


def risk_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RISK_CATALOG, "risk_id string, severity string, slug string, title string, description string"
    )


def _field(risk_id: Column, index: int, otherwise: Column) -> Column:
    pairs = [F.lit(x) for row in RISK_CATALOG for x in (row[0], row[index])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), risk_id), otherwise)


def risk_severity(risk_id: Column) -> Column:
    return _field(risk_id, 1, F.lit("low"))


def risk_slug(risk_id: Column) -> Column:
    return _field(risk_id, 2, F.concat(F.lit("unknown-"), slug(risk_id)))


def risk_title(risk_id: Column) -> Column:
    return _field(risk_id, 3, risk_id)


def risk_description(risk_id: Column) -> Column:
    return _field(risk_id, 4, risk_id)
