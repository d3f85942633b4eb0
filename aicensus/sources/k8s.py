"""Container images used by Kubernetes workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workload kinds read, and the environment variables kept as signals.
WORKLOAD_KINDS = ["Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob"]
SIGNAL_ENV = ["OLLAMA_HOST", "MODEL_ID", "HF_TOKEN"]

_CONTAINER = "array<struct<name:string,image:string,env:array<struct<name:string,value:string>>>>"
_POD = f"containers:{_CONTAINER},initContainers:{_CONTAINER},ephemeralContainers:{_CONTAINER}"
WORKLOAD = (
    "kind string, metadata struct<name:string,namespace:string>, "
    f"spec struct<{_POD},template:struct<spec:struct<{_POD}>>,"
    f"jobTemplate:struct<spec:struct<template:struct<spec:struct<{_POD}>>>>>"
)


def container_sightings(manifests: DataFrame, namespace: str = "") -> DataFrame:
    """One row per container of every recognized workload document (``doc`` is JSON)."""
    docs = manifests.withColumn("w", F.from_json("doc", WORKLOAD)).filter(
        F.col("w.kind").isin(WORKLOAD_KINDS)
    )
    if namespace:
        ns = F.coalesce(F.nullif(F.col("w.metadata.namespace"), F.lit("")), F.lit("default"))
        docs = docs.filter(ns == namespace)
    empty = F.array().cast(_CONTAINER)
    groups = [
        F.coalesce(F.col(f"{spec}.{part}"), empty)
        for spec in ("w.spec", "w.spec.template.spec", "w.spec.jobTemplate.spec.template.spec")
        for part in ("containers", "initContainers", "ephemeralContainers")
    ]
    workload = F.concat_ws(
        "/",
        "w.kind",
        F.when(F.coalesce(F.col("w.metadata.name"), F.lit("")) != "", F.nullif(F.col("w.metadata.namespace"), F.lit(""))),
        F.nullif(F.col("w.metadata.name"), F.lit("")),
    )
    return (
        docs.select("scan_id", "doc_order", workload.alias("workload"), F.posexplode(F.concat(*groups)).alias("pos", "c"))
        .filter(F.coalesce(F.col("c.image"), F.lit("")) != "")
        .select("scan_id", "doc_order", "pos", "workload", F.col("c.image").alias("image"), F.col("c.env").alias("env"))
    )


def image_workloads(containers: DataFrame) -> DataFrame:
    """Distinct (image, workload) pairs: flat, because a popular image may run everywhere."""
    return containers.select("scan_id", "image", "workload").distinct()


def image_signals(containers: DataFrame) -> DataFrame:
    """AI signals per image; the last document to set a variable wins."""
    order = F.struct("doc_order", "pos", "epos")
    return (
        containers.select("scan_id", "image", "doc_order", "pos", F.posexplode("env").alias("epos", "e"))
        .filter(F.col("e.name").isin(SIGNAL_ENV) & (F.coalesce(F.col("e.value"), F.lit("")) != ""))
        .groupBy("scan_id", "image", F.col("e.name").alias("signal"))
        .agg(F.max_by("e.value", order).alias("value"))
    )


def images(manifests: DataFrame, namespace: str = "") -> DataFrame:
    """One row per image with workload count, first and last workload, and its signals."""
    cont = container_sightings(manifests, namespace)
    by_image = image_workloads(cont).groupBy("scan_id", "image").agg(
        F.count("*").alias("workloads"),
        F.min("workload").alias("first_workload"),
        F.max("workload").alias("last_workload"),
    )
    # At most three signals exist, so the map per image is bounded.
    signals = image_signals(cont).groupBy("scan_id", "image").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "value")))).alias("signals")
    )
    return by_image.join(signals, ["scan_id", "image"], "left")
