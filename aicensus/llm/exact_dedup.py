"""Exact deduplication in three combining steps, DataFrame functions only.

Equal texts are found by their digest and confirmed by their full content: the content is part of
the grouping key of every step, so two texts that share a digest never merge.

1. local: each task folds the copies it reads (the partial aggregate),
2. salted: the folded rows of one digest meet in ``salts`` groups, dealt by the reading task, so that
   even a text with a third of all rows arrives in many small groups,
3. global: the at most ``salts`` winners of each content are combined.

Winners are stored as one small row per digest. Rows then find their winner by digest; where a digest
stands for several contents (none for SHA-256 in practice), those rows alone are matched by content.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays and null
ids are smaller than any other; rows that repeat id and text all count, and exactly one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = 64,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (of the A-Z folded text)."""
    base = df.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("content"))
    base = base.withColumn("digest", digest(F.col("content")))
    salted = (base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("digest", "salt", "content")
              .agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n")))
    contents = (salted.repartition("digest").groupBy("digest", "content")
                .agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size")))
    winners = stored(contents.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("contents")), "dedup-winners")

    rows = base.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("repeats"))
    single = winners.filter("contents = 1").drop("contents")
    found = rows.join(single, "digest")
    shared = winners.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        clashing = base.join(shared, "digest", "left_semi")
        exact = clashing.groupBy("digest", "content").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_content = clashing.groupBy("doc_id", "digest", "content").agg(F.count(F.lit(1)).alias("repeats"))
        found = found.unionByName(by_content.join(exact, ["digest", "content"]).drop("content"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and its text, any one stays."""
    kept = exact_dedup(df, id_col, text_col).filter("kept").select(
        F.struct("doc_id", "digest").alias("_dedup_key"))
    keyed = df.withColumn("_dedup_key", F.struct(
        F.col(id_col).alias("doc_id"), sha256(ascii_lower(F.col(text_col))).alias("digest")))
    return keyed.join(kept, "_dedup_key", "left_semi").dropDuplicates(["_dedup_key"]).select(*df.columns)
