"""Rules against annotated fixtures: what was expected, what fired, which rules lack cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import text_of
from .manifests import folded_lines, line_array


def expectations(files: DataFrame, marker: str = "expect") -> DataFrame:
    """Annotations in comments: ``expect: <rule>`` wants a match, ``expect-ok: <rule>`` none.

    A trailing annotation means its own line; a standalone one means the next line that is
    not itself a standalone annotation. Lines are folded from the last to the first inside their file's row.
    """
    note = rf"(?:#|//)\s*{marker}(-ok)?:\s*(\S+)"
    marked = files.filter(text_of(F.col("content")).rlike(note))
    rows = line_array(marked).withColumn("lines", F.reverse("lines"))
    told = F.transform("lines", lambda x: F.struct(x["line"], x["raw"], x["raw"].rlike(note).alias("noted"), x["raw"].rlike(rf"^\s*{note}").alias("alone")))

    def step(at: Column, line: Column) -> tuple[dict[str, Column], Column]:
        following = F.when(at["following"] > 0, at["following"]).otherwise(line["line"] + 1)
        meant = F.when(line["alone"], following).otherwise(line["line"])
        return {"following": meant}, F.when(line["noted"], F.struct(meant.alias("line"), line["raw"]))

    noted = folded_lines(rows.withColumn("lines", told), {"following": F.lit(0)}, step, "struct<line:int,raw:string>")
    return noted.select(
        "scan_id", "path", "line", F.regexp_extract("raw", note, 2).alias("rule_id"),
        (F.regexp_extract("raw", note, 1) == "").alias("positive"))


def failures(expected: DataFrame, matches: DataFrame, rules: list[dict]) -> DataFrame:
    """Expectations that do not hold, and annotations that name no rule."""
    fired = matches.select(
        "scan_id", "path", "line", F.regexp_replace("detector_id", "^rules/", "").alias("rule_id")
    ).distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False))
    reason = (
        F.when(~F.col("rule_id").isin([r["id"] for r in rules]), "unknown rule id")
        .when(F.col("positive") & ~hit, "annotated line is not matched")
        .when(~F.col("positive") & hit, "line annotated as clean is matched")
    )
    # Matches are as many as the corpus has; files full of text look small to the planner, which would broadcast them.
    return expected.join(fired.hint("merge"), ["scan_id", "path", "line", "rule_id"], "left").select(
        "scan_id", "path", "line", "rule_id", "positive", reason.alias("reason")
    ).filter("reason IS NOT NULL")


def coverage_gaps(expected: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules without a positive or without a negative case."""
    spark = expected.sparkSession
    every = spark.createDataFrame([(r["id"],) for r in rules], "rule_id string")
    seen = expected.groupBy("rule_id").agg(F.bool_or("positive").alias("pos"), F.bool_or(~F.col("positive")).alias("neg"))
    have = lambda c: F.coalesce(c, F.lit(False))
    return every.join(seen, "rule_id", "left").select(
        "rule_id", (~have("pos")).alias("missing_positive"), (~have("neg")).alias("missing_negative")
    ).filter("missing_positive OR missing_negative")
