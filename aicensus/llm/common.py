"""Helpers shared by the operators: tables, words, folding; stored tables come from the session helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, stored  # noqa: F401 - used by the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words are ASCII letters and digits after folding A-Z, and everything that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes, A-Z folded; None has none."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def ascii_lower(column: Column) -> Column:
    """A-Z folded, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())
