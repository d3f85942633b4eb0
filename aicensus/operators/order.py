"""Running numbers over a total order of any size, without a window that holds a whole group.

The rows are cut into ranges and sorted inside each; a row's number is its place in its range plus the sizes of the ranges
before it. The sorted rows are stored, so that places and sizes are those of one and the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def _placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows stored in order with their range ``_part`` and their place ``_at`` in it, from 0."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    return placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """The rows with their number from 0 in the whole order."""
    placed = _placed(rows, order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def numbered_within(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """The rows with their number from 0 inside their group.

    A group's rows of one range start at a place and follow rows of earlier ranges; both are known from one narrow row per
    group and range, so a group may be as large as the table.
    """
    placed = _placed(rows, [*group, *order])
    parts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as a group has ranges
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # Groups may be null, so the join compares them null-safely.
    left, right = placed.alias("l"), parts.alias("r")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    joined = left.join(right, [F.col("l._part") == F.col("r._part"), *same])
    return joined.select("l.*", (F.col("l._at") - F.col("r._first") + F.col("r._before")).alias(name)).drop("_part", "_at")
