"""Chat formatting: quoted passages are linked to the messages they come from.

A line's quote level is its number of leading ``>`` marks. A passage is a run of lines of one level without
a blank line between; passages are hashed after folding A-Z and white space. A message's own passages
(level 0) are what others quote. A quoted passage belongs to the nearest earlier message of its conversation that
has it as its own: an as-of join on (conversation, hash), done in ranges of turns and a carry between
ranges, so a passage that a long conversation repeats all the time is spread. A message replies to the latest message
among its outermost linked quotes; roots and depths follow by pointer jumps, each round stored.

Rows come sorted by (conversation, root, depth, turn): every message behind the one it replies to, dealt by
range, so no conversation is collected anywhere.

Defined results: a null text has no passages; messages without conversation or turn link to nothing; rows
that share conversation and turn are one message to others, and each gets a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored

MARKS = re.compile(r"(?:> ?)*")
SPACE = re.compile(r"[ \t\r\n\f\v]+")
RANGE = 4096  # turns in a range of the as-of join
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def normalised(passage: str) -> str:
    return SPACE.sub(" ", passage).strip(" ").translate(FOLD)


def passages(text: str) -> list[tuple[int, str]]:
    """Level and content of every passage, in order."""
    out: list[tuple[int, list[str]]] = []
    open_level = -1
    for line in text.split("\n"):
        marks = MARKS.match(line)[0]
        level, content = marks.count(">"), line[len(marks):]
        if not content.strip():
            open_level = -1
            continue
        if level != open_level:
            out.append((level, []))
            open_level = level
        out[-1][1].append(content.rstrip("\r"))
    return [(level, "\n".join(lines)) for level, lines in out]


def parsed(messages: DataFrame, conv_col: str, turn_col: str, text_col: str, others: list[str]) -> DataFrame:
    """Messages with own_text and an array of (level, hash)."""
    kept = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                           F.col(text_col).alias("text"), *[F.col(c).alias(f"other_{c}") for c in others])
    schema = messages.sparkSession.createDataFrame(
        [], "own_text string, passages array<struct<level:int,hash:binary>>").schema
    out_schema = kept.drop("text").schema
    for field in schema:
        out_schema = out_schema.add(field)
    shape = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for t in batch.column(2):
                each = passages(t.as_py() or "")
                own.append("\n\n".join(p for level, p in each if level == 0))
                found.append([{"level": level, "hash": blake2b(normalised(p).encode("utf-8", "surrogatepass"),
                                                               digest_size=16).digest()} for level, p in each])
            rest = [batch.column(i) for i in range(batch.num_columns) if i != 2]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(own, pa.string()), pa.array(found, shape)],
                                             names=[f.name for f in out_schema])

    return kept.mapInArrow(run, out_schema)


def nearest_earlier(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """conv_id, hash, turn, source: the latest turn before each quote that has the passage; null if none."""
    events = quotes.select("conv_id", "hash", "turn", F.lit(0).alias("kind")).unionByName(
        originals.select("conv_id", "hash", "turn", F.lit(1).alias("kind"))).distinct().withColumn(
        "span", F.floor(F.col("turn") / RANGE))
    own = F.when(F.col("kind") == 1, F.col("turn"))
    inside = Window.partitionBy("conv_id", "hash", "span").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = events.groupBy("conv_id", "hash", "span").agg(F.max(own).alias("last"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select("conv_id", "hash", "span", F.max("last").over(earlier).alias("carry"))
    return events.withColumn("near", F.max(own).over(inside)).filter("kind = 0").join(
        carry, ["conv_id", "hash", "span"]).select(
        "conv_id", "hash", "turn", F.coalesce("near", "carry").alias("source"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth from (conv_id, turn, parent_turn); turns fall towards the root."""
    state = stored(parents.select(
        "conv_id", "turn", F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.col("parent_turn").isNotNull().cast("long").alias("depth")), "quotation-threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"),
                          F.col("depth").alias("more"))
        new = stored(state.join(up, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            (F.coalesce("more", F.lit(0)) > 0).alias("moved")), "quotation-threads")
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The messages without quotes in reply order: conv_id, turn, own_text, parent_turn, root_turn, depth, n_quotes
    (quoted passages), n_linked (those with a source), max_level, then the further columns as they are."""
    ship_package(messages.sparkSession)
    others = [c for c in messages.columns if c not in (conv_col, turn_col, text_col)]
    rows = stored(parsed(messages, conv_col, turn_col, text_col, others), "quotation-messages")
    each = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    quotes = each.filter("level > 0")
    sources = nearest_earlier(quotes.select("conv_id", "hash", "turn"), each.filter("level = 0"))
    found = quotes.join(sources, ["conv_id", "hash", "turn"]).filter("source IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("linked"), F.min(F.struct("level", -F.col("source"))).alias("best")).select(
        "conv_id", "turn", "linked", (-F.col("best.col2")).alias("parent_turn"))
    turns = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    parents = stored(turns.join(found, ["conv_id", "turn"], "left"), "quotation-parents")
    placed = parents.join(threads(parents), ["conv_id", "turn"])
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    joined = rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "own_text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.size(quoted).cast("long").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).alias("n_linked"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"),
        *[F.col(f"other_{c}").alias(c if c not in (
            "conv_id", "turn", "own_text", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", "max_level") else f"{c}_in")
          for c in others])
    order = ["conv_id", "root_turn", "depth", "turn"]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order)
