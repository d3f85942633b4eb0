"""Target-distribution importance resampling with a head-tail vocabulary of hashed word runs.

A feature is a run of 1 to ``max_n`` consecutive words joined by a space, its bucket the CRC-32 of its UTF-8 bytes modulo
``buckets``. The head are the most frequent words with their exact CRC states, from which a run's CRC is continued word
by word, and the buckets of the most frequent pairs; both are counted in every text and broadcast with a fixed bound.
Whatever is not in the head takes a direct CRC, so the head changes the cost and never a bucket: the totals are exact.

Texts are read twice (head, features). The features are stored as compact bucket numbers; totals and weights are computed
from these. The draw orders the eligible rows by ranges: a row's rank is its place in its range plus the sizes of the ranges
before it, so no task and no driver holds the order.

Defined results: a text without words (null, empty) has no features and weight 0, and is not eligible for ``min_words`` of 1
or more; a null id draws its noise from the seed alone and comes last among equal scores; repeated rows are rows of their
own; an empty target or an empty table counts no features. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored, words

HEAD_BYTES = 64  # longer words never enter the head, which bounds its size


@dataclass
class Head:
    """CRC states of frequent words and buckets of frequent pairs; ``buckets`` is the modulus."""

    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]
    buckets: int

    def feature_buckets(self, found: list[bytes], max_n: int) -> np.ndarray:
        """The buckets of all runs of 1 to ``max_n`` words, run length by run length."""
        if not found:
            return np.zeros(0, np.uint32)
        known, crc, out = self.states, zlib.crc32, []
        states = [known[w] if w in known else crc(w) for w in found]
        out.append(np.array(states, np.uint32) % np.uint32(self.buckets))
        for n in range(2, min(max_n, len(found)) + 1):
            following = found[n - 1:]
            if n == 2 and max_n == 2:  # the pair's state is not needed further
                pairs = self.pairs
                out.append(np.array([pairs[p] if p in pairs else crc(p[1], crc(b" ", s)) % self.buckets
                                     for s, p in zip(states, zip(found, following))], np.uint32))
                break
            states = [crc(w, crc(b" ", s)) for s, w in zip(states, following)]
            out.append(np.array(states, np.uint32) % np.uint32(self.buckets))
        return np.concatenate(out)


def frequent(docs: DataFrame, text_col: str, n: int, size: int) -> list[list[bytes]]:
    """The ``size`` most frequent runs of n words; a task keeps at most ``4 * size`` counters."""
    if size <= 0:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = words(text.as_py())
                counts.update(zip(*(found[i:] for i in range(n))))
                if len(counts) > 4 * size:
                    counts = Counter(dict(counts.most_common(2 * size)))
        top = [(k, c) for k, c in counts.most_common(size) if max(map(len, k)) <= HEAD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k, _ in top], pa.list_(pa.binary())),
                                          pa.array([c for _, c in top], pa.int64())], names=["words", "n"])

    counted = stored(docs.select(text_col).mapInArrow(run, "words array<binary>, n long").groupBy("words").agg(
        F.sum("n").alias("n")), "resampling-head")
    held = counted.count()
    if held > size:  # a quantile leaves about ``size`` rows, so that no task sends rows of its own rank to the driver
        least = counted.agg(F.percentile_approx("n", 1 - size / held, F.lit(10_000))).first()[0]
        counted = counted.filter(F.col("n") > least)
    top = counted.orderBy(F.desc("n"), "words").limit(size)
    return [[bytes(w) for w in r["words"]] for r in top.collect()]


def build_head(docs: DataFrame, text_col: str, max_n: int, buckets: int, head_words: int, head_pairs: int) -> Head:
    states = {w: zlib.crc32(w) for w, in frequent(docs, text_col, 1, head_words)}
    pairs = frequent(docs, text_col, 2, head_pairs if max_n == 2 else 0)
    return Head(states, {(a, b): zlib.crc32(a + b" " + b) % buckets for a, b in pairs}, buckets)


def features(docs: DataFrame, id_col: str, text_col: str, head: Head, max_n: int) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of every row as little-endian numbers of 16 or 32 bits."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = "<u2" if head.buckets <= 1 << 16 else "<u4"
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py()) for t in batch.column(1)]
            hashed = [sent.value.feature_buckets(w, max_n) for w in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array([len(h) for h in hashed], pa.int64()),
                 pa.array([h.astype(narrow).tobytes() for h in hashed], pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_totals(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: exact totals, one partial count a task."""
    narrow = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for hashed in batch.column(0):
                total += np.bincount(np.frombuffer(hashed.as_py(), narrow), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, both shares with one added count."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    double = lambda c: F.col(c).cast("double")
    ratio = (double("t") + 1) * (float(sums[0]) + buckets) / ((double("s") + 1) * (float(sums[1]) + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the gains of all features of a row added up."""
    narrow = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(h.as_py(), narrow)].sum()) for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: str) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of a SHA-256, rounded down."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``place``, their number in the order from 1; ranges are numbered apart and offset by earlier sizes."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "resampling-order")
    part, line = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = [tuple(r) for r in placed.groupBy(part.alias("part")).count().collect()]  # one row a partition
    before, seen = [], 0
    for number, size in sorted(sizes):
        before.append((number, seen))
        seen += size
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        "place", F.col("before") + line + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_text: str = "text",
             max_n: int = 2, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024",
             head_words: int = 50_000, head_pairs: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (from 1 for drawn rows, else null)."""
    ship_package(docs.sparkSession)
    head = build_head(docs, text_col, max_n, buckets, head_words, head_pairs)
    rows = stored(features(docs, id_col, text_col, head, max_n), "resampling-features")
    aimed = features(target.select(target_text).withColumn("_id", F.lit(0)), "_id", target_text, head, max_n)
    gain = gains(bucket_totals(rows, buckets), bucket_totals(aimed, buckets), buckets)
    scored = stored(weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    eligible = scored.filter(F.col("n_words") >= min_words)
    drawn = eligible.count() * percent // 100
    order = ranked(eligible, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    shape = lambda frame, place: frame.select("doc_id", "n_features", "weight", "score", place.cast("long").alias("rank"))
    return shape(order, rank).unionByName(shape(scored.filter(F.col("n_words") < min_words), F.lit(None)))
