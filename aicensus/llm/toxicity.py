"""Toxic passages as maximum-scoring segments of word log-odds.

Fit (bounded): at most about ``max_rows`` labelled rows, drawn by a hash of their id, give the number of
toxic and of other texts that hold a token: a word, or a beginning of 4 to 8 bytes that its inflected forms share. The log-odds have an informative Dirichlet prior (the
pooled share of the word, with one pseudo-count as a floor); a token counts as evidence when its z-score is
above sqrt(2 ln V) for V tokens tested, the level that the largest of V chance scores reaches. A word has
the weight of its strongest token; all other words get one negative drift.

Scoring (every row, whole texts): the linear-time scan for all maximal-scoring segments; the score of a
segment has the extreme-value tail 1 - exp(-K m exp(-lambda S)) in a text of m words, and significant
segments are returned. The document's score maps its best tail probability to the chance of label 1 by a
logistic curve fitted on the same sample.

Null and empty texts have no segments and the score of a text without evidence. Without labelled rows no word
is evidence and every score is 0. Rows and labels may repeat: labels of one id are averaged, equal
texts of the sample count once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import words

DRIFT = 0.5   # what a word without evidence takes from a segment's score
TAIL_K = 0.1  # the constant K of the extreme-value tail


def tokens(word: bytes) -> Iterator[bytes]:
    """The word and its beginnings; a beginning ends in a star, which no word holds."""
    yield word
    for n in range(4, min(9, len(word))):
        yield word[:n] + b"*"


class Weights(dict):
    """Word to weight or None, filled as words come; cleared when it holds ``limit`` words."""

    def __init__(self, strong: dict[bytes, float], limit: int = 300_000):
        self.strong, self.limit = strong, limit

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = max((w for t in tokens(word) if (w := self.strong.get(t)) is not None), default=None)
        return value


@dataclass
class Model:
    strong: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0                       # lambda of the tail
    curve: tuple[float, float] | None = None  # intercept and slope of the logistic curve


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence: first and last place, score. Linear time.

    ``scores`` are the places with positive scores, in order; every place between takes ``drift``.
    A stack entry is (first, last, sum before it, sum through it); a new entry swallows those that a
    longer segment through it would beat.
    """
    stack: list[list[float]] = []
    below: list[int] = []  # for each entry, the nearest earlier one with a smaller sum before it
    total, at = 0.0, -1
    for place, score in scores:
        left = total - drift * (place - at - 1)
        total, at = left + score, place
        first = place
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = below[j]
            if j < 0 or stack[j][3] >= total:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
            j -= 1
        stack.append([first, place, left, total])
        below.append(j)
    return [(int(a), int(b), right - left) for a, b, left, right in stack]


def tail_log(model: Model, best: float, n: int) -> float:
    """-log10 of the chance that a text of n ordinary words has a segment of this score."""
    if best <= 0 or n == 0:
        return 0.0
    x = math.log(TAIL_K * n) - model.rate * best
    return max(0.0, -x / math.log(10)) if x < -30 else max(0.0, -math.log10(-math.expm1(-math.exp(min(x, 50)))))


def judge(model: Model, weights: Weights, text: str | None) -> tuple[int, list[tuple[int, int, float]], float]:
    """Words, maximal segments, and the text's -log10 tail."""
    found = words(text)
    scores = [(i, w) for i, w in enumerate(map(weights.__getitem__, found)) if w is not None]
    parts = segments(scores, DRIFT)
    return len(found), parts, tail_log(model, max((s for *_, s in parts), default=0.0), len(found))


def probability(model: Model, tail: float) -> float:
    if model.curve is None:
        return 0.0
    x = model.curve[0] + model.curve[1] * math.log1p(tail)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def tail_rate(scores: np.ndarray, weights: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 for ordinary words."""
    low, high = 0.0, 1.0
    rest = 1 - weights.sum()
    value = lambda r: float((weights * np.exp(r * scores)).sum() + rest * math.exp(-r * drift) - 1)
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the ridge keeps separable samples finite."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = design.T @ (y - p) - ridge * np.array([0, beta[1]])
        move = np.linalg.solve((design * w[:, None]).T @ design + ridge * np.eye(2), gradient)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def training_rows(labels: DataFrame, id_col: str, label_col: str, only: Column | None, max_rows: int) -> DataFrame:
    """About max_rows labelled ids (id, toxic), drawn by a hash of the id; broadcast after a check of the size."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.lit(True) if only is None else only))
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("toxic"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    drawn = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    if drawn.count() > 2 * max_rows:
        raise ValueError("the sample of labelled rows is larger than its bound")
    return F.broadcast(drawn)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a word, toxic and other, folded by batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[bool(toxic)].update({t for w in set(words(text.as_py())) for t in tokens(w)})
        every = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.binary()), pa.array([counts[1][w] for w in every], pa.int64()),
             pa.array([counts[0][w] for w in every], pa.int64())], names=["word", "toxic", "other"])


def fit(docs: DataFrame, labels: DataFrame, only: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = 20_000, min_texts: int = 4, prior: float = 500.0) -> Model:
    """The model, learnt from labelled rows for which ``only`` (over doc_id) holds.

    ``max_rows`` bounds the sample and with it the words that can be evidence; all of these are kept.
    """
    ship_package(docs.sparkSession)
    sample = training_rows(labels, id_col, label_col, only, max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id").groupBy(
        F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    texts = texts.persist()
    counts = texts.mapInArrow(count_words, "word binary, toxic long, other long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"),
                        F.count_if(F.col("toxic") >= min_texts).alias("tested")).first()
    if not totals["toxic"] or not totals["tested"]:
        texts.unpersist()
        return Model()
    n_toxic, n_other = float(totals["toxic"]), float(totals["other"] or 0)
    alpha = 1.0 + prior * (F.col("toxic") + F.col("other")) / (n_toxic + n_other)
    mass = prior + totals["tested"]
    odds = lambda y, n: F.log((F.col(y) + alpha) / (n + mass - F.col(y) - alpha))
    scored = counts.filter(F.col("toxic") >= min_texts).withColumn(
        "weight", odds("toxic", n_toxic) - odds("other", n_other)).withColumn(
        "z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha)))
    strong = scored.filter(F.col("z") > math.sqrt(2 * math.log(max(totals["tested"], 3)))).orderBy(F.desc("z"), "word").collect()
    model = Model({bytes(r["word"]): float(r["weight"]) for r in strong})
    if strong:
        scores = np.array([r["weight"] for r in strong])
        shares = np.array([(r["other"] + 0.5) / (n_other + 1) for r in strong])
        model.rate = tail_rate(scores, np.minimum(shares, 0.5 / len(shares)), DRIFT)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(held.value.strong)
        for batch in batches:
            values = [round(judge(held.value, weights, t.as_py())[2], 1) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column(1)], names=["tail", "toxic"])

    rows = texts.mapInArrow(tails, "tail double, toxic boolean").groupBy("tail", "toxic").count().collect()
    texts.unpersist()
    # At most one row per text of the sample, and one per tenth of the tail; the counts are the weights. The curve
    # runs over the logarithm of the tail, so that extreme passages count without ruling it.
    model.curve = weighted_logistic(rows)
    return model


def weighted_logistic(rows: list) -> tuple[float, float]:
    x = np.repeat(np.log1p([r["tail"] for r in rows]), [r["count"] for r in rows])
    y = np.repeat([float(r["toxic"]) for r in rows], [r["count"] for r in rows])
    return logistic(x, y)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          significance: float = 0.01) -> DataFrame:
    """One row per input row: id, n_words, score (0 to 1), passages (first and last word, score, tail)."""
    spark = df.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    least = -math.log10(significance)
    shape = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()),
                                ("tail", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(held.value.strong)
        for batch in batches:
            counts, scores, passages = [], [], []
            for t in batch.column(1):
                n, parts, tail = judge(held.value, weights, t.as_py())
                counts.append(n)
                scores.append(probability(held.value, tail))
                each = [(a, b, s, tail_log(held.value, s, n)) for a, b, s in parts]
                passages.append([dict(zip(("first", "last", "score", "tail"), x)) for x in each if x[3] >= least])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64()),
                 pa.array(passages, shape)], names=["doc_id", "n_words", "score", "passages"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_words long, score double, "
             "passages array<struct<first:int,last:int,score:double,tail:double>>")


def reject(df: DataFrame, model: Model, at_least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``at_least``, with all their columns; one narrow pass over whole texts."""
    spark = df.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(held.value.strong)
        for batch in batches:
            clean = [probability(held.value, judge(held.value, weights, t.as_py())[2]) < at_least for t in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)
