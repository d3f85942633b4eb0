"""Language identification with string kernels.

Kernel: blended-spectrum presence kernel over character n-grams of 1 to 3 characters of the lower-cased
text, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). Nystroem landmarks are a sample of labelled texts; a
one-versus-rest kernel ridge regression in the landmark space gives one weight per (landmark, language).
A kernel row times these weights equals the text's presence row times (landmark presence times weights), so
texts are scored by products of batched presence rows with one matrix of n-grams by languages.

Fit (bounded): about ``per_language`` labelled rows of each language, drawn by a hash of the id, of which
``landmarks`` in all are landmarks; at most ``max_languages`` languages. Scoring covers every row and
whole texts. A null text or one without a letter is ``und`` with score 0; without labelled rows all are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

UNKNOWN = "und"


@dataclass
class Model:
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))          # sorted keys
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # by n-gram, language
    languages: list[str] = field(default_factory=list)


def presence(text: str, span: int = 3, part: int = 1 << 16) -> np.ndarray:
    """The distinct n-grams of a text as sorted keys: code points of 21 bits each.

    Long texts are folded in parts that overlap by span - 1 characters, so no n-gram is lost.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    folded = []
    for start in range(0, max(len(points), 1), part):
        piece = points[start:start + part + span - 1]
        keys = piece
        grams = [keys]
        for n in range(1, min(span, len(piece))):
            keys = (keys[:-1] << np.uint64(21)) | piece[n:]
            grams.append(keys)
        folded.append(np.unique(np.concatenate(grams)))
    return folded[0] if len(folded) == 1 else np.unique(np.concatenate(folded))


def presence_rows(sets: list[np.ndarray], grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Presence rows (scaled to length one) times a matrix, for a batch of texts."""
    out = np.zeros((len(sets), weights.shape[1]), np.float64)
    if not len(grams) or not sets:
        return out
    keys = np.concatenate(sets)
    place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
    known = grams[place] == keys
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known]
    place = place[known]
    for column in range(weights.shape[1]):
        out[:, column] = np.bincount(owner, weights[place, column], len(sets))
    return out / np.sqrt(np.maximum([len(s) for s in sets], 1))[:, None]


def train(texts: list[str], languages: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression in the space of the landmarks."""
    sets = [presence(t) for t in texts]
    names = sorted(set(languages))
    chosen = np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    base = np.zeros((len(grams), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        base[np.searchsorted(grams, sets[i]), j] = 1 / np.sqrt(len(sets[i]))
    kernel = np.concatenate([presence_block(sets[i:i + 64], grams, base) for i in range(0, len(sets), 64)])
    corner = kernel[chosen]
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    gram = kernel.T @ kernel + ridge * len(sets) * corner + 1e-8 * np.eye(len(chosen))
    dual = np.linalg.lstsq(gram, kernel.T @ target, rcond=1e-10)[0]
    return Model(grams, (base @ dual).astype(np.float32), names)


def presence_block(sets: list[np.ndarray], grams: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Kernel values of a block of texts with the landmarks, as one matrix product."""
    rows = np.zeros((len(sets), len(grams)), np.float32)
    for i, keys in enumerate(sets):
        place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        rows[i, place[grams[place] == keys]] = 1 / np.sqrt(max(len(keys), 1))
    return (rows @ base).astype(np.float64)


def fit(docs: DataFrame, only: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_language: int = 300, landmarks: int = 400, max_languages: int = 500,
        ridge: float = 1e-4) -> Model:
    """The model, learnt from the labelled rows for which ``only`` (over doc_id) holds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.lit(True) if only is None else only))
    sizes = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    bound = 2 * per_language * len(sizes) + 100
    sample = drawn.limit(bound).collect()
    sample.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample], landmarks, ridge) if sample else Model()


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             batch_chars: int = 1 << 20) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1: the share of the winner's exponential)."""
    spark = df.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def flush(sets: list[np.ndarray]) -> list[tuple[str, float]]:
        m = held.value
        margins = presence_rows(sets, m.grams, m.weights)
        best = margins.argmax(axis=1)
        share = 1 / np.exp(4 * (margins - margins.max(axis=1, keepdims=True))).sum(axis=1)
        return [(m.languages[b], float(s)) for b, s in zip(best, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * batch.num_rows
            places, sets, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                if text and held.value.languages and any(map(str.isalpha, text)):
                    places.append(i)
                    sets.append(presence(text))
                    size += len(text)
                if sets and (size >= batch_chars or i == batch.num_rows - 1):
                    for p, r in zip(places, flush(sets)):
                        out[p] = r
                    places, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
