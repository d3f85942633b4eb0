"""Benchmark decontamination with a positional inverted index of the training texts.

The index is partitioned by document: a segment holds the postings (positions) of all words of some
whole documents, ordered by word, with one unused position between documents. Segments are rows of
a Parquet table in the shared folder; building them needs no shuffle, and a segment is bounded by
``segment_bytes`` of text or one text. A search reads the segments once and intersects, for every phrase,
the postings of its words shifted by their offsets, from the word that is rarest in the segment on; what is
left are exact occurrences. Proximity search asks for all words of a phrase inside a span instead.

The phrases of a benchmark are sent to the tasks in blocks of at most ``block_bytes`` of item text, so what is
broadcast is bounded whatever the benchmark's size; hits of a document from several blocks are united.

Defined results: null and empty texts have no words, are in the index, and are never hit; items without
words match nothing; rows that repeat are each searched; an item with a null id marks words but is not listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import stored, words

WINDOW = 10


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def segment(ids: list, texts: list[str | None]) -> dict:
    """Postings of some documents: the words, where their positions begin, positions, and where documents begin."""
    numbers, parts, starts, at = Numbers(), [], [], 0
    for text in texts:
        found = words(text)
        starts.append(at)
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        at += len(found) + 1
    starts.append(at)
    positions = np.concatenate([np.arange(len(p), dtype=np.int32) + s for p, s in zip(parts, starts)]) if parts else []
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=len(numbers))
    return {"doc_ids": ids, "doc_starts": starts, "words": list(numbers),
            "word_starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32).tobytes(),
            "positions": np.asarray(positions, np.int32)[order].tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_bytes: int = 16 << 20) -> DataFrame:
    """The index as a stored table, one row per segment."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame(
        [], f"segment string, doc_ids array<{kind}>, doc_starts array<long>, words array<binary>, word_starts binary, "
            "positions binary").schema
    arrow = {"doc_starts": pa.list_(pa.int64()), "words": pa.list_(pa.binary()), "word_starts": pa.binary(),
             "positions": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, id_type = [], [], 0, None

        def flush() -> pa.RecordBatch:
            row = segment(ids, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([row["doc_ids"]], pa.list_(id_type)),
                 *(pa.array([row[c]], t) for c, t in arrow.items())], names=["segment", "doc_ids", *arrow])

        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= segment_bytes:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "decontamination-index")


class Segment:
    """A segment read back."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.doc_ids = batch.column("doc_ids")[row].values
        self.starts = batch.column("doc_starts")[row].values.to_numpy()
        self.word_starts = np.frombuffer(batch.column("word_starts")[row].as_buffer(), np.int32)
        self.positions = np.frombuffer(batch.column("positions")[row].as_buffer(), np.int32)
        self.size = int(self.starts[-1])
        self.names = batch.column("words")[row].values

    def lookup(self, vocabulary: dict[bytes, int]) -> dict[int, np.ndarray]:
        """Postings of the words of a vocabulary that occur here, by the vocabulary's number."""
        found = {}
        for i, word in enumerate(self.names.to_pylist()):
            number = vocabulary.get(word)
            if number is not None:
                found[number] = self.positions[self.word_starts[i]:self.word_starts[i + 1]]
        return found


def intersect(postings: dict[int, np.ndarray], phrase: tuple[int, ...]) -> np.ndarray:
    """First positions of the exact occurrences of a phrase, rarest word first."""
    lists = [postings.get(w) for w in phrase]
    if any(x is None for x in lists):
        return np.zeros(0, np.int32)
    order = sorted(range(len(phrase)), key=lambda i: len(lists[i]))
    starts = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        wanted = starts + i
        place = np.minimum(np.searchsorted(lists[i], wanted), len(lists[i]) - 1)
        starts = starts[lists[i][place] == wanted]
    return starts


def near(postings: dict[int, np.ndarray], phrase: tuple[int, ...], span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the shortest stretches from a place that hold all words within ``span`` words."""
    lists = [postings.get(w) for w in set(phrase)]
    if any(x is None for x in lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists.sort(key=len)
    starts = np.unique((lists[0].astype(np.int64)[:, None] - np.arange(span)).ravel())
    last = starts.copy()
    for x in lists:
        place = np.searchsorted(x, starts)
        good = place < len(x)
        starts, last, place = starts[good], last[good], place[good]
        last = np.maximum(last, x[place])
        good = last - starts < span
        starts, last = starts[good], last[good]
    keep = np.zeros(len(starts), bool)
    for x in lists:  # a stretch begins with one of the words
        place = np.minimum(np.searchsorted(x, starts), len(x) - 1)
        keep |= x[place] == starts
    return starts[keep], last[keep]


def phrases_of(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    """The windows of a text; a shorter text is one window."""
    found = words(text)
    if not found:
        return []
    return [tuple(found[i:i + window]) for i in range(max(1, len(found) - window + 1))]


def search(index: DataFrame, items: list[tuple], window: int | None = WINDOW, slack: int | None = None, item_type: str = "bigint") -> DataFrame:
    """One row per document: segment, ordinal, doc_id, n_words, spans (united stretches of hit words), items, hits.

    ``items`` are (item_id, text) of one block, the ids of the Spark type ``item_type``. Exact windows by default; ``window=None`` takes whole
    items as phrases; with ``slack`` all words of a phrase must lie within its length plus ``slack`` words.
    ``hits`` has (item_id, first, last) of every occurrence, by word number in the document.
    """
    spark = index.sparkSession
    ship_package(spark)
    vocabulary, phrases = Numbers(), {}
    for item, text in items:
        for phrase in phrases_of(text, window or 1 << 30):
            phrases.setdefault(tuple(vocabulary[w] for w in phrase), set()).add(item)
    held = spark.sparkContext.broadcast((dict(vocabulary), sorted(phrases.items(), key=lambda x: x[0])))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    own = to_arrow_schema(StructType.fromDDL(f"i {item_type}")).field(0).type
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
             "items": pa.list_(own),
             "hits": pa.list_(pa.struct([("item_id", own), ("first", pa.int32()), ("last", pa.int32())]))}

    def rows(seg: Segment) -> list[tuple]:
        known, every = held.value
        postings = seg.lookup(known)
        lengths = np.diff(seg.starts) - 1
        covered = np.zeros(seg.size + 1, np.int32)
        hits: dict[int, list] = {}
        for phrase, owners in every:
            if slack is None:
                first = intersect(postings, phrase)
                last = first + len(phrase) - 1
            else:
                first, last = near(postings, phrase, len(phrase) + slack)
            if not len(first):
                continue
            doc = np.searchsorted(seg.starts, first, side="right") - 1
            inside = (first >= 0) & (last < seg.starts[doc] + lengths[doc])
            for d, a, b in zip(doc[inside].tolist(), first[inside].tolist(), last[inside].tolist()):
                covered[a] += 1
                covered[b + 1] -= 1
                begin = int(seg.starts[d])
                hits.setdefault(d, []).extend((o, a - begin, b - begin) for o in owners)
        out = []
        for d, n in enumerate(lengths.tolist()):
            if d not in hits:
                out.append((n, [], [], []))
                continue
            begin = int(seg.starts[d])
            marks = np.cumsum(covered[begin:begin + n]) > 0  # the count is zero where a document begins
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
            spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
            listed = sorted({o for o, *_ in hits[d] if o is not None})
            out.append((n, spans, listed, [{"item_id": o, "first": a, "last": b} for o, a, b in hits[d]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch, i)
                columns, n = list(zip(*rows(seg))) or [[]] * 4, len(seg.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("segment")[i].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()),
                     seg.doc_ids, *(pa.array(c, t) for c, t in zip(columns, kinds.values()))], names=["segment", "ordinal", "doc_id", *kinds])

    return index.mapInArrow(
        run, f"segment string, ordinal int, doc_id {kind}, n_words long, spans array<struct<first:int,last:int>>, "
             f"items array<{item_type}>, hits array<struct<item_id:{item_type},first:int,last:int>>")


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The distinct items in blocks of about ``block_bytes``, dealt by a hash; one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    count = max(1, -(-int(total) // block_bytes))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, spans, items, n_hit (words inside any occurrence)."""
    index = build_index(docs, id_col, text_col)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    parts = [search(index, block, window, item_type=item_type).drop("hits")
             for block in blocks(benchmark, item_col, item_text_col, block_bytes)]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("segment", "ordinal").agg(
            F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))
    hit = F.aggregate("spans", start, lambda x, s: F.struct(
        (x["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, x["upto"]))).cast("long").alias("n"),
        F.greatest(x["upto"], s["last"]).alias("upto")), lambda x: x["n"])
    return found.withColumn("n_hit", hit).drop("segment", "ordinal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows no word of which lies in a benchmark window, with all their columns.

    Rows are matched by id and the digest of their text, so repeated and null ids are told apart.
    """
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                             F.coalesce(F.col(text_col), F.lit(""))), 256)
    keyed = docs.withColumn("_key", key)
    index_rows = keyed.select("_key", F.col(text_col).alias("text"))
    hit = contamination(index_rows, benchmark, "_key", "text").filter("n_hit > 0").select(F.col("doc_id").alias("_key"))
    return keyed.join(hit, "_key", "left_anti").select(*docs.columns)
