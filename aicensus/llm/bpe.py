"""Byte-level BPE through a sentencepiece model written straight from the vocabulary.

Each token's bytes are mapped to printable characters, one per byte, and become a piece whose score is
its negative rank; with identity normalisation and no added spaces, the best-scored merge is the
merge of the lowest rank. Texts are split by the tokenizer's pattern, every match is encoded apart
(a match that is a token itself is that token), and decoding maps pieces back to bytes.

Null texts count as empty and give no ids. Texts may be of any length: matches are encoded in
bounded groups and the memory of a task holds one text, its ids and a bounded table of known matches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from ..session import ship_package


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1 where it is visible, from U+0100 on otherwise."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    place = {b: b for b in visible} | {b: 0x100 + i for i, b in enumerate(hidden)}
    return [chr(place[b]) for b in range(256)]


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: piece 0 is the unknown piece, piece rank + 1 the token of that rank."""
    letters = byte_characters()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(map(letters.__getitem__, token)), score=-float(rank))
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.byte_fallback = pb.TrainerSpec.BPE, len(tokens) + 1, False
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 0, -1, -1, -1
    plain = model.normalizer_spec
    plain.name, plain.add_dummy_prefix = "identity", False
    plain.remove_extra_whitespaces, plain.escape_whitespaces = False, False
    return model.SerializeToString()


def grouped(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


class Codec:
    """Encoder and decoder of one task. Known matches are kept up to ``known`` entries."""

    def __init__(self, model: bytes, pattern: str, known: int = 300_000):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        names = (self.pieces.id_to_piece(i) for i in range(1, self.pieces.get_piece_size()))
        self.tokens = [bytes(byte_of[c] for c in name) for name in names]
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.table = {i: c for i, c in enumerate(self.letters)}
        self.known, self.limit = {}, known

    def learn(self, matches: set[str]) -> None:
        """Ids of matches that are not known yet."""
        unknown = []
        for m in matches:
            rank = self.rank.get(m.encode())
            if rank is None:
                unknown.append(m)
            else:
                self.known[m] = (rank,)
        mapped = [m.encode().decode("latin-1").translate(self.table) for m in unknown]
        for m, ids in zip(unknown, self.pieces.encode(mapped, num_threads=1) if mapped else []):
            self.known[m] = tuple(i - 1 for i in ids)

    def encode_all(self, texts: Iterable[str], group: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of each text. New matches are looked up for groups of about ``group`` characters at once."""
        for part in grouped(texts, group):
            split = [self.split(t) for t in part]
            if len(self.known) > self.limit:
                self.known.clear()
            if new := set().union(*split).difference(self.known):
                self.learn(new)
            for matches in split:
                yield np.fromiter(chain.from_iterable(map(self.known.__getitem__, matches)), np.dtype("<u4"))

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def with_codec(df: DataFrame, columns: list[str], outputs: str, path: str, pattern: str, work) -> DataFrame:
    """Rows of ``columns`` through ``work(codec, batch)``; the model is broadcast (its size is the vocabulary's)."""
    spark = df.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in batches:
            yield work(codec, batch)

    return df.select(*columns).mapInArrow(run, outputs)


def texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(1))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (array of int)."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.astype(np.int32) for x in codec.encode_all(texts(batch))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
            names=["doc_id", "n_tokens", "ids"])

    return with_codec(df, [id_col, text_col], f"doc_id {kind}, n_tokens long, ids array<int>", path, pattern, work)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, data (the bytes); null ids give no bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [codec.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return with_codec(df, [id_col, ids_col], f"doc_id {kind}, data binary", path, pattern, work)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, digests of the ids and of the bytes decoded from them.

    The digests are taken where the ids are made, so ids of whole texts are not moved.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for ids in codec.encode_all(texts(batch)):
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                         hashlib.sha256(codec.decode(ids)).hexdigest()))
        n, a, b = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_codec(df, [id_col, text_col],
                      f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, work)
