import base64
import hashlib
import struct

import public_tokenizers
import tiktoken
from aicensus.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(bpe.model_bytes(TOKENS), PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
TEXTS = ["", None, "Hello  world\n\n it's 123 ▁<unk></s>", "é中🙂\0", "ab" * 100_000, " " * 5000, "a" * 3000 + "!" * 70]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_as_the_rank_library_and_back(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_known_matches_stay_bounded():
    small = bpe.Codec(bpe.model_bytes(TOKENS), PATTERN, known=5)
    texts = ["one two three four five six seven", "eight nine ten", "one two"] * 3
    assert [x.tolist() for x in small.encode_all(texts, group=1)] == [PLAIN.encode_ordinary(t) for t in texts]


def test_round_trip_digests(docs):
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs(list(enumerate(TEXTS))), PATH, PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = PLAIN.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(docs):
    ids = bpe.encode(docs(list(enumerate(TEXTS))), PATH, PATTERN)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(ids, PATH, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_empty_table(docs):
    assert bpe.round_trip(docs([]), PATH, PATTERN).count() == 0


def test_vocabulary_file(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    codec = bpe.Codec(bpe.model_bytes(bpe.read_ranks(str(path))), PATTERN)
    assert codec.encode("é!").tolist() == list("é!".encode())
