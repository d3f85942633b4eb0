import gzip
from pathlib import Path

import pytest
from aicensus.llm import warc
from aicensus.llm.common import shared_folder
from hypothesis import given
from hypothesis import strategies as st

SCHEMA = "page_id long, url string, html string, digest string, copy int"
HTML = "<p>é🙂</p>" * 4000
ROWS = [(1, "http://a/", HTML, "x", 1), (2, None, HTML, "x", 1), (2, "http://b/\r\nX: 1", HTML, "x", 1), (3, "u", None, "x", 1),
        (4, "u", "", "x", 1), (5, "u", "in\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "x", 1),
        (None, "u", "lost", "x", 1), (7, "u", "WARC/1.1\r\n" * 5000, "x", 1)]


def read(spark, rows, **options):
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, **options)
    return folder, warc.read_archives(spark, folder, payloads=True)


@given(st.binary(max_size=500), st.integers(1, 60))
def test_chunked_framing(payload, size):
    body = warc.chunked(payload, size)
    assert warc.unchunked(body) == (payload, True)
    assert not warc.unchunked(body[:-4])[1]


def test_extensions_trailers_and_broken_chunks():
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nX: y\r\n\r\n") == (b"abc", True)
    assert warc.unchunked(b"zz\r\nabc\r\n") == (b"", False)
    assert warc.unchunked(b"5\r\nabc") == (b"abc", False)


@pytest.mark.parametrize("segment", [64, 1000, 1 << 20])
def test_round_trip(spark, segment):
    _, found = read(spark, ROWS, segment_bytes=segment, chunk_bytes=50)
    rows = found.collect()
    assert len(rows) == len(ROWS) and {r["status"] for r in rows} == {"ok"}
    by_page = {}
    for r in rows:
        by_page.setdefault(r["record_id"].split(":")[2], []).append(r)
    for page, _, html, *_ in ROWS:
        for r in by_page["" if page is None else str(page)]:
            assert r["payload_digest"] == warc.base32_sha1((html or "").encode())
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == (html or "").encode()
    kinds = {p: sorted((r["record_type"], (r["refers_to"] or "::").split(":")[2]) for r in rs) for p, rs in by_page.items()}
    assert kinds["1"] == [("response", "")] and kinds["2"] == [("revisit", "1")] * 2 and kinds["4"] == [("revisit", "3")]


def test_repeated_rows_and_least_size(spark):
    rows = [(9, "u", "same", "x", 1)] * 3
    kinds = sorted(r["record_type"] for r in read(spark, rows)[1].collect())
    assert kinds == ["response", "revisit", "revisit"]
    assert {r["record_type"] for r in read(spark, rows, revisit_bytes=5)[1].collect()} == {"response"}


def test_lost_segments_are_reported(spark, tmp_path):
    records = list(warc.records_of("urn:page:1:d:1", "u", b"z" * 1000, None, "d", 300, 100))
    assert len(records) > 3
    for lost in range(len(records)):
        kept = records[:lost] + records[lost + 1:]
        folder = tmp_path / str(lost)
        folder.mkdir()
        with gzip.open(folder / "a.gz", "wb") as f:
            f.write(b"".join(r + warc.END for r in reversed(kept)))
        rows = warc.read_archives(spark, str(folder)).collect()
        assert [(r["record_type"], r["status"]) for r in rows] == [("response", "length")]


def test_files_are_archives(spark):
    folder, _ = read(spark, ROWS, segment_bytes=500)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).glob("*.gz"))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    assert b"\r\nX: 1" not in text.split(b"WARC-Target-URI: http://b/")[1][:20]


def test_empty_table(spark):
    assert read(spark, [])[1].count() == 0


def old_record(n, body, **fields):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:{n}>", "Content-Length": len(http)} | fields
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + warc.END[2:] + http + warc.END


@pytest.mark.parametrize("version", [b"WARC/1.0", b"WARC/1.1", b"WARC/0.18"])
def test_all_records_of_any_version_are_read(spark, tmp_path, version):
    bodies = [b"", b"ends in a line\r\n", b"in\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n", b"z" * 70_000, b"last"]
    for name in "ab":
        with gzip.open(tmp_path / f"{name}.warc.gz", "wb") as f:
            f.write(b"".join(old_record(f"{name}{i}", b) for i, b in enumerate(bodies)).replace(b"WARC/1.0", version))
    bodies = [b.replace(b"WARC/1.0", version) for b in bodies]
    found = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path), payloads=True).collect()}
    if len(version) == len(b"WARC/1.0"):
        assert {r["status"] for r in found.values()} == {"ok"}
    assert {k: bytes(r["payload"]) for k, r in found.items() if not k.endswith("2")} == {
        f"urn:{name}{i}": b for name in "ab" for i, b in enumerate(bodies) if i != 2}


def test_records_cut_off_at_the_end_have_a_row(spark, tmp_path):
    whole, cut = old_record(1, b"first"), old_record(2, b"second \r\n\r\nWARC/1.0\r\n")
    for n in range(1, len(cut) - len(warc.END)):
        if n == len(warc.VERSION):  # only a separator: Spark's reader gives no piece behind it
            continue
        rows = list(warc.records_in(iter([("f", p) for p in (whole + cut[:n]).split(warc.SEPARATOR)])))
        assert [w for *_, w in rows] == [True, False], n
    for name, n in (("head", 40), ("block", len(cut) - 8)):
        (tmp_path / f"{name}.warc").write_bytes(whole + cut[:n])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"] or "", r["status"]) for r in rows) == [("", "length"), ("urn:1", "ok"), ("urn:1", "ok"), ("urn:2", "length")]


def test_records_in_one_piece_and_wrong_lengths():
    a, b, c = (old_record(n, b"%d" % n) for n in (1, 2, 3))
    ids = lambda *pieces: [(f["warc-record-id"], w) for f, _, w in warc.records_in(("f", p) for p in pieces)]
    assert ids(a + b, c[5:]) == [("<urn:1>", True), ("<urn:2>", True), ("<urn:3>", True)]
    short = old_record(1, b"too long for its length", **{"Content-Length": 25})
    assert ids(short + b + c) == [("<urn:1>", False), ("<urn:2>", True), ("<urn:3>", True)]
    unstated = old_record(1, b"x").replace(b"Content-Length", b"Other")
    assert ids(unstated + b) == [("<urn:1>", False), ("<urn:2>", True)]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_cut_segments_are_reported_once(spark, tmp_path, n):
    records = [r + warc.END for r in warc.records_of("urn:page:1:d:1", "u", b"z" * 1000, None, "d", 300, 100)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:n - 1]))
    (tmp_path / "b.warc").write_bytes(records[n - 1][:-60])
    (tmp_path / "c.warc").write_bytes(b"".join(records[n:]))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["record_id"], r["status"]) for r in rows] == [("urn:page:1:d:1", "length")]


def segment(n, kind, body, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{n}>", "Content-Length": len(body)} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + warc.END


@pytest.mark.parametrize("number", ["x", "", "0", "-1", "2147483648", "9" * 40, "1.0"])
def test_segment_numbers_that_cannot_be_read(spark, tmp_path, number):
    (tmp_path / "a.warc").write_bytes(
        segment(1, "response", b"HTTP/1.1 200 OK\r\n\r\nabc", WARC_Segment_Number=number)
        + segment(2, "continuation", b"def", WARC_Segment_Origin_ID="<urn:1>", WARC_Segment_Number="2", WARC_Segment_Total_Length="x" + number)
        + segment(3, "resource", b"whole"))
    rows = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert set(rows) == {"urn:1", "urn:3"} and rows["urn:1"]["status"] == "length" and rows["urn:3"]["status"] == "ok"


@pytest.mark.parametrize("payloads", [False, True])
def test_segmented_records_keep_their_type(spark, tmp_path, payloads):
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(segment(2, "continuation", b"def", WARC_Segment_Origin_ID="<urn:1>", WARC_Segment_Number="2", WARC_Segment_Total_Length="6")
                + segment(1, "resource", b"abc", WARC_Segment_Number="1") + segment(3, "conversion", b"text")
                + segment(5, "metadata", b"m", WARC_Segment_Number="1", WARC_Segment_Total_Length="1"))
    rows = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path), payloads=payloads).collect()}
    assert {k: (r["record_type"], r["status"], r["payload_bytes"]) for k, r in rows.items()} == {
        "urn:1": ("resource", "ok", 6), "urn:3": ("conversion", "ok", 4), "urn:5": ("metadata", "ok", None)}
    assert rows["urn:1"]["payload_digest"] == warc.base32_sha1(b"abcdef")
    assert rows["urn:1"]["payload"] == (b"abcdef" if payloads else None)


@pytest.mark.parametrize("field, body, want", [
    ("chunked", b"3\r\nabc\r\n0\r\n\r\n", (b"abc", True)), ("Chunked , identity", b"3\r\nabc\r\n0\r\n\r\n", (b"abc", True)),
    ("identity", b"abc", (b"abc", True)), ("", b"abc", (b"abc", True)), ("gzip, chunked", b"abc", (b"abc", False)), ("gzip", b"abc", (b"abc", False))])
def test_transfer_codings(field, body, want):
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: " + field.encode() + b"\r\n\r\n" + body) == want


def test_plain_archives_are_read_from_their_beginning(spark, tmp_path):
    """A payload full of separators, in a file that Spark would split inside it."""
    inner = b"".join(old_record(f"no{i}", b"x" * 100) for i in range(2000))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.warc").write_bytes(old_record(1, inner) + old_record(2, b"last"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path), payloads=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: (bytes(r["payload"]), r["status"]) for k, r in rows.items()} == {"urn:1": (inner, "ok"), "urn:2": (b"last", "ok")}


def test_pieces_of_any_block_size():
    import pyarrow as pa

    data = b"WARC/1.0\r\na" + warc.SEPARATOR + b"b" + warc.SEPARATOR + warc.SEPARATOR + b"c\r\n\r"
    for size in (1, 2, 3, 8, 100):
        assert list(warc.separated(pa.BufferReader(data), size)) == data.split(warc.SEPARATOR)
