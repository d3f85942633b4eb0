"""WARC archives: written with segments, chunked framing and revisits; read back and reassembled.

Writing: one record per row. Of rows with equal payloads (at least ``revisit_bytes`` long) the smallest id is the
response and the others are revisits of it. Responses carry the HTTP head and the payload in chunked framing;
a block above ``segment_bytes`` is cut into a first segment and continuation records, the last of which states
the total length. Files are gzip text, so Spark's own writer places them, in any store.

Reading: a file is read by one task, record by record; the declared lengths decide where a record ends, also
where a payload holds the record separator. Any WARC version is read. Continuations meet their origin by its identifier, in order
of the segment number, one record in memory at a time; the total length and the payload digest are verified.

Defined results: a null payload is empty; a null id sorts behind all others; rows that repeat id and payload are one response and
revisits of it; ``status`` is ``ok``, ``length`` (segments missing or of a wrong total, a record cut off at the end
of its file, no declared length, or bytes between a declared end and the next record), ``framing`` (broken chunks) or
``digest``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stored
from ..sources.corpus import open_root

END = b"\r\n\r\n"
FIRST = b"WARC/1.1\r\n"
VERSION = b"WARC/"
SEPARATOR = END + VERSION
LINE_ENDS = re.compile(rb"[\r\n]*")
# Number of a segment that states none, or none that can be read: behind all others, so its record is not whole.
UNNUMBERED = (1 << 31) - 1


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """Payload of a chunked body, and whether the framing is whole. Chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return b"".join(parts), False
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(parts), False
        at = line + 2
        if size == 0:
            return b"".join(parts), body.find(b"\r\n", at) >= 0
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return b"".join([*parts, body[at:at + max(size, 0)]]), False
        parts.append(body[at:at + size])
        at += size + 2


def head(fields: list[tuple[str, str | int | None]]) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)
    return FIRST + lines.encode("utf-8", "surrogatepass") + b"\r\n"


def records_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, segment_bytes: int,
               chunk_bytes: int) -> Iterator[bytes]:
    """The record of a payload and its continuation records, without the closing separator."""
    digest = f"sha1:{base32_sha1(payload)}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Date", date)]
    if refers_to is not None:
        yield head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Target-URI", url),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", digest),
                    ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http))]) + http
        return
    block = http + chunked(payload, chunk_bytes)
    pieces = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, piece in enumerate(pieces, 1):
        last = n == len(pieces)
        number = [("WARC-Segment-Number", n)] if len(pieces) > 1 else []
        if n == 1:
            yield head([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common,
                        ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), *number,
                        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(piece))]) + piece
        else:
            yield head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), *common,
                        ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{record_id}>"), *number,
                        ("WARC-Segment-Total-Length", len(block) if last else None),
                        ("Content-Length", len(piece))]) + piece


def with_roles(pages: DataFrame, id_col: str, url_col: str, body_col: str, revisit_bytes: int) -> DataFrame:
    """record_id, url, packed payload, refers_to (a record id) of every row.

    Equal payloads are found on (id, digest) pairs; payloads travel once, compressed, to their pair.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    base = base.withColumn("digest", F.sha2("body", 256))
    pairs = base.select("id", "digest", F.octet_length("body").alias("size")).groupBy("id", "digest", "size").agg(
        F.count(F.lit(1)).alias("n"))
    first = pairs.groupBy("digest").agg(F.min("id").alias("first_id"))
    roles = pairs.join(first, "digest").select(
        F.struct("id", "digest").alias("pair"), "first_id", (F.col("size") >= revisit_bytes).alias("may_revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(x.as_buffer()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(packed, pa.binary())],
                names=["id", "url", "digest", "packed"])

    kind = pages.schema[id_col].dataType.simpleString()
    packed = base.mapInArrow(pack, f"id {kind}, url string, digest string, packed binary").select(
        F.struct("id", "digest").alias("pair"), "url", "packed")
    name = lambda i, copy: F.concat_ws(
        ":", F.lit("urn:page"), F.coalesce(i.cast("string"), F.lit("")), F.substring("pair.digest", 1, 32), copy)
    copy = F.row_number().over(Window.partitionBy("pair").orderBy("url"))
    joined = packed.join(roles, "pair").withColumn("copy", copy)
    response = (F.col("pair.id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)) | ~F.col("may_revisit")
    return joined.select(name(F.col("pair.id"), F.col("copy").cast("string")).alias("record_id"), "url", "packed",
                         F.when(~response, name(F.col("first_id"), F.lit("1"))).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   *, revisit_bytes: int = 0, segment_bytes: int = 16 << 10, chunk_bytes: int = 4096,
                   date: str = "1970-01-01T00:00:00Z", records_per_file: int = 100_000) -> None:
    """Writes one record per row (and its continuations) into gzip files of the folder."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for record_id, url, packed, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(records_of(record_id, url, unpacker.decompress(packed), refers_to, date, segment_bytes,
                                      chunk_bytes))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = with_roles(pages, id_col, url_col, body_col, revisit_bytes)
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.options(
        lineSep=END.decode(), compression="gzip", maxRecordsPerFile=records_per_file,
        **{"zlib.compress.level": "BEST_SPEED"}).text(folder)


def parse_head(raw: bytes) -> dict[str, str]:
    fields = {}
    for line in raw.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon:
            fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields


def records_in(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict, bytes, bool]]:
    """Head and block of each record and whether it is whole, from the separated pieces of files in order.

    A piece may hold several records. A record that its file's end cuts off has the fields of its whole lines.
    """
    parts, have, need, current = [], 0, 0, None
    for file, piece in pieces:
        if file != current:
            yield from cut_off(parts)
            parts, have, need, current = [], 0, 0, file
        parts += [SEPARATOR, piece] if parts else [piece]
        have += len(piece) + len(SEPARATOR) * (len(parts) > 1)
        if have < need:
            continue
        held, at, need = b"".join(parts), 0, 0
        while at < len(held):
            start = held.find(END, at) + len(END)
            if start < len(END):
                break
            fields = parse_head(held[at:start])
            size = declared_length(fields)
            stop = start + (size or 0)
            if stop > len(held):
                need = stop - at
                break
            behind = LINE_ENDS.match(held, stop).end()
            # What is left is nothing or begins the next record; else the length is wrong, and the next separator counts.
            fits = VERSION.startswith(held[behind:behind + len(VERSION)])
            yield fields, held[start:stop], size is not None and fits
            found = held.find(SEPARATOR, stop)
            at = behind if fits else len(held) if found < 0 else found + len(END)
        parts, have = ([held[at:]], len(held) - at) if at < len(held) else ([], 0)
    yield from cut_off(parts)


def declared_length(fields: dict[str, str]) -> int | None:
    size = fields.get("content-length", "")
    return int(size) if size.isascii() and size.isdigit() else None


def cut_off(parts: list[bytes]) -> Iterator[tuple[dict, bytes, bool]]:
    """The record still held when its file ends, if there is one."""
    if parts:
        top, end, block = b"".join(parts).partition(END)
        yield parse_head(top if end else top[:max(top.rfind(b"\r\n"), 0)]), block, False


def payload_of(block: bytes) -> tuple[bytes, bool]:
    """The HTTP payload of a block, chunked framing decoded, and whether it is whole."""
    at = block.find(END)
    if at < 0:
        return b"", False
    body = block[at + len(END):]
    codings = [c.strip().lower() for c in parse_head(block[:at]).get("transfer-encoding", "").split(",")]
    codings = [c for c in codings if c not in ("", "identity")]
    if codings == ["chunked"]:
        return unchunked(body)
    return body, not codings


FIELDS = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
          "payload_digest string, status string, payload binary")
_KINDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(),
          "payload_bytes": pa.int64(), "payload_digest": pa.string(), "status": pa.string(), "payload": pa.binary()}
_SEGMENT = {"origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "block": pa.binary()}


# Types of records that hold a payload; that of a response lies behind an HTTP head.
BODIES = ("response", "resource", "conversion")


def stated_number(text: str | None, most: int) -> int | None:
    """A number from 0 to ``most``, or None for any other text."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 20 and int(text) <= most else None


def finished(row: dict, block: bytes, whole: bool, payloads: bool) -> dict:
    """The row of a record with a payload, which is decoded and verified."""
    payload, framed = payload_of(block) if row["record_type"] == "response" else (block, True)
    digest = base32_sha1(payload)
    stated = (row["payload_digest"] or "").removeprefix("sha1:")
    status = "length" if not whole else "framing" if not framed else "digest" if stated and stated != digest else "ok"
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "status": status,
                  "payload": payload if payloads else None}


def to_batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def separated(source: pa.NativeFile, block: int = 8 << 20) -> Iterator[bytes]:
    """The pieces of a file between separators, read block by block."""
    held = b""
    while found := source.read(block):
        *pieces, held = (held + found).split(SEPARATOR)
        yield from pieces
    yield held


def plain_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """file, value of archives that are not compressed. Spark would split these at any separator, also one inside a payload;
    here a task reads a file from its beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_root(path)
                with system.open_input_stream(at) as source:
                    for piece in separated(source):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([piece], pa.binary())], names=["file", "value"])

    # Only names are asked for, so no content is read here.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter("length > 0").select("path")
    return listed.filter(~F.col("path").endswith(".gz")).mapInArrow(run, "file string, value binary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record: FIELDS. Responses, resources and conversions have a verified payload; revisits the stated digest."""
    ship_package(spark)
    packed = spark.read.option("lineSep", SEPARATOR.decode()).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(folder)
    lines = packed.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).unionByName(
        plain_pieces(spark, folder))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v.as_py()) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1)))
        bare = lambda v: v.strip("<>") if v else None
        rows, size = [], 0
        for fields, block, whole in records_in(pieces):
            number, kind, origin = (fields.get(f"warc-{x}") for x in ("segment-number", "type", "segment-origin-id"))
            # A number that cannot be read is behind all others, so its record is not whole.
            segment = number is not None or kind == "continuation" and origin
            number = stated_number(number, UNNUMBERED - 1) or UNNUMBERED
            row = {"record_id": bare(fields.get("warc-record-id")), "record_type": kind,
                   "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")),
                   "payload_digest": fields.get("warc-payload-digest"), "status": "ok" if whole else "length"}
            if segment:
                row |= {"number": number, "block": block, "total": stated_number(fields.get("warc-segment-total-length"), (1 << 63) - 1)}
                size += len(block)
            elif kind in BODIES:
                row = finished(row, block, whole, payloads)
                size += row["payload_bytes"] * payloads
            elif kind == "revisit":
                row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:")
            row["origin"] = bare(origin) or row["record_id"]
            rows.append(row)
            if len(rows) >= 5000 or size >= 8 << 20:
                yield to_batch(rows, _KINDS | _SEGMENT)
                rows, size = [], 0
        if rows:
            yield to_batch(rows, _KINDS | _SEGMENT)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def close() -> list[dict]:
            if not group or group[0]["number"] is None:
                return group
            first, last = group[0], group[-1]
            block = b"".join(r["block"] for r in group)
            whole = [r["number"] for r in group] == list(range(1, len(group) + 1)) and last["total"] == len(block) and all(
                r["status"] == "ok" for r in group)
            if first["record_type"] in BODIES:
                return [finished(first, block, whole, payloads)]
            # Without its first segment a record's type is not known; other types keep theirs.
            kind = "response" if first["record_type"] == "continuation" else first["record_type"]
            return [{"record_id": first["origin"], "record_type": kind, "target_uri": first["target_uri"],
                     "status": "ok" if whole else "length"}]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and (row["origin"] != group[0]["origin"] or None in (row["number"], group[0]["number"])):
                    out.extend(close())
                    group = []
                group.append(row)
            if out:
                yield to_batch(out, _KINDS)
        if group:
            yield to_batch(close(), _KINDS)

    parsed = lines.mapInArrow(parse, FIELDS + ", origin string, number int, total long, block binary")
    grouped = lambda rows: rows.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(reassemble, FIELDS)
    if not payloads:  # whole records are narrow rows here
        return grouped(parsed)
    parsed = stored(parsed, "warc-parsed")  # read twice, so that payloads of whole records cross no shuffle
    return parsed.filter("number IS NULL").drop("origin", "number", "total", "block").unionByName(grouped(parsed.filter("number IS NOT NULL")))
