"""WARC archives: writing records, reading files back and putting segments together.

A record is written as WARC 1.1: a ``response`` holds an HTTP message whose body is in
chunked transfer framing; a message longer than ``segment_bytes`` is cut, its first
piece being the record and the others ``continuation`` records that name their origin
and carry a segment number, the last one also the total length.  Payloads that other
pages have as well are written once, by the page with the largest id; the others are
``revisit`` records.

Files go through Spark's own text writer, whose line separator is the blank line that
ends a record, so each file is a gzipped WARC file in the shared folder; whole files
are read back as binary rows, decompressed as a stream and parsed by Content-Length.
Complete records need no exchange; only segments are grouped by their origin, and a
group is one record, bounded by the size of a value.  Damage (a missing or doubled
segment, a wrong total length, broken framing, a wrong digest) is told in the column
``problem`` and not raised.

Defined results.  A null payload is an empty one.  A null page_id stays null and is
never the largest.  Rows that repeat the largest page_id of a payload are all
responses.  A null url is left out; blank and control characters in one are escaped.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, packed, salted_join, shared_dir

SEGMENT_BYTES = 32 << 10
CHUNK = 8 << 10
FILE_ROWS = 4000
PIECE = 1 << 20
_END = b"\r\n\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(hex40):
    """Column: base32 of a 40-digit hex string."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex40, g * 5 + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_B32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        out.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size < 0 or at + size > len(body):
            raise ValueError("a chunk is cut short")
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("no line end after a chunk")
        at += size + 2


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def _escape(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, segment_bytes: int):
    """The records of one page without their closing blank line."""
    fields = [("WARC-Date", "2024-01-01T00:00:00Z")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", _escape(url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    first = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", origin), *fields]
    if keeper is not None:
        first += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(keeper))]
        yield _header([*first, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        yield _header(first, block)
        return
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _header([*first, ("WARC-Segment-Number", "1")], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(pieces) else []
        yield _header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(i)), *more], piece)


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC files to path."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = pages.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= min_revisit_bytes)
    shared = known.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("many")).where("many > 1 and keeper is not null").drop("many")
    later = salted_join(known.drop("size"), shared, "sha").where("keeper is not null and not (page_id <=> keeper)").select("page_id", "sha", "keeper")
    later = later.distinct().withColumnsRenamed({"page_id": "_page", "sha": "_sha"})
    keyed = pages.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1("html") == F.col("_sha")), "left")
    rows = keyed.select("page_id", "url", "html", "keeper")

    def build(batches):
        for batch in batches:
            out, size = [], 0
            for page, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                for r in records(page, url, html.encode(), keeper, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    built = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    built.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _pieces(content: bytes):
    """A WARC file's bytes in pieces of at most PIECE, from gzip members or as they are."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
        return
    z = zlib.decompressobj(31)
    for at in range(0, len(content), PIECE >> 2):
        rest = content[at : at + (PIECE >> 2)]
        while rest:
            out = z.decompress(rest, PIECE)
            if out:
                yield out
            rest = z.unconsumed_tail
            if z.eof:
                rest, z = z.unused_data, zlib.decompressobj(31)
        while out := z.decompress(b"", PIECE):  # what the window still holds
            yield out


def _parse(content: bytes):
    """(headers, block) of each record of a WARC file; a record and a piece are held at a time."""
    pieces, held = _pieces(content), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while held.startswith(b"\r\n") or (len(held) < 2 and more()):
            if held.startswith(b"\r\n"):
                del held[:2]
        start = 0
        while (end := held.find(_END, start)) < 0:
            start = max(0, len(held) - 3)
            if not more():
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", "0"))
        while len(held) < end + 4 + size and more():
            pass
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


_ROW = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
_DONE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


def _number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def _finish(block: bytes | None, kind: str | None, stated: str | None, problem: str | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole block."""
    if problem or kind != "response":
        return None, problem
    head, _, body = block.partition(_END)
    try:
        if b"transfer-encoding: chunked" in head.lower():
            body = unchunk(body)
    except ValueError as e:
        return None, f"bad chunked framing: {e}"
    return body, None if stated in (None, digest(body)) else "payload digest differs"


def read(spark, path: str) -> DataFrame:
    """The response and revisit records below path (columns RECORD), segments put together."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in _parse(content.as_py()):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    origin = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                    stated = (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    rows.append((origin, _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), _number(f.get("x-page-id")), f.get("warc-target-uri"), kind, _number(f.get("x-refers-to-page")), stated, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield packed(_ROW, rows)
                        rows, size = [], 0
                if rows:
                    yield packed(_ROW, rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    shape = "origin string, number long, total long, page_id long, url string, record_type string, refers_to long, payload_digest string, block binary"
    parsed = files.mapInArrow(parse, shape)

    def whole(batches):
        for batch in batches:
            rows = []
            for _, _, _, page, url, kind, refers, stated, block in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((page, url, kind, refers, stated, *_finish(block, kind, stated, None)))
            yield packed(_DONE, rows)

    def joined(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                rows.append(reassemble(parts))
            yield packed(_DONE, rows)

    single = parsed.where("number is null and record_type <> 'continuation'").mapInArrow(whole, RECORD)
    columns = [f.name for f in _ROW if f.name != "origin"]
    pieces = parsed.where("number is not null or record_type = 'continuation'").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("parts"))
    return single.unionByName(pieces.select("parts").mapInArrow(joined, RECORD))


def reassemble(parts: list[dict]) -> tuple:
    """A row of RECORD from the segments of one record, in the order of their numbers."""
    first = next((p for p in parts if p["record_type"] != "continuation"), None)
    numbers = [p["number"] for p in parts]
    totals = {p["total"] for p in parts if p["total"] is not None}
    block = b"".join(p["block"] for p in parts)
    if first is None or numbers[0] != 1:
        problem = "no first segment"
    elif numbers != list(range(1, len(parts) + 1)):
        problem = "segments are missing or doubled"
    elif totals != {len(block)}:
        problem = "total length differs" if totals else "no last segment"
    else:
        problem = None
    first = first or dict.fromkeys(columns_of_first, None)
    payload, problem = _finish(block, first["record_type"], first["payload_digest"], problem)
    return first["page_id"], first["url"], first["record_type"], first["refers_to"], first["payload_digest"], payload, problem


columns_of_first = ("page_id", "url", "record_type", "refers_to", "payload_digest")


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of pages, from archives written and read back.

    The size of a revisit's payload is that of the response with the same digest.  A
    response that is damaged has a problem, and neither size nor digest.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path, segment_bytes)
    got = cut(read(spark, path).select("page_id", "record_type", "refers_to", F.coalesce(base32_of_hex(F.sha1("payload")), F.when(F.col("record_type") != "response", F.col("payload_digest"))).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "problem"), "warc-records")
    sizes = got.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_size"))
    revisits = salted_join(got.where("record_type = 'revisit'"), sizes, "payload_digest")
    out = got.where("record_type = 'response'").withColumn("_size", F.col("payload_bytes")).unionByName(revisits)
    return out.select("page_id", F.coalesce("payload_bytes", "_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "problem")
