"""WARC archives: written and read by Spark, with segmented records put together again.

Writing: each page is a WARC 1.1 record whose block is an HTTP response in
chunked transfer framing. Pages with the payload of another page become revisit
records. A block over SEGMENT bytes is cut into a first segment and continuation
records. The text sink writes the bytes as they are, a gzip stream a task.

Reading: gzip streams are read by one task each, cut at the version line and put
together again where a payload itself holds that line, as far as each header's
Content-Length says. Segments are then grouped by the identifier of the record
they began in, ordered by number, checked against the total length, and the
chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.text import column
from cairn.session import new_path

SEGMENT, CHUNK = 32768, 8192
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Revisits that one broadcast may hold (about 32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts of a payload's pages where there are more repeated payloads than that.
SALTS = 64
#: Records of one archive at most: a gzip stream is read by one task.
FILE_RECORDS = 20_000
RESULT = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"


def record_id(page_id: int, digest: str, part: int = 1) -> bytes:
    """Pages may repeat an id with unlike payloads, so the payload's digest is part of the name."""
    return f"<urn:cairn:page:{page_id}:{digest}:{part}>".encode()


def b32sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size line is cut off")
        size = int(body[at:eol].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = eol + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[eol + 2 : at])
        at += 2


def _head(kind: bytes, rid: bytes, length: int, fields: list[tuple[bytes, bytes]]) -> bytes:
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", rid), (b"WARC-Date", DATE.encode()), *fields, (b"Content-Length", b"%d" % length)]
    return VERSION + b"".join(b"%b: %b\r\n" % x for x in lines) + b"\r\n"


def records(page_id: int, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, each without its closing pair of line ends."""
    name = b32sha1(payload)
    digest = b"sha1:" + name.encode()
    target = [(b"WARC-Target-URI", " ".join(url.split()).encode())] if url else []
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [(b"WARC-Refers-To", record_id(refers_to, name)), (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _head(b"revisit", record_id(page_id, name), len(block), [*target, (b"WARC-Payload-Digest", digest), *more]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        fields = [(b"WARC-Payload-Digest", digest)] if n == 1 else [(b"WARC-Segment-Origin-ID", record_id(page_id, name))]
        if len(parts) > 1:
            fields.append((b"WARC-Segment-Number", b"%d" % n))
            if n == len(parts):
                fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _head(b"response" if n == 1 else b"continuation", record_id(page_id, name, n), len(part), [*target, *fields]) + part


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write a record a row of (page_id, url, html); a null html is an empty payload.

    Of records with equal payloads of `least` bytes or more, the one with the
    largest page_id is the response and the others revisit it; smaller payloads
    are all responses. Rows that repeat a page_id with the same payload are
    written once each, the same way; with unlike payloads they are unlike records,
    since a record is named after its page and its payload's digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("d"), F.length(html).alias("n")).where(F.col("n") >= least)
    newest = light.groupBy("d", "n").agg(F.max("page_id").alias("to"), F.count("*").alias("k")).where("k > 1").select("d", "n", "to")
    if newest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = light.join(F.broadcast(newest), ["d", "n"])
    else:  # a third of all pages may have one payload
        salted = light.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        met = salted.join(newest.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["d", "n", "s"])
    revisits = met.where(F.col("page_id") != F.col("to")).select(F.col("page_id").alias("_from"), F.col("to").alias("_to"), F.col("d").alias("_d")).distinct()
    # page ids are few where payloads seldom repeat: then the pages need not be moved to meet them
    revisits = F.broadcast(revisits) if revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else revisits
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("_sha", F.sha1("html"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("_from")) & (F.col("_sha") == F.col("_d")), "left")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, u, h, to in zip(*[column(b, c) for c in ("page_id", "url", "html", "_to")], strict=True):
                if p is not None:
                    out += records(p, u, h, to, segment)
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    made = rows.select("page_id", "url", "html", "_to").mapInArrow(go, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(piece: bytes) -> tuple[dict[bytes, bytes], bytes, int] | None:
    """(header fields in lower case, what follows, Content-Length) of a record without its version line."""
    head, sep, rest = piece.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return (fields, rest, int(length)) if sep and length.isdigit() else None


def blocks(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Records of a stream that was cut at every version line, in payloads too."""
    file, fields, parts, missing = None, None, [], 0
    for name, piece in pieces:
        if name != file:
            if missing:
                raise ValueError(f"{file}: the last record is cut off")
            file, fields, parts, missing = name, None, [], 0
        if missing:
            parts += [VERSION, piece]
            missing -= len(VERSION) + len(piece)
        elif piece.strip(b"\r\n"):
            got = parse(piece)
            if got is None:
                raise ValueError(f"{name}: not a record: {piece[:80]!r}")
            fields, rest, length = got
            parts, missing = [rest], length - len(rest)
        else:
            continue
        if missing <= 0:
            block = b"".join(parts)[: int(fields[b"content-length"])]
            yield fields, block
            missing = 0
    if missing:
        raise ValueError(f"{file}: the last record is cut off")


def _page(rid: bytes) -> int | None:
    parts = rid.strip(b"<>").split(b":")
    return int(parts[3]) if parts[:3] == [b"urn", b"cairn", b"page"] else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Read archives back, a row a response or revisit record.

    verified: all segments are there in order, their length is the total, and the
    payload has the digest of the header. payload is null unless asked for; a
    revisit has its own digest and length, but no payload.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((n, v) for b in batches for n, v in zip(column(b, "file"), column(b, "value"), strict=True))
        out: list[tuple] = []
        held = 0
        for f, block in blocks(pieces):
            kind = f.get(b"warc-type", b"").decode()
            if kind not in ("response", "revisit", "continuation"):
                continue
            number, total = int(f.get(b"warc-segment-number", b"1")), f.get(b"warc-segment-total-length")
            whole = number == 1 and b"warc-segment-number" not in f
            to = f.get(b"warc-refers-to")
            digest = f.get(b"warc-payload-digest", b"").decode().rpartition(":")[2]
            row = [f.get(b"warc-segment-origin-id", f[b"warc-record-id"]).decode(), number, int(total) if total else None, kind, f.get(b"warc-target-uri", b"").decode() or None, _page(to) if to else None, digest]
            row += [*_payload(kind, block, digest, payloads), None] if whole else [None, None, None, None, block]
            out.append(tuple(row))
            held += len(block)
            if len(out) >= 2000 or held > 8 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    parts = raw.mapInArrow(cut, CUT)
    # rows of whole records are small; only segments carry their block into the shuffle
    order = F.array_sort(F.collect_list(F.struct("number", "total", "kind", "url", "refers", "digest", "size", "sha", "ok", "payload", "block")))
    records_ = parts.groupBy("origin").agg(order.alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, ps in zip(column(b, "origin"), column(b, "parts"), strict=True):
                out += [_assemble(origin, g, payloads) for g in _repeats(ps)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 8, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()], strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return records_.mapInArrow(join, RESULT)


CUT = "origin string, number int, total long, kind string, url string, refers long, digest string, size long, sha string, ok boolean, payload binary, block binary"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [c.split()[0] for c in CUT.split(", ")])


def _repeats(parts: list[dict]) -> Iterator[list[dict]]:
    """Rows that repeat a page give several records of one origin: part them into whole ones."""
    if len(parts) == 1 or len({p["number"] for p in parts}) == len(parts):
        yield parts
        return
    by: dict[int, list[dict]] = {}
    for p in parts:
        by.setdefault(p["number"], []).append(p)
    for i in range(max(map(len, by.values()))):
        yield [ps[min(i, len(ps) - 1)] for _, ps in sorted(by.items())]


def _payload(kind: str, block: bytes, digest: str, keep: bool) -> tuple[int, str, bool, bytes | None]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return int(fields.get(b"content-length", b"0")), digest, bool(digest), None
    try:
        body = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        return len(body), b32sha1(body), False, body if keep else None
    sha = b32sha1(body)
    return len(body), sha, sha == digest, body if keep else None


def _assemble(origin: str, parts: list[dict], keep: bool) -> tuple:
    first, last = parts[0], parts[-1]
    if first["block"] is None:
        size, sha, ok, payload = first["size"], first["sha"], first["ok"], first["payload"]
    else:
        block = b"".join(p["block"] for p in parts)
        in_order = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] == len(block)
        size, sha, ok, payload = _payload(first["kind"], block, first["digest"], keep)
        ok = ok and in_order
    return _page(origin.encode()), first["url"], first["kind"], first["refers"], size, sha, payload, ok


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back. The archives stay there.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    verified. A null html has an empty payload; rows without a page_id, which no
    record identifier can name, are left out; an empty table gives an empty one.
    Rows that repeat a page_id come back once each. Payloads of any length are
    written whole. Other columns than page_id, url and html are left out, so that
    their names cannot clash.
    """
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified")
