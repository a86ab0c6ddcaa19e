"""WARC derivatives: each response record becomes a metadata and a plain-text conversion record that refer to it.

Records are read from WARC files (gzip or not), parsed byte for byte, checked against their digests, converted and written again. Headers
are kept all and in order; digests are SHA-1 in Base32 as the format's tools write them, and identifiers are made from what they name, so
that reruns agree. Records pass through Python in Arrow batches, one after another: that is what bytes, codings and character references
ask for, and it costs a fraction of the same patterns as Column expressions. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|head\b.*?</head\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
DATE = "2024-01-01T00:00:00Z"
LINKS = ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")
BATCH = 4 << 20  # bytes of records that go out at once
_HIDDEN, _BREAKS, _TAGS = (re.compile(x, re.A) for x in (HIDDEN, BREAKS, TAGS))
_TITLE, _LANG = re.compile(r"(?is)<title[^>]*>(.*?)</title"), re.compile(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", re.A)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([0-9A-Za-z_.:-]+)", re.I | re.A)
_META = re.compile(rb"<meta\b[^>]*charset\s*=\s*[\"']?([0-9A-Za-z_.:-]+)", re.I)
_BLANK = re.compile(r"[\t\n\x0B\f\r ]+")
_FOLDED = re.compile(rb"\r\n[ \t]+")
Headers = list[tuple[str, str]]


# --- values ------------------------------------------------------------------------------------------------------------------------------
def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_agrees(stated: str | None, data: bytes) -> bool | None:
    """Whether a digest header fits the bytes: SHA-1 in Base32 or hexadecimal, MD5, SHA-256; None for none and for other methods."""
    method, _, value = (stated or "").partition(":")
    method, value = method.strip().lower(), value.strip()
    if method not in ("sha1", "md5", "sha256"):
        return None
    own = hashlib.new(method, data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def record_id(*parts: str | None) -> str:
    """A urn:uuid made from the digest of what it names (version and variant bits as for name-based identifiers)."""
    h = hashlib.sha1("\n".join(p for p in parts if p is not None).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def plain_text(markup: str) -> str:
    """Text of markup: hidden elements and tags go, block tags break lines, references are decoded, white space is collapsed."""
    out = _BLANK.sub(" ", _HIDDEN.sub("", markup))
    out = html.unescape(_TAGS.sub("", _BREAKS.sub("\n", out)))
    return re.sub(" ?\n[ \n]*", "\n", re.sub(" {2,}", " ", out)).strip(" \n")


# --- records -----------------------------------------------------------------------------------------------------------------------------
def header_list(lines: bytes) -> Headers:
    """(name, value) of header lines, all in order; folded lines are joined by a blank."""
    pairs = (x.partition(b":") for x in _FOLDED.sub(b" ", lines).split(b"\r\n") if b":" in x)
    return [(n.decode("utf-8", "replace").strip(" "), v.decode("utf-8", "replace").strip(" ")) for n, _, v in pairs]


def header(headers: Headers, name: str) -> str | None:
    """The first value of a header, its name in any case."""
    return next((v for n, v in headers if n.lower() == name), None)


def _split_chunks(data: bytes) -> bytes:
    """The body of a chunked transfer; what does not parse stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return data if not out else b"".join(out)
        if size == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decode_payload(data: bytes, transfer: str | None, encoding: str | None, charset: str | None) -> str:
    """Text of a payload: chunks joined, gzip or deflate undone, decoded; what cannot be decoded is replaced, not lost."""
    if "chunked" in (transfer or "").lower():
        data = _split_chunks(data)
    for kind in reversed([x.strip() for x in (encoding or "").lower().split(",")]):
        try:
            if kind in ("gzip", "x-gzip"):
                data = gzip.decompress(data)
            elif kind == "deflate":
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data = zlib.decompress(data, -15)
        except (OSError, EOFError, zlib.error):
            break
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


@dataclass
class Record:
    """A parsed record. ``payload`` is what follows the HTTP header, the whole block if there is none."""

    headers: Headers
    http: Headers
    status: int | None
    block: bytes
    payload: bytes

    @property
    def kind(self) -> str:
        return (header(self.headers, "warc-type") or "").lower()

    def text(self) -> str:
        """The payload decoded: by the charset of its header, else that of its first meta element, else as UTF-8."""
        stated = _CHARSET.search(header(self.http, "content-type") or "")
        meta = None if stated else _META.search(self.payload, 0, 1024)
        charset = stated[1] if stated else meta[1].decode() if meta else None
        return decode_payload(self.payload, header(self.http, "transfer-encoding"), header(self.http, "content-encoding"), charset)


def parse(data: bytes) -> Record:
    """A record from its bytes. The block is as long as Content-Length says, or without it, up to the empty lines that end a record. A
    record without an empty line has headers only."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = header_list(head)
    length = header(headers, "content-length")
    block = rest[: int(length)] if length is not None and length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    if not block.startswith(b"HTTP/"):
        return Record(headers, [], None, block, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    status = http.partition(b"\r\n")[0].split(b" ")
    return Record(headers, header_list(http), int(status[1]) if len(status) > 1 and status[1].isdigit() else None, block, payload)


def serialize(kind: str, record: str, uri: str | None, date: str | None, content_type: str, block: bytes, more: Headers = (), digest: str | None = None) -> bytes:
    """A record in WARC/1.1 form. Headers whose value is None are left out. ``digest``: of the block, if it is known."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Target-URI", uri), ("WARC-Date", date), *more, ("WARC-Block-Digest", digest or base32_sha1(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return ("WARC/1.1" + CRLF + _lines(lines) + CRLF).encode() + block + b"\r\n\r\n"


def _lines(pairs) -> str:
    return "".join(f"{n}: {v}{CRLF}" for n, v in pairs if v is not None)


def response_record(record: str, uri: str | None, date: str, payload: bytes) -> bytes:
    """A response record, for tables that hold bare pages."""
    http = ("HTTP/1.1 200 OK" + CRLF + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + CRLF).encode()
    return serialize("response", record, uri, date, "application/http; msgtype=response", http + payload, [("WARC-Payload-Digest", base32_sha1(payload))])


def derive(r: Record) -> list[tuple]:
    """The metadata and the conversion record of a response: (kind, id, refers to, target, date, payload digest, block digest, length,
    block, record)."""
    uri, date = header(r.headers, "warc-target-uri"), header(r.headers, "warc-date")
    source = header(r.headers, "warc-record-id") or record_id("response", uri, hashlib.sha1(r.payload).hexdigest())
    digest = header(r.headers, "warc-payload-digest") or base32_sha1(r.payload)
    markup = r.text()
    title, language = _TITLE.search(markup), _LANG.search(markup)
    facts = [("payload-digest", digest), ("payload-length", str(len(r.payload))), ("title", (_BLANK.sub(" ", html.unescape(title[1])) or None) if title else None), ("language", language and language[1]), ("http-status", r.status)]
    facts += [("http-header", f"{n}: {v}") for n, v in r.http] + [("warc-header", f"{n}: {v}") for n, v in r.headers]
    more = [*zip(LINKS, (source, uri, date)), ("WARC-Source-Payload-Digest", digest), ("WARC-Source-Block-Digest", header(r.headers, "warc-block-digest")), ("WARC-Source-Content-Type", header(r.http, "content-type"))]
    out = []
    for kind, content_type, text in (("metadata", "application/warc-fields", _lines(facts)), ("conversion", "text/plain; charset=utf-8", plain_text(markup))):
        block = text.encode("utf-8", "replace")
        own, sum_ = record_id(kind, source, hashlib.sha1(block).hexdigest()), base32_sha1(block)
        out.append((kind, own, source, uri, date, digest, sum_, len(block), block.decode(), serialize(kind, own, uri, date, content_type, block, more, sum_).decode()))
    return out


def _through(rows: DataFrame, column: str, each, fields: list[T_.StructField]) -> DataFrame:
    """(row_, fields) of what ``each`` gives for every record; ``row_`` has the other columns. Output goes out in batches of bounded size."""
    rest = [c for c in rows.columns if c != column]
    own = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    source = rows.select(own.alias("row_"), F.col(f"`{column}`").cast("binary").alias("bytes_"))
    schema = T_.StructType([source.schema["row_"], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            types = types or [to_arrow(f.dataType) for f in fields]
            at, found, size = [], [], 0
            for i, data in enumerate(batch.column(1)):
                if not data.is_valid:
                    continue
                raw = data.as_py()
                got = each(raw)
                at += [i] * len(got)
                found += got
                size += len(raw) * (len(got) + 1)
                if size > BATCH:
                    yield _batch(batch, at, found, names, types)
                    at, found, size = [], [], 0
            if found:
                yield _batch(batch, at, found, names, types)

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    return source.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, at: list[int], found: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=["row_", *names])


_PAIRS = T_.ArrayType(T_.StructType([T_.StructField("name", T_.StringType()), T_.StructField("value", T_.StringType())]))


def _fields(**kinds: T_.DataType) -> list[T_.StructField]:
    return [T_.StructField(n, t) for n, t in kinds.items()]


_S, _B, _Y = T_.StringType(), T_.BooleanType(), T_.BinaryType()


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """(row_, record_type, record_id, target_uri, date, headers, http_status, http_headers, payload, block_ok, payload_ok) of WARC records
    in a binary or text column.

    ``row_`` has the other columns of ``records``. ``headers`` and ``http_headers`` are array<struct<name, value>>, all in order, folded
    lines joined. ``payload`` is bytes. ``block_ok`` and ``payload_ok`` tell whether the digest headers fit (null: none there). Null
    records give no row; one without an empty line has headers only.
    """

    def each(data: bytes) -> list[tuple]:
        r = parse(data)
        h = r.headers
        pairs = lambda x: [{"name": n, "value": v} for n, v in x]
        return [(r.kind or None, header(h, "warc-record-id"), header(h, "warc-target-uri"), header(h, "warc-date"), pairs(h), r.status, pairs(r.http), r.payload, digest_agrees(header(h, "warc-block-digest"), r.block), digest_agrees(header(h, "warc-payload-digest"), r.payload))]

    return _through(records, column, each, _fields(record_type=_S, record_id=_S, target_uri=_S, date=_S, headers=_PAIRS, http_status=T_.IntegerType(), http_headers=_PAIRS, payload=_Y, block_ok=_B, payload_ok=_B))


def derivatives(records: DataFrame, column: str = "record") -> DataFrame:
    """(row_, record_type, record_id, refers_to, target_uri, date, payload_digest, block_digest, content_length, block, record, block_ok,
    payload_ok): two rows for each response record in a binary or text column.

    The metadata record holds length and digest of the payload, title, language, and every header of its source, HTTP and WARC, in
    order; the conversion record the plain text of the payload, decoded and with all character references resolved. Both carry
    refers-to identifier, target and date of their source and its digests, as it stated them; ``block_ok`` and ``payload_ok`` tell
    whether these fit. Where it stated no payload digest, it is computed. Records of other types, and null records, give no rows. Repeated
    records give repeated rows with equal identifiers; an empty table an empty result. ``row_`` has the other columns of ``records``, so
    none can clash. A record without identifier gets one from its target and payload. Payloads are converted whole, however long; a
    record is held in one piece.
    """

    def each(data: bytes) -> list[tuple]:
        r = parse(data)
        if r.kind != "response":
            return []
        fits = digest_agrees(header(r.headers, "warc-block-digest"), r.block), digest_agrees(header(r.headers, "warc-payload-digest"), r.payload)
        return [(*row, *fits) for row in derive(r)]

    return _through(records, column, each, _fields(record_type=_S, record_id=_S, refers_to=_S, target_uri=_S, date=_S, payload_digest=_S, block_digest=_S, content_length=T_.LongType(), block=_S, record=_S, block_ok=_B, payload_ok=_B))


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record): a response record for each row of ``pages(page_id, url, html)``, its identifier made from page_id and url. Null
    html is an empty payload, a null url no target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = zip(*(c.to_pylist() for c in part.columns))
                records = [response_record(record_id("response", None if i is None else str(i), url), url, date, (page or "").encode("utf-8", "replace")) for i, url, page in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(records, pa.binary())], names=["page_id", "record"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, record binary")


# --- files -------------------------------------------------------------------------------------------------------------------------------
def records_of(content: bytes) -> Iterator[bytes]:
    """The records of a WARC file, gzip or not, one after another: a record's length is in its header."""
    file = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while True:
        head = []
        while not head or head[-1] not in (b"\r\n", b"\n"):
            line = file.readline()
            if not line:
                if head:
                    yield b"".join(head)
                return
            if head or line.strip():
                head.append(line)
        size = next((int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:")), 0)
        yield b"".join(head) + file.read(size) + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, position, record) of the WARC files under a path whose names fit ``glob``. A task holds one file; a file that breaks off gives the records before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                held, at = [], 0
                try:
                    for record in records_of(bytes(content)):
                        held.append((name, at, record))
                        at += 1
                        if sum(len(r[2]) for r in held[-64:]) > 1 << 22 or len(held) >= 500:
                            yield pd.DataFrame(held, columns=["path", "position", "record"])
                            held = []
                except (OSError, EOFError, zlib.error, ValueError):
                    pass
                if held:
                    yield pd.DataFrame(held, columns=["path", "position", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, position long, record binary")


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """Writes the text column ``record`` as WARC files, a file for each partition. A line of the file format is a record here: its
    separator is the empty lines that end it."""
    ended = records.select(F.regexp_replace("record", r"\r\n\r\n\z", "").alias("value"))
    ended.write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip" if compress else "none").text(path)
