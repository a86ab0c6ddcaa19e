import base64
import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from spoken.llm.warc import decode_payload, derivatives, page_responses, parse_records, read_warc, records_of, write_warc


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(body, http="Content-Type: text/html", status="200 OK", warc="", wrong=False):
    block = f"HTTP/1.1 {status}\r\n{http}\r\n\r\n".encode() + body
    digest = sha1(b"other" if wrong else body)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Target-URI: http://a/é\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{warc}WARC-Payload-Digest: {digest}\r\nWARC-Block-Digest: {sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def chunked(body):
    return b"5;x=1\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}\r\n".encode() + body[5:] + b"\r\n0\r\n\r\n"


def table(spark, records):
    return spark.createDataFrame([(i, bytearray(r) if r is not None else None, "own", 1) for i, r in enumerate(records)], "n long, record binary, record_id string, block long")


def test_headers_and_digests(spark):
    rows = [
        response(b"<p>a", "X-Own: one\r\nX-Own: two\r\nX-Folded: a\r\n  b\r\nContent-Type: text/html", warc="WARC-IP-Address: 1.2.3.4\r\n"),
        response(b"<p>a", wrong=True),
        b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n",
        None,
        b"",
        b"WARC/1.1\r\nWARC-Type: response",
    ]
    got = {r["row_"]["n"]: r for r in parse_records(table(spark, rows)).collect()}
    first = got[0]
    assert [tuple(h) for h in first["http_headers"]] == [("X-Own", "one"), ("X-Own", "two"), ("X-Folded", "a b"), ("Content-Type", "text/html")]
    assert (first["record_type"], first["record_id"], first["target_uri"], first["http_status"]) == ("response", "<urn:x:1>", "http://a/é", 200)
    assert bytes(first["payload"]) == b"<p>a" and first["block_ok"] and first["payload_ok"] and got[1]["payload_ok"] is False and got[1]["block_ok"]
    assert ("WARC-IP-Address", "1.2.3.4") in [tuple(h) for h in first["headers"]]
    assert got[2]["record_type"] == "request" and bytes(got[2]["payload"]) == b"GET" and 3 not in got and got[4]["record_type"] is None and got[5]["record_type"] == "response"

    out = {(r["row_"]["n"], r["record_type"]): r for r in derivatives(table(spark, rows)).collect()}
    assert {n for n, _ in out} == {0, 1, 5} and len(out) == 6
    meta, text = out[0, "metadata"], out[0, "conversion"]
    for line in ("http-header: X-Own: one", "http-header: X-Own: two", "warc-header: WARC-IP-Address: 1.2.3.4", f"warc-header: WARC-Payload-Digest: {sha1(b'<p>a')}", "http-status: 200"):
        assert line + "\r\n" in meta["block"]
    assert text["block"] == "a" and text["refers_to"] == meta["refers_to"] == "<urn:x:1>" and text["payload_digest"] == sha1(b"<p>a")
    for line in ("WARC-Refers-To: <urn:x:1>", "WARC-Refers-To-Target-URI: http://a/é", f"WARC-Source-Payload-Digest: {sha1(b'<p>a')}", f"WARC-Block-Digest: {sha1(b'a')}", "Content-Length: 1"):
        assert line + "\r\n" in text["record"]
    back = parse_records(spark.createDataFrame([(r["record"],) for r in out.values()], "record string")).collect()
    assert all(r["block_ok"] for r in back) and {r["record_type"] for r in back} == {"metadata", "conversion"}


def test_payload_codings(spark):
    body = "<title>T&uuml;r</title><p>café &#8217;&#x27;&rsquo;&trade;&amp;lt; &eacute".encode()
    want = "café ’'’™&lt; é"
    rows = [
        response(body, "Content-Type: text/html; charset=UTF-8"),
        response(body.decode().encode("latin-1"), 'Content-Type: text/html; charset="ISO-8859-1"'),
        response(body.decode().encode("cp1252"), "Content-Type: text/html; charset=windows-1252"),
        response(b"<meta charset=iso-8859-1>" + body.decode().encode("latin-1")),
        response(gzip.compress(body), "Content-Encoding: gzip"),
        response(zlib.compress(body), "Content-Encoding: deflate"),
        response(chunked(gzip.compress(body)), "Transfer-Encoding: chunked\r\nContent-Encoding: gzip"),
        response(chunked(body), "Transfer-Encoding: chunked"),
    ]
    out = [r for r in derivatives(table(spark, rows)).collect()]
    assert [r["block"].removeprefix("Tür\n") for r in out if r["record_type"] == "conversion"] == [want] * len(rows)
    assert all("title: Tür\r\n" in r["block"] for r in out if r["record_type"] == "metadata") and all(r["payload_ok"] for r in out)
    assert decode_payload(b"\xff\x00a", None, "gzip", "no-such") == "�\x00a"


def test_files_round_trip(spark, tmp_path):
    rows = [response(b"<p>first\r\n\r\nline"), response(b"<p>second"), b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows))
    (tmp_path / "b.warc").write_bytes(b"".join(rows)[:-30])
    assert list(records_of(b"".join(rows))) == rows
    read = read_warc(spark, str(tmp_path), "*.warc*")
    assert read.count() == 6 and {bytes(r["record"]) for r in read.filter("path like '%gz'").collect()} == set(rows)
    derived = derivatives(read)
    write_warc(derived, str(tmp_path / "out"))
    again = parse_records(read_warc(spark, str(tmp_path / "out"))).collect()
    assert len(again) == 8 and all(r["block_ok"] for r in again) and {r["record_type"] for r in again} == {"metadata", "conversion"}


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=en><head><title>T</title></head><p>a&amp;b<p>c", "x"), (1, "http://a/", "<html lang=en><head><title>T</title></head><p>a&amp;b<p>c", "y"), (2, None, None, "z"), (None, "u", "<p>" + "word " * 300_000, None)], "page_id long, url string, html string, record string")
    rows = derivatives(page_responses(pages)).collect()
    assert len(rows) == 8 and all(r["block_ok"] and r["payload_ok"] for r in rows)
    text = {r["row_"]["page_id"]: r for r in rows if r["record_type"] == "conversion"}
    assert text[1]["block"] == "a&b\nc" and text[2]["block"] == "" and text[None]["content_length"] == 300_000 * 5 - 1
    assert derivatives(page_responses(pages.limit(0))).count() == 0
    meta = next(r for r in rows if r["record_type"] == "metadata" and r["row_"]["page_id"] == 1)
    assert "title: T\r\nlanguage: en\r\n" in meta["block"]
    assert derivatives(pages.select(F.lit(None).cast("binary").alias("record"))).count() == 0
