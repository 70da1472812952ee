"""Legacy ARC archives: writing, parsing by version-specific header lines, conversion to WARC, reading back.

An ARC file begins with a version block whose body names the version and the fields of the header
lines that follow. Version 1 lines hold URL, IP, date, type and length; version 2 lines hold result
code, checksum, location, offset and file name as well. A record's body is as long as the last field
declares, whatever bytes it holds. The converter gives each record a WARC type, a record id that
depends on the record alone, an ISO timestamp and SHA-1 digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import cut, shared_dir

#: Fixed values of the two ARC formats.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = b"\r\n"
#: A file is closed when it has so many bytes; a larger record gets a file of its own.
FILE_BYTES = 16 << 20
#: At most so many digests of repeated payloads are broadcast; beyond, the join is shuffled.
BROADCAST_DIGESTS = 50_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, date: str, kind: str, length: int, offset: int = 0, name: str = "pages.arc") -> bytes:
    own = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
    return (" ".join(own[f] for f in FIELDS[version]) + "\n").encode()


def arc_begin(version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    body = f"{version} 0 lathe\n{' '.join(FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body), 0, name) + body + b"\n"


def arc_record(version: int, url: str, date: str, page_id: int | None, payload: bytes, offset: int = 0) -> bytes:
    """An HTTP response in an ARC record. The URL is percent-encoded so that it holds no blank; an unknown URL is '-'."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n".encode() if page_id is not None else b"") + b"\r\n"
    body = http + payload
    return arc_header(version, quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "-", date, "text/html", len(body), offset) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict[str, object]]:
    """Records of an ARC file after its version block: url, ip, date, kind, body. Raises ValueError on a broken file."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the separator that follows each body
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes and has {len(body)}")
        at = end + 1 + length
        if parts[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = body.split(b"\n")[1].decode().split(" ")
            continue
        if fields is None:
            raise ValueError("ARC file without a version block")
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line with {len(parts)} fields instead of {len(fields)}")
        own = dict(zip(fields, parts, strict=True))
        yield {"url": "" if own["URL"] == "-" else own["URL"], "ip": own["IP-address"], "date": own["Archive-date"], "kind": own["Content-type"], "body": body}


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, and payload; without a header block all is payload."""
    if body.startswith(b"HTTP/") and (at := body.find(b"\r\n\r\n")) >= 0:
        return body[: at + 4], body[at + 4 :]
    return b"", body


def record_id(kind: str, what: str, digest: str) -> str:
    """The same for the same record whenever it is made, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{what}|{digest}')}>"


def warc_record(record: dict, refers_to: int | None = None, page_id: int | None = None) -> bytes:
    """The WARC 1.1 record of a parsed ARC record; refers_to, a page of the same payload, makes it a revisit without payload.

    The identifier of a page's record comes from page_id and payload, else from url, date and payload.
    """
    http, payload = split_http(record["body"])
    d = str(record["date"]).ljust(14, "0")
    digest = sha1_base32(payload)
    block = http if refers_to is not None else record["body"]
    kind = "revisit" if refers_to is not None else "response"
    ident = record_id(kind, f"{record['url']}|{d}" if page_id is None else f"page {page_id}", digest)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {record['url']}", f"WARC-IP-Address: {record['ip']}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id('response', f'page {refers_to}', digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Truncated: length"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(CRLF * 2, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, length = end + 4, int(head["content-length"])
        if data[start + length : start + length + 4] != CRLF * 2:
            raise ValueError(f"WARC record at byte {at} does not end where it declares")
        yield head, data[start : start + length]
        at = start + length + 4


def _page_id(http: bytes) -> int | None:
    return next((int(x[10:]) for x in http.split(CRLF) if x.startswith(b"X-Page-Id:")), None)


def _to_arc(batches: Iterable[pa.RecordBatch], version: int | None):
    """Rows of page_id, url, html, refers_to -> rows of ARC file bytes and the revisits among its records."""
    def close():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([refs], pa.list_(pa.int64()))], ["arc", "refers_to"])

    parts, refs, size, files = [], [], 0, 0
    for batch in batches:
        for page, url, html, ref in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            v = version or 1 + files % 2
            if not parts:
                parts, refs, size = [begin := arc_begin(v)], [], len(begin)
            parts.append(arc_record(v, url or "", "20240101000000", page, html or b"", size))
            refs.append(ref)
            size += len(parts[-1])
            if size >= FILE_BYTES:
                yield close()
                parts, files = [], files + 1
    if parts:
        yield close()


def _to_warc(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        for arc, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = [warc_record(r, ref, _page_id(split_http(r["body"])[0])) for r, ref in zip(parse_arc(arc), refs, strict=True)]
            # Spark's text writer ends each row with the line feed that a record ends with.
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["warc"])


def _from_warc(batches: Iterable[pa.RecordBatch]):
    import gzip

    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for head, block in parse_warc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                if head["warc-type"] == "response":
                    payload = split_http(block)[1]
                    if len(payload) != int(head["x-payload-length"]) or f"sha1:{sha1_base32(payload)}" != head["warc-payload-digest"]:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                page, ref = head.get("x-page-id"), head.get("x-refers-to-page")
                rows.append((page and int(page), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], ref and int(ref), unquote(head["warc-target-uri"]), head["warc-date"], head["warc-record-id"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in _SCHEMA.split(", ")]


def write_archives(pages: DataFrame, least_bytes: int = 0, version: int | None = None) -> str:
    """Write pages (page_id, url, html) through ARC files to gzipped WARC files in the shared folder; returns their folder.

    Of records with equal payloads of at least least_bytes bytes those with the smallest page_id are
    responses and the others revisit it; rows that repeat that page_id are responses too, and so are
    rows without a page_id. A null html is an empty payload, a null url an empty one. version: of
    the ARC files, by turns if None. Other columns are not read; an empty table gives an empty folder.
    A file is one gzip stream: it has to be read from its beginning.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    first = cut(own.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    known = own.join(first, "digest", "left")
    arcs = known.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")).mapInArrow(lambda x: _to_arc(x, version), "arc binary, refers_to array<long>")
    path = f"{shared_dir(spark)}/lathe/warc-{uuid.uuid4().hex}"
    convert_archives(arcs).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def convert_archives(arcs: DataFrame) -> DataFrame:
    """ARC files (arc binary, refers_to array: the page each record revisits or null) -> WARC files as text rows."""
    return arcs.mapInArrow(_to_warc, "warc binary").select(F.col("warc").cast("string").alias("value"))


def read_archives(spark, path: str) -> DataFrame:
    """A row per WARC record below path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, record_id."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_from_warc, _SCHEMA)
