"""WARC records and their derivatives.

A response record gives two linked records. The metadata record
(application/json) tells the source's WARC and HTTP headers, its length, title,
links and digests; the conversion record (text/plain) holds the text of the
page. Both name the response in WARC-Refers-To and keep its WARC-Target-URI,
WARC-Date and WARC-Payload-Digest (as WARC-Source-Payload-Digest); their own
digests cover their own blocks. Digests are sha1 in base 32, computed where the
source states none. Record ids are uuids made from the source's id and the kind,
so a retried task writes the same records.

Records other than responses are passed by; a response without a header end is
taken as a bare payload; null and unreadable records give a row with nulls and
`error`. Repeated header fields are all kept, in order, as [name, value] pairs.
Digests are over the payload as it lies. For the text, transfer and content
encodings (chunked; gzip, deflate, zstd) are undone first. A payload that isn't
text by its Content-Type, or can't be decoded, still gives its metadata record,
which says so, and in place of the conversion record a row with `error`. A null or empty body
gives empty text. HTML is read as text: comments, scripts, styles and tags go,
block tags end lines, entities are resolved; other text stays, but for line ends.
Bodies of any length are read whole. Repeated rows give repeated records. Other
columns are not read, whatever their names.

Files are read as streams, record by record, so their length doesn't matter, and
written as text files of records by Spark's own writer, whose commit survives
lost executors.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import slices

CRLF = b"\r\n"
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
BLANKS, LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


Fields = list[tuple[str, str]]


def record(headers: Fields, block: bytes) -> bytes:
    """A WARC/1.0 record; Content-Length is added."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + 2 * CRLF + block + 2 * CRLF


def parse_fields(lines: list[bytes]) -> Fields:
    """Header fields in order; names as they are, continued lines joined. Lines that are neither are passed by."""
    out: Fields = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = out[-1][0], out[-1][1] + " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out.append((name.strip(), value.strip()))
    return out


def field(fields: Fields, name: str) -> str | None:
    """The first value of a field."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def parse_record(data: bytes) -> tuple[Fields, bytes]:
    """Headers and block of one record."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    head, end, rest = data.partition(2 * CRLF)
    headers = parse_fields(head.split(CRLF)[1:])
    length = field(headers, "Content-Length")
    if not end or length is None or not length.isdigit() or int(length) > len(rest):
        raise ValueError("the record is cut short")
    return headers, rest[: int(length)]


class _Plain(io.RawIOBase):
    """The plain bytes of a stream of gzip members, or of a stream that isn't compressed."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.left, self.member = source, source.read(1 << 16), None
        self.packed = self.left[:2] == b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data, self.left = self.left or self.source.read(1 << 16), b""
            if not self.packed or not data:
                out, self.left = data[: len(buffer)], data[len(buffer) :]
            else:
                if self.member is None:
                    data = data.lstrip(b"\0")  # padding between members
                    self.member = zlib.decompressobj(31)
                out = self.member.decompress(data, len(buffer))
                self.left = self.member.unconsumed_tail
                if self.member.eof:
                    self.left, self.member = self.member.unused_data, None
            if out or not data:
                buffer[: len(out)] = out
                return len(out)


def read_records(source: BinaryIO) -> Iterator[bytes]:
    """Records of a WARC file, gzip members or plain, one at a time. What follows a record that has no length is given as one."""
    stream = io.BufferedReader(_Plain(source), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
            head.append(line)
        length = field(parse_fields([x.rstrip(b"\r\n") for x in head[1:]]), "Content-Length")
        if length is None or not length.isdigit():
            yield b"".join(head) + line + stream.read()
            return
        yield b"".join(x.rstrip(b"\r\n") + CRLF for x in head) + CRLF + stream.read(int(length)) + 2 * CRLF


def page_text(markup: str) -> str:
    text = TAG.sub("", BLOCK.sub("\n", HIDDEN.sub(" ", markup)))
    text = html.unescape(text) if "&" in text else text
    return LINES.sub("\n", BLANKS.sub(" ", text)).strip(" \n")


def split_http(block: bytes) -> tuple[str | None, Fields, bytes]:
    """Status line, fields and payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, end, payload = block.partition(2 * CRLF)
    if not end:
        return None, [], block
    lines = head.split(CRLF)
    return lines[0].decode("utf-8", "replace"), parse_fields(lines[1:]), payload


def _chunks(data: bytes) -> bytes:
    """The body of a chunked transfer; ValueError if it isn't one."""
    out, at = [], 0
    while True:
        line, end, _ = data[at : at + 4096].partition(CRLF)
        size = line.split(b";")[0].strip()
        if not end or not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("the chunks of the payload can't be read")
        n, at = int(size, 16), at + len(line) + 2
        if not n:
            return b"".join(out)
        if at + n > len(data):
            raise ValueError("the last chunk of the payload is cut short")
        out.append(data[at : at + n])
        at += n + 2


def _unpack(data: bytes, coding: str) -> bytes:
    if coding in ("gzip", "x-gzip"):
        out = []
        while data:
            member = zlib.decompressobj(31)
            out.append(member.decompress(data))
            if not member.eof:
                raise zlib.error("cut short")
            data = member.unused_data
        return b"".join(out)
    if coding == "deflate":  # with a zlib header or, as some servers send it, without
        return zlib.decompress(data) if len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 else zlib.decompress(data, -15)
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"content encoding {coding} is not known")


def decoded(http: Fields, payload: bytes) -> bytes:
    """The payload without transfer and content encodings; ValueError where they can't be undone."""
    codings = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip().lower() not in ("", "identity")]
    transfer, content = codings("transfer-encoding"), codings("content-encoding")
    if not payload:
        return payload
    try:
        for coding in reversed(content + transfer):
            payload = _chunks(payload) if coding == "chunked" else _unpack(payload, coding)
    except (zlib.error, zstandard.ZstdError) as e:
        raise ValueError(f"the payload can't be unpacked: {e}") from None
    return payload


#: Content types that are text, and those of them that are markup.
TEXT = re.compile(r"^(text/.*|application/(xhtml\+xml|xml|json|javascript|.*\+xml|.*\+json))$")
MARKUP = re.compile(r"^(text/html|text/xml|application/(xhtml\+xml|xml|.*\+xml))$")


def derive(data: bytes) -> tuple[bytes, bytes | None, str | None] | None:
    """Metadata and conversion record of a response record, and what was wrong if there is no conversion; None for records of other types."""
    headers, block = parse_record(data)
    if (field(headers, "WARC-Type") or "").lower() != "response":
        return None
    source = field(headers, "WARC-Record-ID") or "<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(data).hexdigest())) + ">"
    status, http, payload = split_http(block)
    kind = (field(http, "Content-Type") or "text/html").split(";")[0].strip().lower()
    wrong, markup = None, ""
    try:
        if not TEXT.match(kind):
            raise ValueError(f"{kind} is not text")
        body = decoded(http, payload)
        found = CHARSET.search((field(http, "Content-Type") or "").encode()) or CHARSET.search(body[:1024])
        try:
            markup = body.decode(found[1].decode() if found else "utf-8", "replace")
        except LookupError:
            markup = body.decode("utf-8", "replace")
    except ValueError as e:
        wrong = str(e)
    is_markup = bool(MARKUP.match(kind)) and not wrong
    payload_digest = field(headers, "WARC-Payload-Digest") or digest(payload)
    title = TITLE.search(markup) if is_markup else None
    about = {
        "source_headers": headers, "http_status": status, "http_headers": http, "payload_length": len(payload), "payload_digest": payload_digest,
        "block_digest": field(headers, "WARC-Block-Digest") or digest(block), "title": page_text(title[1]) if title else None,
        "links": [html.unescape(next(x for x in m if x)) for m in HREF.findall(markup) if any(m)] if is_markup else [], "error": wrong,
    }
    text = page_text(markup) if is_markup else markup.replace("\r\n", "\n").replace("\r", "\n")
    shared = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if (v := field(headers, k)) is not None]

    def made(kind: str, form: str, body: bytes) -> bytes:
        own = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{source} {kind}"))
        return record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Refers-To", source), *shared, ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(body)), ("Content-Type", form)], body)

    conversion = None if wrong else made("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    return made("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "replace")), conversion, wrong


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> page_id, warc: a response record of each page, as if fetched at `date`. Null urls leave out the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for key, url, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (body or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                target = [] if url is None else [("WARC-Target-URI", re.sub(r"[\r\n]+", "", url))]
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {url}")
                out.append(record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "warc"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, warc binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at a path -> path, record_no, warc. A task reads a file as a stream and holds one record at a time.

    Spark lists the files; their bytes come through pyarrow, so the path must be of a store that it knows (file, hdfs, s3, gs, abfs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = pyarrow.fs.FileSystem.from_uri(name)
                with store.open_input_stream(inner, compression=None) as source:
                    for n, one in enumerate(read_records(source)):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([one], pa.binary())], ["path", "record_no", "warc"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "path string, record_no long, warc binary")


def write_warc(records: DataFrame, path: str, warc_col: str = "warc") -> None:
    """Records as gzipped WARC files of a new directory. They must be valid UTF-8, as the records made here are; others, and nulls, are an error or left out."""
    text = F.col(warc_col).cast("string")
    whole = F.when(F.is_valid_utf8(text) & F.endswith(text, F.lit("\r\n\r\n")), F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(F.raise_error(F.lit("a record isn't UTF-8 or doesn't end in two line ends")))
    # the writer's line end stands for the last one of each record
    records.where(F.col(warc_col).isNotNull()).select(whole.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


DERIVED = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, source_payload_digest string, block_digest string, content_type string, content binary, warc binary, error string"


def derivatives(records: DataFrame, id_col: str = "page_id", warc_col: str = "warc") -> DataFrame:
    """records (id, WARC record) -> the metadata and the conversion record of each response, with their headers and content as columns."""
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "warc"):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    made = derive(data or b"")
                except ValueError as e:
                    rows.append((key, *[None] * 10, str(e)))
                    continue
                if made is None:
                    continue
                for one in filter(None, made[:2]):
                    fields, content = parse_record(one)
                    h = dict(fields)
                    rows.append((key, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h.get("WARC-Date"), h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], h["Content-Type"], content, one, None))
                if made[2]:
                    rows.append((key, "conversion", None, h["WARC-Refers-To"], *[None] * 7, made[2]))
            kinds = [pa.int64(), *[pa.string()] * 8, pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return records.select(F.col(id_col).cast("long").alias("page_id"), F.col(warc_col).cast("binary").alias("warc")).mapInArrow(run, DERIVED)
