"""WARC derivatives: response records to linked metadata and plain-text conversion records.

``captured`` wraps pages as response records (an HTTP message in a WARC/1.1 record);
``derivatives`` parses response records and writes, for each, a metadata record (title,
language, outgoing links and the source's headers as warc-fields) and a conversion record (plain
text).  Both refer to the response by WARC-Refers-To, -Target-URI and -Date; its payload digest
goes along.  Identifiers are name-based UUIDs of what they identify, so a task run anew writes
the same bytes.  Digests are SHA-1 in base 32, as is usual in WARC files.

Pages are read in one pass from tag to tag (``read_page``), so time grows with a page's length
whatever it holds.  WARC files are read in ranges (``read_warc``), a task each.

A null page body is an empty payload, a null URL leaves out the URI headers; equal rows give
equal records; records of other types and broken or cut ones give no derivative (``derivatives``)
but do not stop the job; an unknown or unusable charset is read as UTF-8; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import per_slice
from sparkloom.tables import spread

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sparkloom:warc")
CAPTURED_AT = "2020-01-01T00:00:00Z"
DERIVED = (
    "page_id long, target_uri string, response_id string, response_payload_digest string, "
    "metadata_id string, metadata_refers_to string, metadata_block_digest string, "
    "conversion_id string, conversion_refers_to string, conversion_payload_digest string, "
    "title string, language string, links array<string>, n_links int, n_text_bytes long, text_sha256 string, "
    "source_headers string, metadata_record string, conversion_record string"
)

#: Elements whose content is no text, elements that start a line.
DROPPED = ("script", "style", "template", "noscript", "svg")
LINES = frozenset(
    "address article aside blockquote br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
_OPEN = re.compile(r"<(?:!--|[A-Za-z/!?])")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_END = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in (*DROPPED, "title")}
_LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I | re.A)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.A)
_LONG_REFERENCE = re.compile(r"&#([0-9]{8})[0-9]*")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
RECORD_MARK = "\r\n\r\nWARC/1."


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join([kind, *parts]))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length and the block digest are added."""
    lines = [f"{k}: {_one_line(v)}" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _inflated(data: bytes) -> bytes:
    """The gzip members' content, up to the first broken one."""
    view, at, plain = memoryview(data), 0, []
    while at < len(view):
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(view):
                plain.append(member.decompress(view[at : at + (1 << 16)]))
                at += min(1 << 16, len(view) - at)
        except zlib.error:
            break
        at -= len(member.unused_data)
    return b"".join(plain)


def _lines(fields: list[tuple[str, str]]) -> str:
    return "".join(f"{k}: {_one_line(v or '')}\r\n" for k, v in fields)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a WARC file's bytes, plain or in gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        headers = _headers(data[at:stop])
        at = stop + 4
        if (size := _length(headers)) is not None and at + size <= len(data):
            yield headers, data[at : at + size]
            at += size


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _length(headers: dict[str, str]) -> int | None:
    size = headers.get("content-length", "")
    return int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers in lower case and payload of an HTTP response message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def response(page_id: int | None, url: str | None, body: bytes, date: str = CAPTURED_AT) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    mark = digest(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", mark)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    return record([*headers, ("WARC-Payload-Digest", mark), ("Content-Type", "application/http; msgtype=response")], head + body)


def unescaped(text: str) -> str:
    """Character references undone; a number too long to be read stands for no character."""
    return html.unescape(_LONG_REFERENCE.sub(r"&#\1", text) if "&#" in text else text)


@dataclass
class Page:
    title: str | None
    language: str | None
    links: list[str]
    text: str


def read_page(source: str) -> Page:
    """Title, language, links and text of a page, in one pass over its tags.

    A tag reaches from its name to the next >; where no > follows, the rest is text.  Comments and
    DROPPED elements are no text (to the page's end where nothing closes them), neither is the head,
    which <body> ends too.  The first title comes first in the text.
    """
    title, language, links, out = None, None, {}, []
    at, head, untitled = 0, False, False
    while tag := _OPEN.search(source, at):
        begin = tag.start()
        if not head:
            out.append(source[at:begin])
        stop = source.find("-->", begin + 4) + 2 if tag[0] == "<!--" else source.find(">", begin)
        if tag[0] == "<!--":
            out.append(" ")
            if stop < 2:
                at = len(source)
                break
            at = stop + 1
            continue
        if stop < 0:
            at = begin
            break
        at = stop + 1
        name = named[1].lower() if (named := _NAME.match(source, begin)) else ""
        if source[begin + 1] == "/":
            head = head and name != "head"
        elif name in DROPPED and not source.endswith("/>", begin, at):
            out.append(" ")
            at = end.end() if (end := _END[name].search(source, at)) else len(source)
        elif name == "title" and title is None and not untitled:
            if end := _END[name].search(source, at):
                title, at = source[at : end.start()], end.end()
            untitled = end is None
        elif name == "html" and language is None:
            language = found[1].lower() if (found := _LANG.search(source, begin, at)) else None
        elif name == "a" and (found := _HREF.search(source, begin, at)):
            links[unescaped(next((x for x in found.groups() if x is not None), "")).strip()] = None
        elif name in ("head", "body"):
            head = name == "head"
        if name in LINES:
            out.append("\n")
    if not head:
        out.append(source[at:])
    links.pop("", None)
    lines = [*([title] if title else []), *"".join(out).split("\n")]
    text = "\n".join(x for x in (_BLANK.sub(" ", unescaped(line)).strip() for line in lines) if x)
    return Page(None if title is None else _one_line(unescaped(title)), language, list(links), text)


def decoded(payload: bytes, content_type: str) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w-]+)", content_type, re.I | re.A)
    if found and found[1].lower() not in ("utf-8", "utf8"):
        try:
            return payload.decode(found[1], "replace").encode("utf-8", "replace").decode()
        except (LookupError, ValueError):
            pass
    return payload.decode("utf-8", "replace")


def derive(headers: dict[str, str], block: bytes) -> dict | None:
    """Metadata and conversion records of one response record, and what the query reports of them."""
    if headers.get("warc-type") != "response" or "warc-record-id" not in headers:
        return None
    status, http, payload = http_parts(block)
    page = read_page(decoded(payload, http.get("content-type", "")))
    origin, uri, date = headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-date", "")
    mark = digest(payload)
    text, title, lang, links = page.text.encode(), page.title, page.language, page.links
    link = [("WARC-Refers-To", origin), *([("WARC-Refers-To-Target-URI", uri), ("WARC-Target-URI", uri)] if uri else []), *([("WARC-Refers-To-Date", date), ("WARC-Date", date)] if date else [])]
    headers_of_source = [("http-status", status), *((f"http-{k}", v) for k, v in http.items())]
    fields = [*headers_of_source, ("source-payload-digest", mark), ("source-payload-length", str(len(payload)))]
    fields += [("title", title)] * (title is not None) + [("languages", lang)] * (lang is not None) + [("outlink", x) for x in links]
    about = _lines(fields).encode()
    meta_id, text_id = record_id("metadata", origin, digest(about)), record_id("conversion", origin, digest(text))
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *link, ("Content-Type", "application/warc-fields")], about)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *link, ("WARC-Payload-Digest", digest(text)), ("WARC-Source-Payload-Digest", mark), ("Content-Type", "text/plain; charset=utf-8")], text)
    return {"target_uri": uri, "response_id": origin, "payload_digest": mark, "metadata": meta, "metadata_id": meta_id, "about": about, "conversion": conversion, "conversion_id": text_id, "text": text, "title": title, "language": lang, "links": links, "source_headers": _lines(headers_of_source)}


def captured(pages: DataFrame) -> DataFrame:
    """(page_id, record): pages as WARC response records."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([response(p, u, (h or "").encode()) for p, u, h in rows], pa.binary())], names=["page_id", "record"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    return source.mapInArrow(per_slice(work), "page_id long, record binary")


def derivatives(records: DataFrame, keep_records: bool = False) -> DataFrame:
    """One row per response record of ``records(page_id, record)``, with both derivative records as they
    are; with ``keep_records`` also as gzip members, whose concatenation is a .warc.gz file."""
    schema = DERIVED + (", metadata_member binary, conversion_member binary" if keep_records else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for headers, block in read_records(data or b""):
                if (d := derive(headers, block)) is None:
                    continue
                # The links are those that a reader of the new records finds.
                meta, text = next(read_records(d["metadata"]))[0], next(read_records(d["conversion"]))[0]
                row = [page, d["target_uri"], d["response_id"], d["payload_digest"], d["metadata_id"], meta["warc-refers-to"], meta["warc-block-digest"]]
                row += [d["conversion_id"], text["warc-refers-to"], text["warc-payload-digest"], d["title"], d["language"], d["links"], len(d["links"]), len(d["text"]), hashlib.sha256(d["text"]).hexdigest()]
                row += [d["source_headers"], d["metadata"].decode(), d["conversion"].decode()]
                rows.append(row + ([gzip.compress(d["metadata"], mtime=0), gzip.compress(d["conversion"], mtime=0)] if keep_records else []))
        if not rows:
            return None
        kinds = {"page_id": pa.int64(), "links": pa.list_(pa.string()), "n_links": pa.int32(), "n_text_bytes": pa.int64(), "metadata_member": pa.binary(), "conversion_member": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)

    return records.select(F.col("page_id").cast("long").alias("page_id"), F.col("record").alias("text")).mapInArrow(per_slice(work), schema)


def _whole_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between record marks, in order of their range -> records; a record whose block holds the mark is joined again."""
    start = RECORD_MARK[4:].encode()
    at, held = None, []

    def missing() -> int:
        head, _, block = held[0].partition(b"\r\n\r\n")
        size = _length(_headers(head))
        return 0 if size is None else size - len(block) - sum(map(len, held[1:]))

    for batch in batches:
        out = []
        for path, place, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and at == (path, place) and missing() > 0:
                held.append(RECORD_MARK.encode() + piece)
                continue
            if held:
                out.append(b"".join(held) + b"\r\n\r\n")
            at, held = (path, place), [piece if piece.startswith(start) else start + piece]
        if out:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.array(out, pa.binary())], names=["page_id", "record"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b"".join(held) + b"\r\n\r\n"], pa.binary())], names=["page_id", "record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the records of WARC/1.x files, one per row; page_id is null.

    Plain files are read in ranges of ``spark.sql.files.maxPartitionBytes``, compressed ones whole, as a
    stream.  A record whose own block holds another file's records counts as cut where a range ends within it.
    """
    pieces = spark.read.option("lineSep", RECORD_MARK).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("place"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_whole_records, "page_id long, record binary")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(captured(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
