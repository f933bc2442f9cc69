"""Operator 4, WARC derivatives: response records become linked metadata and plain-text conversion records.

``read_warc`` reads files, plain or gzipped by member (``.gz``), record by
record; ``serialise`` writes one; ``response`` makes the response record of a
captured page; ``derive`` builds for each response

* a ``conversion`` record, text/plain, one line per block of the page, with
  WARC-Refers-To set to the response's id, and
* a ``metadata`` record, application/warc-fields, with WARC-Refers-To and
  WARC-Concurrent-To set likewise, that keeps the source's HTTP status and
  headers, the source digests, the title, the character set and the outlinks.

Ids are name-based UUIDs of the source record, the type and the content, so
reruns agree.  Digests are sha1 in base 32; a response's payload digest covers
its HTTP body.  No value can start a line of its own: line ends and other
control characters are percent-encoded in addresses and become blanks elsewhere.

Records that are no HTTP responses are passed over by ``derive``.  What is no
whole record (a cut-off file, a bad length) and a response without an id become
rows with ``error`` set and their bytes as block; nothing fails a job.  Null
html is an empty body, a null url an empty target; broken HTTP heads count as
body.  Equal rows give equal records; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.html_text import lines_of, tags_of
from gaugeworks.llm.spark_tools import documents, tidied

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
_HREF = re.compile(r"(?:^|\s|/)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]")

Record = tuple[dict[str, str], bytes]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(names))}>"


def plain(value: str) -> str:
    """A header value on one line."""
    return _CONTROL.sub(" ", value).strip()


def address(value: str) -> str:
    """An address on one line; control characters are percent-encoded."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def serialise(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    """One record; with ``compress`` a gzip member of its own, with a fixed time."""
    lines = [VERSION, *(f"{plain(k)}: {plain(v)}" for k, v in headers.items())]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def head_of(raw: bytes) -> tuple[dict[str, str], int, int]:
    """(headers, start and length of the block) of the record that ``raw`` begins with; ValueError if it is none."""
    if not raw.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {raw[:20]!r}")
    end = re.compile(rb"\r?\n\r?\n").search(raw)
    if end is None:
        raise ValueError("a record head is cut off")
    headers, last = {}, None
    for text in raw[: end.start()].decode("utf-8", "replace").split("\n")[1:]:
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip()
            headers[last] = value.strip()
    size = headers.get("Content-Length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError(f"a record has no valid Content-Length: {size[:20]!r}")
    return headers, end.end(), int(size)


def parse(raw: bytes) -> Iterator[Record]:
    """(headers, block) of each record of a file; what is no whole record raises ValueError."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    while raw := raw.lstrip(b"\r\n"):
        headers, at, size = head_of(raw)
        if at + size > len(raw):
            raise ValueError("a record block is cut off")
        yield headers, raw[at : at + size]
        raw = raw[at + size :]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def response(url: str, body: bytes, date: str = DATE) -> Record:
    """A response record of a captured page."""
    url, block = address(url), HTTP_HEAD.format(n=len(body)).encode() + body
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", url, date, sha1(body)), "WARC-Date": date, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1(body), "WARC-Block-Digest": sha1(block), "Content-Length": str(len(block)),
    }
    return headers, block


def _body_text(fields: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """(page, character set) after any content coding."""
    named = {k.lower(): v for k, v in fields}
    if named.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47)
        except zlib.error:
            pass
    found = re.search(r"charset=[\"']?([\w-]+)", named.get("content-type", "") + " " + body[:1024].decode("latin-1"), re.I)
    charset = found[1].lower() if found else "utf-8"
    try:
        return body.decode(charset, "replace"), charset
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def derive_one(headers: dict[str, str], block: bytes) -> list[Record]:
    """The conversion and metadata records of one response record; ValueError if it has no id."""
    if headers.get("WARC-Type") != "response":
        return []
    if not headers.get("WARC-Record-ID"):
        raise ValueError("a response has no WARC-Record-ID")
    status, fields, body = http_parts(block)
    page, charset = _body_text(fields, body)
    source, target, date = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", DATE)
    payload = headers.get("WARC-Payload-Digest") or sha1(body)
    text = "\n".join(line for line, _, _, _ in lines_of(page)).encode()
    title, links = None, {}
    for name, attributes, raw in tags_of(page):
        if name == "title" and title is None:
            title = raw
        elif name == "a" and (found := _HREF.search(attributes)):
            links[address(html.unescape(found[1] or found[2] or found[3] or ""))] = None
    notes = [
        ("source-payload-digest", payload), ("source-block-digest", headers.get("WARC-Block-Digest") or sha1(block)), ("source-content-type", headers.get("Content-Type", "")),
        ("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in fields), ("charset", charset), ("title", " ".join(html.unescape(title or "").split())),
        *(("outlink", x) for x in links if x),
    ]
    described = "".join(f"{plain(k)}: {plain(v)}\r\n" for k, v in notes).encode()

    def record(kind: str, content: str, data: bytes, links: dict[str, str]) -> Record:
        own = {
            "WARC-Type": kind, "WARC-Record-ID": record_id(kind, source, sha1(data)), **links, "WARC-Target-URI": target, "WARC-Date": date,
            "Content-Type": content, "WARC-Block-Digest": sha1(data), "Content-Length": str(len(data)),
        }
        return own, data

    return [
        record("conversion", "text/plain; charset=utf-8", text, {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date}),
        record("metadata", "application/warc-fields", described, {"WARC-Refers-To": source, "WARC-Concurrent-To": source}),
    ]


RECORD = "record_id string, record_type string, refers_to string, target_uri string, warc_date string, content_type string, source_payload_digest string, block_digest string, content_length long, headers map<string,string>, block binary, error string"
_HEADERS = pa.map_(pa.string(), pa.string())

#: (headers, block, payload digest of the source, error)
Row = tuple[dict[str, str], bytes, str | None, str | None]


def _batch(rows: list[Row], keys: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    heads, blocks, payloads, errors = zip(*rows)
    named = ("WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
    columns = [pa.array([h.get(k) for h in heads], pa.string()) for k in named]
    columns += [pa.array(payloads, pa.string()), pa.array([h.get("WARC-Block-Digest") for h in heads], pa.string()), pa.array([len(b) for b in blocks], pa.int64())]
    columns += [pa.array([list(h.items()) for h in heads], _HEADERS), pa.array(blocks, pa.binary()), pa.array(errors, pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([*(a for _, a in keys), *columns], names=[*(n for n, _ in keys), *names])


def _batches(rows: Iterator[Row], most: int = 200, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[1])
        if len(held) == most or total > size:
            yield _batch(held, [])
            held, total = [], 0
    if held:
        yield _batch(held, [])


#: What parts two records: the end of a block and the start of the next record.
PARTING = b"\r\n\r\nWARC/1."


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[Row]:
    """Records of the pieces of files; a block that holds the parting itself is put together again."""
    held, file = b"", None
    for name, piece in pieces:
        if held and name != file:
            yield {}, held, None, "a record is cut off"
            held = b""
        first, file = name != file, name
        if held:
            held += PARTING + piece
        else:
            # only the first piece of a file starts with the mark of a record
            held = piece.lstrip(b"\r\n") if first and piece.lstrip(b"\r\n").startswith(b"WARC/") else PARTING[4:] + piece
        try:
            headers, at, size = head_of(held)
        except ValueError as e:
            yield {}, held, None, str(e)
            held = b""
            continue
        if len(held) >= at + size:
            yield headers, held[at : at + size], headers.get("WARC-Payload-Digest"), None
            held = b""
    if held:
        yield {}, held, None, "a record is cut off"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, read as a stream: a task holds a record, never a file.

    Plain files are split between tasks where one record ends and the next
    begins; a gzipped file is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), p.as_py()) for batch in batches for f, p in zip(batch.column("file"), batch.column("piece")))
        yield from _batches(_records(pieces))

    lines = spark.read.option("lineSep", PARTING.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(tidied(run), RECORD)


def _derived(headers: dict[str, str], block: bytes) -> list[Row]:
    try:
        return [(h, b, headers.get("WARC-Payload-Digest"), None) for h, b in derive_one(headers, block)]
    except ValueError as e:
        return [(headers, block, headers.get("WARC-Payload-Digest"), str(e))]


def derive(records: DataFrame) -> DataFrame:
    """Derivative records of records(headers, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for h, b in zip(batch.column("headers"), batch.column("block")) for row in _derived(dict(h.as_py() or []), b.as_py() or b""))
        yield from _batches(rows)

    return records.select("headers", "block").mapInArrow(tidied(run), RECORD)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """page_id and the derivative records of each captured page(page_id, url, html)."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows, place = batch.slice(at, 500), [], []
                for i, (url, page) in enumerate(zip(part.column("url").to_pylist(), part.column("html").to_pylist())):
                    made = _derived(*response(url or "", (page or "").encode()))
                    rows += made
                    place += [i] * len(made)
                if rows:
                    yield _batch(rows, [("page_id", part.column("page_id").take(pa.array(place)))])

    return pages.select("page_id", "url", "html").mapInArrow(tidied(run), f"page_id {id_type}, {RECORD}")


def members(records: DataFrame) -> DataFrame:
    """Records without an error as gzip members, (record_id, member): written one after another they are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [serialise(dict(h.as_py() or []), b.as_py() or b"", compress=True) for h, b in zip(part.column("headers"), part.column("block"))]
                yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array(made, pa.binary())], names=["record_id", "member"])

    return records.where("error is null").select("record_id", "headers", "block").mapInArrow(tidied(run), "record_id string, member binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = page_derivatives(documents(spark, sf_dir, "pages"))
    return made.withColumn("text", F.decode("block", "UTF-8")).drop("headers", "block")
