"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives one metadata record (application/warc-fields: what the
response says about itself, and which record its text is in) and one conversion
record (its visible text, text/plain in UTF-8).  Both name the response in
WARC-Refers-To, carry its URI and date, its payload digest and its HTTP header
lines, and have digests of their own; files keep all of these.  Identifiers are made from the response's
identifier and the record type, so a repeated run gives the same records.

One pass without a shuffle; a record depends on its response alone.
``write_warc`` and ``read_warc`` turn records into WARC/1.1 files and back.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lean, ship

_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)|<!doctype[^>]*>", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/a-zA-Z!?][^>]*(?:>|\Z)")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile("</title", re.I)
_LANGUAGE = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b([^<>]*)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: What every record begins with, up to the last digit of the version.
_BEGIN = "WARC/1."
COLUMNS = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, block string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def visible_text(page: str) -> str:
    """All text that a page shows: a line for each block, white space in it as one space."""
    page = _TAG.sub("", _BREAK.sub("\n", _SILENT.sub(" ", page.replace("\r", " ").replace("\n", " "))))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(x: str) -> str:
    return " ".join(html.unescape(x).split())


def _title(page: str) -> str:
    begin = _TITLE.search(page)
    end = begin and _TITLE_END.search(page, begin.end())
    return _one_line(page[begin.end() : end.start()]) if end else ""


def derivatives(record_id: str | None, uri: str | None, date: str | None, headers: str | None, payload: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    payload, headers, source = payload or b"", headers or "", record_id or "<urn:uuid:00000000-0000-0000-0000-000000000000>"
    named = _CHARSET.search(headers) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        page = payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    page = page.encode("utf-8", "replace").decode()
    own = {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>" for kind in ("metadata", "conversion")}
    said = digest(payload)
    language = _LANGUAGE.search(page)
    links = filter(None, (_HREF.search(m[1]) for m in _LINK.finditer(page)))
    fields = [
        ("conversion", own["conversion"]),
        ("sourceContentType", next((x.partition(":")[2].strip() for x in headers.splitlines() if x.lower().startswith("content-type:")), "")),
        ("sourceLength", str(len(payload))),
        ("charset", named[1].lower() if named else "utf-8"),
        ("language", language[1] if language else ""),
        ("title", _title(page)),
        *(("outlink", _one_line(next(filter(None, m.groups()), ""))) for m in links),
    ]
    out = []
    for kind, content, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v)),
        ("conversion", "text/plain; charset=utf-8", visible_text(page)),
    ):
        raw = block.encode()
        out.append((own[kind], kind, record_id, uri, date, content, len(raw), digest(raw), said, headers, block))
    return out


@lean
def _derive(batches: Iterator[pa.RecordBatch], schema: pa.Schema, extra: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [derivatives(*(None if v is None else v if k < 4 or isinstance(v, bytes) else v.encode() for k, v in enumerate(row))) for row in zip(*(part.column(extra + i).to_pylist() for i in range(5)), strict=True)]
            twice = pa.array([i for i in range(part.num_rows) for _ in (0, 1)])
            columns = list(zip(*(x for pair in made for x in pair), strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(twice) for i in range(extra)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema), strict=True))], names=[*part.schema.names[:extra], *schema.names])


def build_derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for every row of ``responses``.

    ``responses`` has record_id, target_uri, date, http_headers and payload
    (string or binary); ``keep`` names further columns to carry along, others
    are not read.  A null payload is an empty one: its conversion record is
    empty.  A null record_id stays null in refers_to.  Bytes that the charset
    can't decode become U+FFFD.  Repeated rows give repeated records; an empty
    table gives none.
    """
    from functools import partial

    ship(responses.sparkSession)
    rows = responses.select(*keep, *(F.col(c).cast("string") for c in ("record_id", "target_uri", "date", "http_headers")), F.col("payload").cast("binary").alias("payload"))
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in COLUMNS.split(", "))])
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(partial(_derive, schema=schema, extra=len(keep)), ", ".join(filter(None, [kept, COLUMNS])))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as responses with page_id kept.

    Pages have no headers of their own; they get those of a plain 200 answer.
    The identifier is made from the page_id and URL.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url").cast("string")).cast("binary"))
    identifier = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), identifier.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " ")))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records as WARC/1.1 files below ``path``, written by Spark's own text writer.

    Every header line of the source has a line of its own; line ends inside
    other values become spaces.  An empty table gives no record.
    """
    lines = F.filter(F.split(F.coalesce("source_headers", F.lit("")), r"\r?\n"), lambda x: x != "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Block-Digest", F.col("block_digest")),
        _line("X-Source-Payload-Digest", F.col("payload_digest")),
        F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("X-Source-Header: "), x)), "\r\n")),
        _line("Content-Type", F.col("content_type")),
        _line("Content-Length", F.octet_length("block").cast("string")),
    )
    records.select(F.concat(head, F.lit("\r\n\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _head(raw: bytes) -> tuple[dict[str, str], int]:
    """(headers, place of the block) of a record from its version's last digit on; lines of a repeated header are joined by line ends."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or b":" not in raw[:end]:
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    headers: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = f"{headers[name]}\r\n{value.strip()}" if name in headers else value.strip()
    return headers, end + 4


def parse_warc(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of what stands between two beginnings; a block may hold such a beginning itself."""
    held = b""
    for part in parts:
        if not held and not part.strip():
            continue
        held = held + _BEGIN.encode() + part if held else part
        headers, at = _head(held)
        size = int(headers.get("content-length", 0))
        if len(held) >= at + size:
            yield headers, held[at : at + size]
            held = b""
    if held:
        raise ValueError("a WARC record is cut off")


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for h, block in parse_warc(x.as_py() or b"" for batch in batches for x in batch.column(0)):
        source = h.get("x-source-header")
        held.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), len(block), h.get("warc-block-digest"), h.get("x-source-payload-digest"), f"{source}\r\n" if source else "", block))
        if len(held) == 256:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


_READ = COLUMNS.replace("block string", "block binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for (_, t), c in zip(columns, zip(*rows, strict=True), strict=True)], names=[n for n, _ in columns])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzipped, with the columns that ``build_derivatives`` gives and the block as bytes.

    Files are read as streams of records, large plain ones by several tasks; a
    record is held at a time.  A file that is no WARC file or is cut off fails,
    and so does one in which a block with a record's beginning in it meets the
    bounds of two tasks.
    """
    ship(spark)
    parts = spark.read.option("lineSep", _BEGIN).option("recursiveFileLookup", "true").text(path).select(F.col("value").cast("binary"))
    return parts.mapInArrow(_read, _READ)
