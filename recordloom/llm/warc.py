"""Derivatives of WARC responses: linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import file_system, text_batches
from recordloom.llm.html_blocks import parse, shown_text

VERSION = "WARC/1.1"
#: Records in a file at most, and bytes read from one at a time.
FILE_RECORDS, READ_BYTES = 20_000, 1 << 22
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
#: Tasks that read files.
READ_TASKS = 10_000
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:recordloom:warc")
RESPONSE = (
    "record_id string, target_uri string, date string, headers array<struct<name:string,value:string>>, payload binary"
)
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, content_type string, block_digest string, head string, block binary"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(map(str, parts)))}>"


def digest(data: bytes) -> str:
    """A labelled digest as archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: object) -> str:
    return " ".join(str(value).split())


def responses(pages: DataFrame, date: str, id_column: str = "page_id") -> DataFrame:
    """Response records of a table (id, url, html); ids follow from id, url and content.

    A null page is a response with an empty payload, a null url an empty target.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    name = F.sha1(F.concat_ws("\n", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
                  .cast("binary"))
    part = lambda start, size: F.substring(name, start, size)
    identifier = F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">")
    )

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    return pages.select(
        F.col(id_column),
        identifier.alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.array(
            header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(body).cast("string"))
        ).alias("headers"),
        body.alias("payload"),
    )


def named(response: dict) -> tuple[object, ...]:
    """What tells a response from others: its id or, without one, its address and date."""
    if response["record_id"] is not None:
        return (response["record_id"],)
    return (None, response["target_uri"], response["date"])


def _record(kind: str, response: dict, source: str, block: bytes, content_type: str, other: str) -> dict:
    identifier = record_id(kind, *named(response), source)
    refers = [] if response["record_id"] is None else [f"WARC-Refers-To: {one_line(response['record_id'])}"]
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {identifier}",
        f"WARC-Date: {one_line(response['date'] or '')}",
        f"WARC-Target-URI: {one_line(response['target_uri'] or '')}",
        *refers,
        f"WARC-Source-Payload-Digest: {source}",
        f"WARC-Derived-With: {other}",
        f"WARC-Block-Digest: {digest(block)}",
        f"Content-Type: {content_type}",
        f"Content-Length: {len(block)}",
    ]
    return {
        "record_id": identifier,
        "warc_type": kind,
        "refers_to": response["record_id"],
        "target_uri": response["target_uri"],
        "content_type": content_type,
        "block_digest": digest(block),
        "head": "\r\n".join(lines) + "\r\n\r\n",
        "block": block,
    }


def derive(response: dict) -> tuple[dict, dict]:
    """The metadata and the conversion record of one response.

    Both refer to the response and name each other; the metadata block keeps the source's
    headers in order, its payload digest and length, and the page's title, language and
    links; the conversion block is the page's shown text.
    """
    payload = bytes(response["payload"] or b"")
    headers = response["headers"] or []
    kind = next((h["value"] or "" for h in headers if (h["name"] or "").lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.-]+)", kind, re.I)
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    page = parse(text)
    source = digest(payload)
    ids = {k: record_id(k, *named(response), source) for k in ("metadata", "conversion")}
    fields = [("source-header", f"{one_line(h['name'] or '')}: {one_line(h['value'] or '')}") for h in headers]
    fields += [("source-payload-digest", source), ("source-payload-length", len(payload)), ("conversion-record", ids["conversion"])]
    fields += [("title", page.title), ("language", page.language)]
    fields += [("outlink", link) for link in page.links]
    block = "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields).encode("utf-8", "replace")
    metadata = _record("metadata", response, source, block, "application/warc-fields", ids["conversion"])
    plain = shown_text(page).encode("utf-8", "replace")
    conversion = _record("conversion", response, source, plain, "text/plain; charset=utf-8", ids["metadata"])
    return metadata, conversion


def derivatives(frame: DataFrame) -> DataFrame:
    """Two records for each response (columns as in ``RESPONSE``), as in ``RECORD``.

    Null payloads and headers count as empty, a null record id stays null and its
    records have no header that refers to a source, but own ids by address and date; equal responses give equal
    records, also in their ids; other columns are not read.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    kinds = [pa.string()] * 7 + [pa.binary()]
    out = [c.split()[0] for c in RECORD.split(", ")]

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 256):
                rows = [r for response in part.slice(low, 256).to_pylist() for r in derive(response)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(out, kinds, strict=True)], out)

    return text_batches(frame).select(*names).mapInArrow(apply, RECORD)


def write_warc(records: DataFrame, folder: str) -> None:
    """Write records as WARC files by Spark's own text writer, which commits whole tasks.

    A record ends in CR LF CR LF; the writer adds the last of these characters.
    """
    whole = F.concat(F.col("head").cast("binary"), "block", F.lit("\r\n\r").cast("binary"))
    records.select(whole.cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, warc_type, headers, block) of all records below a folder.

    Files are read in pieces and cut by their content lengths, so a block may hold
    anything; a record without a length or cut short is an error.  Files are dealt to as many
    tasks, up to ``READ_TASKS``.
    """
    files = spark.read.format("binaryFile").load(folder).select("path").filter(~F.col("path").rlike("/[_.][^/]*$"))
    schema = "file string, offset long, warc_type string, headers map<string,string>, block binary"

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                system, name = file_system(path)
                with system.open_input_stream(name) as stream:
                    yield from _cut(stream, path)

    # a number that is given stays; tasks for paths alone would be joined to one, as paths are short
    tasks = max(1, min(READ_TASKS, files.count()))
    return files.repartition(tasks).mapInArrow(apply, schema)


def _cut(stream: pa.NativeFile, path: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["file", "offset", "warc_type", "headers", "block"]
    data, offset, rows, held = b"", 0, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    at, done = 0, False
    while True:
        end = data.find(b"\r\n\r\n", at)
        size = -1
        if end >= 0:
            headers = {m[1].decode().lower(): m[2].decode() for m in HEADER.finditer(data, at, end)}
            size = int(headers["content-length"])
        if end < 0 or len(data) < end + 4 + size + 4:
            if done:
                if data[at:].strip():
                    raise ValueError(f"{path}: a record is cut short")
                break
            more = stream.read(max(READ_BYTES, size))
            done = not more
            data, offset, at = data[at:] + more, offset + at, 0
            continue
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"{path}: no end of record")
        rows.append((path, offset + at, headers.get("warc-type"), list(headers.items()), block))
        at, held = end + 8 + size, held + size
        if held >= READ_BYTES or len(rows) >= 1000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()
