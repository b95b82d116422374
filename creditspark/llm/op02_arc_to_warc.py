"""Operator 2: converter of legacy ARC archives to WARC.

``write_arc`` lays records out as ARC files of version 1 or 2 (one file per partition, gzip);
``read_arc`` parses them by their version's header line and the declared lengths; ``to_warc``
synthesises WARC identifiers, timestamps, types (response, or revisit of an equal payload) and
digests; ``write_warc`` and ``read_warc`` store and parse WARC files. Files are written and listed
by Spark's text and binary-file sources, so any path that Spark reads will do; a worker streams
a file through a decompressor and holds one record beside the compressed bytes. Files are as
large as the input partitions make them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch

# The header lines of the ARC versions and the WARC names used.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SCHEMA = ("page_id long, url string, ip string, archive_date string, content_type string, arc_version int, "
              "http_head binary, payload binary, payload_bytes long, payload_digest string")
WARC_SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, page_id long, payload binary, "
               "payload_bytes long, payload_digest string, block_digest_ok boolean, refers_to_record string, refers_to long")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None, url: str, date: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {date} {url}')}"


def _token(text: str | None) -> str:
    """A URL as one header token: percent-escapes for white space and control characters."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text) if text else "-"


# ---------------------------------------------------------------- ARC

def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of (page_id, url, html, archive_date): even partitions version 1, odd ones 2.

    A null html is an empty payload, a null url is ``-``; the page id travels as an HTTP header.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("binary").alias("html"), F.col("archive_date").cast("string").alias("archive_date"),
                        F.spark_partition_id().alias("part"))
    rows.mapInArrow(_arc_records, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    version, offset, name = 0, 0, ""
    for batch in batches:
        out = []
        for page_id, url, html, date, part in zip(*(c.to_pylist() for c in batch.columns)):
            if not version:
                version, name = 1 + part % 2, f"part-{part:05d}.arc.gz"
                body = f"{version} 0 creditspark\n{ARC_FIELDS[version]}\n".encode()
                about = f"filedesc://{name} 0.0.0.0 {date} text/plain"
                line = f"{about} {len(body)}" if version == 1 else f"{about} 200 - - 0 {name} {len(body)}"
                out.append(line.encode() + b"\n" + body)
                offset = len(out[0]) + 1
            html = html or b""
            own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode()
            about = f"{_token(url)} 0.0.0.0 {date} text/html"
            length = len(head) + len(html)
            line = f"{about} {length}" if version == 1 else f"{about} 200 {digest(html)} - {offset} {name} {length}"
            out.append(line.encode() + b"\n" + head + html)
            offset += len(out[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


class _Bytes:
    """Sequential reads of a gzip file's content (one or more members)."""

    def __init__(self, compressed: bytes):
        self.rest, self.buffer, self.at = memoryview(compressed), b"", 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while len(self.rest):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            step = self.rest[:1 << 18]
            data = self.inflate.decompress(step)
            unused = len(self.inflate.unused_data)
            self.rest = self.rest[len(step) - unused:]
            if data:
                self.buffer, self.at = self.buffer[self.at:] + data, 0
                return True
        return False

    def take(self, n: int) -> bytes:
        if len(self.buffer) - self.at < n:
            parts, have = [self.buffer[self.at:]], len(self.buffer) - self.at
            self.buffer, self.at = b"", 0
            while have < n and self._more():
                parts.append(self.buffer)
                have += len(self.buffer)
                self.buffer = b""
            self.buffer, self.at = b"".join(parts), 0
        out = self.buffer[self.at:self.at + n]
        self.at += len(out)
        if len(out) < n:
            raise ValueError("the archive ends inside a record")
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = self.at
        while True:
            end = self.buffer.find(b"\n", seen)
            if end >= 0:
                out, self.at = self.buffer[self.at:end], end + 1
                return out
            seen = len(self.buffer) - self.at
            if not self._more():
                out, self.buffer, self.at = self.buffer[self.at:], b"", 0
                return out or None


def arc_records(compressed: bytes) -> Iterator[dict]:
    """Records of an ARC file, by its version's fields and each header line's declared length."""
    data, fields, version = _Bytes(compressed), None, 0
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").split(" ")
        length = int(values[-1])
        body = data.take(length)
        if fields is None:
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            fields = lines[1].split()
            if fields != ARC_FIELDS[version].split():
                raise ValueError(f"not an ARC version {version} header: {lines[1]!r}")
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC version {version} record line has {len(fields)} fields: {line[:200]!r}")
        named = dict(zip(fields, values))
        cut = body.find(b"\r\n\r\n")
        head, payload = (body[:cut + 4], body[cut + 4:]) if cut >= 0 and body.startswith(b"HTTP/") else (b"", body)
        own = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        yield {"page_id": int(own[1]) if own else None, "url": named["URL"], "ip": named["IP-address"],
               "archive_date": named["Archive-date"], "content_type": named["Content-type"], "arc_version": version,
               "http_head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload)}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _record_table(files: DataFrame, parse, schema: str, with_payload: bool) -> DataFrame:
    fields = [part.split() for part in schema.split(", ")]
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse(content.as_buffer()):
                    if not with_payload:
                        record["payload"] = None
                    held.append(record)
                    size += 500 + len(record["payload"] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kinds)

    table = files.mapInArrow(rows, schema)
    return table if with_payload else table.select([n for n, _ in fields if n != "payload"])


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def read_arc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Records of a folder of ARC files (``ARC_SCHEMA``)."""
    return _record_table(_files(spark, path), arc_records, ARC_SCHEMA, with_payload)


# ---------------------------------------------------------------- conversion

def to_warc(records: DataFrame, digests: DataFrame) -> DataFrame:
    """ARC records with their WARC identity: ``warc_date``, ``record_type``, ``refers_to``.

    ``digests`` are the same records, for example without payloads. Of records with equal
    payloads (digest and length) that with the largest page_id is the response (all of them
    where it repeats, or where all page ids are null), the others revisit it.
    """
    by = ["payload_digest", "payload_bytes"]
    responses = digests.groupBy(*by).agg(F.max(F.struct("page_id", "url", "archive_date")).alias("r"))
    rows = records.join(responses, by, "left").withColumn("_own", F.col("r.page_id").eqNullSafe(F.col("page_id")))
    date = F.rpad(F.regexp_extract("archive_date", r"^\d*", 0), 14, "0")
    return rows.select(
        *[c for c in records.columns],
        F.concat(F.substring(date, 1, 4), F.lit("-"), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2), F.lit("T"),
                 F.substring(date, 9, 2), F.lit(":"), F.substring(date, 11, 2), F.lit(":"), F.substring(date, 13, 2), F.lit("Z")).alias("warc_date"),
        F.when(F.col("_own"), "response").otherwise("revisit").alias("record_type"),
        F.when(~F.col("_own"), F.col("r.page_id")).alias("refers_to"),
        F.when(~F.col("_own"), F.col("r.url")).alias("refers_url"),
        F.when(~F.col("_own"), F.col("r.archive_date")).alias("refers_date"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC 1.1 files of ``to_warc`` rows, one per partition; revisits carry no payload."""
    rows = records.select("page_id", "url", "archive_date", "warc_date", "record_type", "http_head",
                          F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
                          "payload_bytes", "payload_digest", "refers_to", "refers_url", "refers_date", "arc_version")
    rows.mapInArrow(_warc_records, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun:
                begun = True
                info = b"software: creditspark\r\nformat: WARC File Format 1.1\r\n"
                out.append(_warc(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_uri(r['page_id'], 'warcinfo', r['archive_date'])}>",
                                  f"WARC-Date: {r['warc_date']}", "Content-Type: application/warc-fields"], info))
            block = r["http_head"] + (r["payload"] or b"")
            lines = [f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{record_uri(r['page_id'], r['url'], r['archive_date'])}>",
                     f"WARC-Date: {r['warc_date']}", f"WARC-Target-URI: {r['url']}", "Content-Type: application/http; msgtype=response",
                     f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(block)}",
                     f"X-Payload-Length: {r['payload_bytes']}", f"X-Source-Format: ARC/{r['arc_version']}"]
            if r["page_id"] is not None:
                lines.append(f"X-Page-Id: {r['page_id']}")
            if r["record_type"] == "revisit":
                lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_uri(r['refers_to'], r['refers_url'], r['refers_date'])}>",
                          f"WARC-Refers-To-Target-URI: {r['refers_url']}", f"X-Refers-To-Page-Id: {r['refers_to']}"]
            out.append(_warc(lines, block))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def _warc(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def warc_records(compressed: bytes) -> Iterator[dict]:
    """Response and revisit records of a WARC file, by each one's declared length."""
    data = _Bytes(compressed)
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := data.line()) not in (b"\r", b"", None):
            name, _, value = line.decode().rstrip("\r").partition(": ")
            head[name.lower()] = value
        block = data.take(int(head["content-length"]))
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        payload = block[block.find(b"\r\n\r\n") + 4:] if block.startswith(b"HTTP/") else block
        named = head["warc-payload-digest"].removeprefix("sha1:")
        own, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        full = kind == "response"
        yield {"record_id": head["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": head["warc-target-uri"],
               "warc_date": head["warc-date"], "page_id": int(own) if own else None, "payload": payload if full else None,
               "payload_bytes": len(payload) if full else int(head["x-payload-length"]),
               "payload_digest": digest(payload) if full else named,
               "block_digest_ok": head["warc-block-digest"] == f"sha1:{digest(block)}" and (not full or digest(payload) == named),
               "refers_to_record": head.get("warc-refers-to", "").strip("<>") or None, "refers_to": int(refers) if refers else None}


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of a folder of WARC files (``WARC_SCHEMA``)."""
    return _record_table(_files(spark, path), warc_records, WARC_SCHEMA, with_payload)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """A folder of ARC files as a folder of WARC files."""
    write_warc(to_warc(read_arc(spark, arc_path), read_arc(spark, arc_path, with_payload=False)), warc_path)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted, and the WARC records read back (without payloads).

    ``pages``: page_id, url, html; ARC dates follow from the page id (null: the epoch day).
    Null html is an empty payload; every row gives a record; extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "archives")
    day = F.date_add(F.lit("1996-01-01").cast("date"), F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(3650)).cast("int"))
    dated = pages.withColumn("archive_date", F.concat(F.date_format(day, "yyyyMMdd"), F.lit("120000")))
    write_arc(dated, scratch.path("arc"))
    convert(pages.sparkSession, scratch.path("arc"), scratch.path("warc"))
    scratch.drop("arc")
    return read_warc(pages.sparkSession, scratch.path("warc"), with_payload=False)
