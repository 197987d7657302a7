"""WARC archives from legacy ARC archives.

An ARC file starts with a version block that declares the fields of its records' header lines:
version 1 has ``URL IP-address Archive-date Content-type Archive-length``, version 2 adds
``Result-code Checksum Location Offset Filename`` before the length. A record is its header line,
then exactly the declared bytes, then a newline. The converter takes headers apart by the file's
own version, reads payloads by declared length (never by searching for the next header) and makes up
what WARC needs: record ids (from the digest of the ARC header and content, so reruns agree),
timestamps, types and digests, and for revisits the record they refer to. Archives travel as rows (name, content) in Parquet, whose commit
protocol survives lost executors; ``content`` is a file as other tools read it, one gzip member per
record in WARC.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, small_enough, stored

V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Characters of a URL that stay as they are; the others are written as %XX for each byte of UTF-8.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
#: Header fields that both versions have and that do not depend on the place in a file: a record's id comes from these.
LASTING = ("URL", "IP-address", "Archive-date", "Content-type")
#: Payloads below this many bytes are never revisits.
REVISIT_LEAST = 100


def arc_file(records: list[tuple[int | None, str | None, bytes]], version: int, name: str = "legacy") -> bytes:
    """An ARC file of pages ``(id, url, payload)``, as a crawler of that version would write it."""
    fields = V1 if version == 1 else V2
    body = b"%d 0 crawler\n" % version + fields + b"\n"
    opening = f"filedesc://{name}.arc 0.0.0.0 20010101000000 text/plain".encode()
    out = [opening + (b" 200 - - 0 %s.arc" % name.encode() if version == 2 else b"") + b" %d\n" % len(body) + body + b"\n"]
    size = len(out[0])
    for key, url, payload in records:
        http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\n\r\n" % (b"" if key is None else b"%d" % key)
        place = quote(url or "", safe=PRINTABLE, errors="replace") or "urn:none"
        date = (datetime(2001, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(key or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
        line = f"{place} 192.0.2.{(key or 0) % 254 + 1} {date} text/html".encode()
        if version == 2:
            line += b" 200 %s - %d %s.arc" % (hashlib.md5(payload).hexdigest().encode(), size, name.encode())
        record = line + b" %d\n" % (len(http) + len(payload)) + http + payload + b"\n"
        out.append(record)
        size += len(record)
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block; raises ValueError if broken."""
    line, at = _line(content, 0)
    length = int(line.rsplit(b" ", 1)[1])
    block = content[at : at + length]
    version, names = block.split(b"\n")[:2]
    if version.split(b" ")[0] not in (b"1", b"2"):
        raise ValueError(f"unknown ARC version {version[:20]!r}")
    fields = names.decode().split(" ")
    at += length + 1
    while at < len(content):
        line, start = _line(content, at)
        values = line.decode("utf-8", "replace").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"header of {len(values)} fields, {len(fields)} declared, at {at}")
        header = dict(zip(fields, values, strict=True))
        end = start + int(header["Archive-length"])
        if end > len(content):
            raise ValueError(f"record at {at} is cut off")
        yield header, content[start:end]
        at = end + 1


def _line(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\n", at)
    if end < 0:
        raise ValueError(f"header at {at} has no end")
    return content[at:end], end + 1


def http_parts(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and payload of an HTTP message."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, content
    lines = content[:end].decode("latin-1").split("\r\n")[1:]
    return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}, content[end + 4 :]


def record_identity(header: dict[str, str], content: bytes) -> tuple[str, str, str]:
    """Record id, target URI and date of the WARC record that an ARC record becomes, alike for both versions."""
    told = "\n".join(f"{k}:{header[k]}" for k in LASTING).encode()
    digest = hashlib.sha256(told + b"\n" + content).digest()
    when = datetime.strptime(header["Archive-date"][:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    return f"<urn:uuid:{uuid.UUID(bytes=digest[:16], version=5)}>", header["URL"], when


def warc_record(header: dict[str, str], content: bytes, original: tuple[int | None, str, str, str] | None) -> bytes:
    """The WARC record that an ARC record becomes; ``original`` (page, record id, URI, date) makes it a revisit."""
    fields, payload = http_parts(content)
    identity, uri, when = record_identity(header, content)
    block = content if original is None else content[: len(content) - len(payload)]
    if original is not None and original[1] == identity:  # a row equal to the response's has an id of its own
        identity = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {identity}", f"WARC-Date: {when}",
        f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {header['IP-address']}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}", f"X-Page-Id: {fields.get('x-page-id', '')}",
    ]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {original[1]}"]
        head += [f"WARC-Refers-To-Target-URI: {original[2]}", f"WARC-Refers-To-Date: {original[3]}", f"X-Refers-To-Page: {'' if original[0] is None else original[0]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gzip_members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Each member unpacked. A member is fed ``step`` bytes at a time, so nothing behind it is copied."""
    view, at = memoryview(content), 0
    while at < len(view):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof:
            if at >= len(view):
                raise ValueError("the last member is cut off")
            parts.append(opener.decompress(view[at : at + step]))
            at = min(at + step, len(view))
        at -= len(opener.unused_data)
        yield b"".join(parts)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member; checks declared length and block digest."""
    for data in gzip_members(content):
        end = data.index(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs in {headers['WARC-Record-ID']}")
        yield headers, block


def _legacy(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list[int], bytes]]:
    """ARC files of the pages of a batch, of about ``most`` bytes, versions in turn; with row numbers."""
    ids, urls, texts = (batch.column(i).to_pylist() for i in range(3))
    rows: list[int] = []
    size = version = 0
    for i, html in enumerate(texts):
        rows.append(i)
        size += len(html or "")
        if size >= most or i == len(texts) - 1 or len(rows) == 256:
            yield rows, arc_file([(ids[j], urls[j], (texts[j] or "").encode()) for j in rows], version % 2 + 1)
            rows, size, version = [], 0, version + 1


def converted_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 500_000) -> DataFrame:
    """``name, content``: WARC files with a record for each row of ``pages``, by way of ARC files.

    Of records with equal payloads of at least 100 bytes, the one with the smallest id is a response
    and the others revisit it. A null id is larger than any; of rows of one id, the one with the smallest URL (null
    first) counts, and of equal rows one. Null html is an empty payload, a null URL becomes ``urn:none``. Rows that
    repeat an id with another payload stand by that one. Extra columns are ignored. No rows give no archives.

    Pages move only if more than ``broadcast_rows`` of them are revisits, or if they repeat a response's id and payload.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            found = []
            for _, file in _legacy(batch):
                for header, content in arc_records(file):
                    fields, payload = http_parts(content)
                    found.append((int(fields["x-page-id"]) if fields["x-page-id"] else None, hashlib.sha256(payload).digest(), len(payload), *record_identity(header, content)))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in found], k) for c, k in enumerate(kinds)), batch.column(1)], ["id", "digest", "size", "record", "uri", "date", "url"])

    seen = stored(rows.mapInArrow(lean(digests), "id long, digest binary, size long, record string, uri string, date string, url string"), "warc-digests").filter(F.col("size") >= REVISIT_LEAST)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url", "record", "uri", "date"))
    first = seen.groupBy("digest").agg(least.alias("original"), F.count("*").alias("n")).filter("n > 1")
    again = seen.select("id", "digest").join(first, "digest").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "original")
    own = F.col("_id").eqNullSafe(F.col("original.id"))
    revisits = stored(again.filter(~own).distinct(), "warc-revisits")
    if small_enough(revisits, broadcast_rows):
        revisits = F.broadcast(revisits)
    # an id may be repeated with another payload: the reference holds for the payload it was found for
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    at = F.col("id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    repeats = stored(again.filter(own).groupBy("_id", "_digest", "original").agg(F.count("*").alias("m")).filter("m > 1").drop("m"), "warc-repeats")
    if repeats.isEmpty():
        joined = rows.join(revisits, at, "left").drop("_id", "_digest")
    else:
        joined = rows.join(repeats, at, "left_anti").join(revisits, at, "left").drop("_id", "_digest")
        # equal rows are counted before they are shuffled; one that has the response's URL is the response
        copies = rows.join(repeats, at).groupBy("id", "url", "_digest").agg(F.count("*").alias("n"), F.first("html").alias("html"), F.first("original").alias("of"))
        chosen = F.col("url").eqNullSafe(F.col("of.url"))
        copies = copies.select("id", "url", "html", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda i: F.struct(F.when(~chosen | (i > 1), F.col("of")).alias("original")))).alias("c"))
        joined = joined.unionByName(copies.select("id", "url", "html", "c.original"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            originals = [x and (x["id"], x["record"], x["uri"], x["date"]) for x in batch.column(3).to_pylist()]
            for members, file in _legacy(batch):
                out = [gzip_member(warc_record(h, c, originals[i])) for i, (h, c) in zip(members, arc_records(file), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(out)], pa.large_binary()).cast(pa.binary())], ["name", "content"])
                number += 1

    return joined.mapInArrow(lean(convert), "name string, content binary")


READ_SCHEMA = "page_id long, record_id string, date string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of WARC files ``(name, content)``, columns as in ``READ_SCHEMA``; digests are checked."""
    bounded_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in warc_records(content.as_py()):
                    payload = http_parts(block)[1] if h["WARC-Type"] == "response" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                        raise ValueError(f"payload differs from its digest in {h['WARC-Record-ID']}")
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), digest, int(h["X-Refers-To-Page"]) if h.get("X-Refers-To-Page") else None, h.get("WARC-Refers-To"), payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return archives.mapInArrow(lean(run), READ_SCHEMA)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages' archives to the shared folder and read every record back."""
    return read_archives(stored(converted_archives(pages, **columns), "warc"), with_payload=False)
