"""Legacy archives: ARC version 1 and 2 records to WARC records, and WARC archives read back.

An ARC file starts with a `filedesc://` record whose body names the version and the fields of the header lines that follow:

* version 1: `URL IP-address Archive-date Content-type Archive-length`
* version 2: `URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length`

A record is its header line and, after it, exactly as many bytes as the line's last field declares (an HTTP response), then
a line feed. Conversion synthesises what WARC asks for: `WARC-Record-ID` (a UUID of URL, date and digest, the same in
each run), `WARC-Date` from the 14 digits, `WARC-Type`, `WARC-Payload-Digest` (SHA-1 in base32) and `Content-Length`. The first
line's page number and the digest's winner make a record a `response` or a `revisit` without payload.

Of pages with equal payloads of at least `least_bytes`, the one with the largest page_id is the response. Payloads are
compared by SHA-1 and length; copies are merged before the shuffle, and html is shuffled once, by page. A task writes its
own archive, each record a gzip member, under its attempt's number to the shared folder, and only archives of tasks that ended well are read back.

Defined results: null html is an empty payload; null url is the empty URL; a null page_id is a response of its own group's
largest only where all are null, and refers_to is then null; rows that repeat page_id and html are archived each, as the
same kind; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh_dir, open_fs

FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20240101000000"
NAMESPACE = uuid.NAMESPACE_URL
ROWS = 256


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_head(version: int, name: str, date: str = DATE) -> bytes:
    """The version block that an ARC file starts with."""
    body = f"{version} 0 quarry\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, offset: int, name: str, date: str = DATE) -> bytes:
    """A page as an ARC record; white space in the URL is percent-encoded, as header fields end at a space."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    values = {"URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(payload).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block of an ARC file."""
    line, _, _ = raw.partition(b"\n")
    head = line.decode("utf-8", "replace").split(" ")
    if not head[0].startswith("filedesc://"):
        raise ValueError("not an ARC file")
    at = len(line) + 1
    block = raw[at : at + int(head[-1])]
    version = int(block.split(b" ", 1)[0])
    names = block.split(b"\n")[1].decode().split(" ")
    if version not in FIELDS or tuple(names) != FIELDS[version]:
        raise ValueError(f"unknown ARC version or fields: {version} {names}")
    at += len(block) + 1
    while at < len(raw):
        stop = raw.index(b"\n", at)
        values = raw[at:stop].decode("utf-8", "replace").split(" ")
        if len(values) != len(names):
            raise ValueError(f"a header line of {len(values)} fields in version {version}")
        length, at = int(values[-1]), stop + 1
        if at + length > len(raw):
            raise ValueError("a record is shorter than its declared length")
        yield dict(zip(names, values, strict=True)), raw[at : at + length]
        at += length + 1


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(header block, payload) of an HTTP response."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", body)


def record_id(digest: str, page_id: int | None) -> str:
    """A page's record: its payload and page name it, so a revisit can name the response that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{digest} {page_id}')}>"


def warcinfo_record(name: str) -> bytes:
    """What an archive opens with."""
    content = f"software: quarry\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    lines = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Filename: {name}.warc.gz",
        "Content-Type: application/warc-fields", f"Content-Length: {len(content)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def warc_record(fields: dict[str, str], body: bytes, page_id: int | None, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC record that stands for an ARC record."""
    head, payload = http_parts(body)
    digest, date = sha1_base32(payload), fields["Archive-date"]
    url = fields["URL"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(digest, page_id)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id(digest, refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    content = head if revisit else body
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of a WARC archive, one at a time."""
    rest = b""

    def fill(size: int) -> None:
        nonlocal rest
        while len(rest) < size and (more := stream.read(max(1 << 20, size - len(rest)))):
            rest += more

    while True:
        fill(1 << 16)
        if not rest:
            return
        stop = rest.index(b"\r\n\r\n")
        version, *lines = rest[:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        fill(stop + size + 8)
        content = rest[stop + 4 : stop + 4 + size]
        if len(content) < size:
            raise ValueError("a record is shorter than its declared length")
        rest = rest[stop + size + 8 :]
        yield headers, content


def _archive(uri: str, version: int):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                page, url, html, refers, revisit = (c.slice(at, ROWS).to_pylist() for c in batch.columns)
                arc, offset = [arc_head(version, name)], 0
                for u, h in zip(url, html, strict=True):  # the legacy archive of these pages
                    arc.append(arc_record(version, u, h, offset, name))
                    offset += len(arc[-1])
                if out is None:
                    system, path = open_fs(uri)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                    out.write(gzip.compress(warcinfo_record(name), 1, mtime=0))
                for i, (fields, body) in enumerate(arc_records(b"".join(arc))):
                    out.write(gzip.compress(warc_record(fields, body, page[i], refers[i], revisit[i]), 1, mtime=0))
                n += len(page)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "records": [n]})

    return archive


def _read(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(uri)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{archive}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, content in warc_records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response":
                            payload = http_parts(content)[1]
                            if (len(payload), sha1_base32(payload)) != (size, digest):
                                raise ValueError("a payload doesn't match its digest")
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                        rows.append((page and int(page), size, digest, headers["WARC-Type"], refers and int(refers), headers["WARC-Record-ID"], unquote(headers["WARC-Target-URI"])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names)

    return read


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (bytes), refers_to, revisit: what each page becomes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    digests = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes"))
    equal = F.col("bytes") >= least_bytes
    winners = digests.where(equal).groupBy("digest", "bytes").agg(F.max("page_id").alias("winner"))
    refers = digests.where(equal).join(winners, ["digest", "bytes"]).where("page_id is null and winner is not null or page_id < winner")
    refers = refers.select(F.coalesce("page_id", F.lit(0)).alias("key"), F.col("page_id").isNull().alias("key_null"), "digest", F.col("winner").alias("refers_to")).distinct()
    keyed = rows.withColumns({"key": F.coalesce("page_id", F.lit(0)), "key_null": F.col("page_id").isNull(), "digest": F.sha1("html")})
    out = keyed.join(refers, ["key", "key_null", "digest"], "left")
    return out.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, uri: str | None = None, version: int = 2, least_bytes: int = 0) -> tuple[str, list[str]]:
    """Archives pages as ARC records of the given version, converts them to WARC; returns the folder and its archives."""
    uri = uri or fresh_dir(pages.sparkSession, "warc")
    made = decided(pages, least_bytes).mapInArrow(_archive(uri, version), "archive string, records long").collect()
    return uri, sorted(r.archive for r in made)


def read_archives(spark, uri: str, archives: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri of every record."""
    rows = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives)))
    return rows.mapInArrow(_read(uri), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")
