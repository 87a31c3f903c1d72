"""Legacy archive converter: ARC files (versions 1 and 2) become WARC 1.1 records.

An ARC file is a ``filedesc://`` record that names the version and the header fields, followed by URL records: one
header line of space-separated fields, then exactly the declared number of bytes, then a line feed. The fields of a
header line follow the version: 5 in version 1, 10 in version 2. The converter reads lines and declared lengths (a
payload may hold anything, header-like lines too) and synthesises what WARC wants: record id (UUID from the record's
identity), WARC-Date from the 14-digit time, record type from the content (an HTTP head makes a response, which keeps its
head; a name-server answer or anything else is a resource), and payload and block digests. Whole ARC files, plain or in
gzip members, are converted by ``convert_files``; the registered query writes pages as ARC records first.

Defined cases: a null html is an empty payload; a null url is written as ``urn:page:<page_id>``; spaces and controls in
a url are percent-encoded; rows of equal payloads of at least ``min_bytes`` bytes: those with the largest page_id are
response records and the others revisit them (null page_ids revisit too, if any is not null); repeated rows stay;
an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, staged
from .token_store import _open

# The fields of an ARC header line by version, and the version blocks' names for them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    version: int


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        return self.block[len(http_head(self.block)) :] if self.headers.get("Content-Type", "").startswith("application/http") else self.block


def arc_file_header(version: int, name: str, date: str) -> bytes:
    """The version block: ``filedesc`` line, version line and the field names of the URL records."""
    body = f"{version} {0 if version == 1 else 1} deltaweave\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    if version == 2:
        line += f"200 - - 0 {name} "
    return f"{line}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, mime: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    """One URL record with a header line of the version."""
    safe = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    line = f"{safe} 0.0.0.0 {date} {mime} "
    if version == 2:
        line += f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return f"{line}{len(content)}\n".encode("utf-8", "surrogatepass") + content + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """URL records of an ARC stream; the version block decides how header lines are split."""
    version, names = 0, ()
    while True:
        line = stream.readline()
        while line == b"\n":  # records are parted by line feeds
            line = stream.readline()
        if not line:
            return
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogatepass")
        head = text.startswith("filedesc://")
        if not head and not version:
            raise ValueError("an ARC file begins with a filedesc record")
        parts = text.split(" ")
        if not head and len(parts) != len(names):
            raise ValueError(f"a version {version} header line has {len(names)} fields: {text[:80]!r}")
        length = int(parts[-1])
        content = stream.read(length)
        if len(content) != length:
            raise ValueError("the file ends within a record")
        if head:
            lines = content.decode().split("\n")
            version = int(lines[0].split(" ")[0])
            names = tuple(lines[1].split(" "))
            if names != ARC_FIELDS.get(version):
                raise ValueError(f"unknown ARC version or fields: {lines[:2]}")
        else:
            yield ArcRecord(dict(zip(names, parts, strict=True)), content, version)


def http_head(content: bytes) -> bytes:
    """The HTTP response head that the content begins with, with its empty line; none: empty."""
    if not content.startswith(b"HTTP/"):
        return b""
    ends = [(at + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (at := content.find(e)) >= 0]
    return content[: min(ends)] if ends else b""


def to_warc(arc: ArcRecord, key: str, refers_to: str | None = None, refers_url: str | None = None, page_id: str = "") -> WarcRecord:
    """Synthesise the WARC record of an ARC record: a response, a revisit of ``refers_to`` (a record id) or a resource."""
    url, d = arc.fields["URL"], arc.fields["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head = http_head(arc.content)
    payload = arc.content[len(head) :]
    block = head if refers_to else arc.content
    headers = {
        "WARC-Type": "revisit" if refers_to else "response" if head else "resource",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-IP-Address": arc.fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response" if head else arc.fields["Content-type"],
    }
    if page_id:
        headers["X-Page-ID"] = page_id
    if refers_to:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to}
        if refers_url:
            headers["WARC-Refers-To-Target-URI"] = refers_url
    return WarcRecord(headers, block)


def convert_files(paths: DataFrame, out_dir: str) -> DataFrame:
    """ARC files (``path``; .gz: gzip members) -> a WARC file each under ``out_dir``; returns the manifest (path, records, source).

    A file is a task's unit, its records are read one at a time; a file that is no ARC file fails the job.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                to, n = f"{out_dir}/of-{uuid.uuid4().hex}.warc.gz", 0
                with _open(path, "r") as raw, _open(to, "w") as out:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
                    for arc in read_arc(stream):
                        out.write(write_warc(to_warc(arc, f"{path}/{n}/{arc.fields['URL']}/{arc.fields['Archive-date']}")))
                        n += 1
                yield pa.RecordBatch.from_pylist([{"path": to, "records": n, "source": path}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("source", pa.string())]))

    one = paths.select(F.col("path").cast("string").alias("path")).where("path is not null")
    return staged(one.repartition(max(1, one.count())).mapInArrow(convert, "path string, records long, source string"), "warc-manifest")


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"


def write_warc(record: WarcRecord) -> bytes:
    """One record as a gzip member of its own."""
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + f"Content-Length: {len(record.block)}\r\n\r\n"
    return gzip.compress(lines.encode("utf-8", "surrogatepass") + record.block + b"\r\n\r\n", 6, mtime=0)


def read_warc(stream) -> Iterator[WarcRecord]:
    """Records of a gzip WARC stream, one held at a time."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
                headers[name] = value
            block = f.read(int(headers["Content-Length"]))
            http = dict(x.split(": ", 1) for x in block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
            yield WarcRecord(headers, block, http)


def write_archives(pages: DataFrame, out_dir: str, version: int = 2, date: str = "20240101000000", min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) -> ARC -> WARC files under ``out_dir``; returns the manifest, one row a file.

    Which record is the response is decided on digests alone (partial maxima first, so a payload that a third of the
    pages share costs one row a task); the pages then join the few digests that occur twice or more. A task writes its
    archive under a name of its own, listed in the staged manifest.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"), F.max_by("url", "page_id").alias("response_url"))
    groups = groups.where("n > 1 and response_id is not null").select(F.col("sha1").alias("group_sha1"), "response_id", "response_url")
    decided = rows.join(groups, F.col("sha1") == F.col("group_sha1"), "left").select("page_id", "url", "payload", "response_id", "response_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n = "", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{out_dir}/part-of-{uuid.uuid4().hex}.warc.gz"
                    out = _open(path, "w")
                url = row["url"] or f"urn:page:{row['page_id']}"
                # The legacy form: a version block and one record, as the converter meets them.
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(row['payload'])}\r\n\r\n".encode()
                legacy = arc_file_header(version, "pages.arc", date) + arc_record(version, url, date, head + row["payload"])
                for arc in read_arc(io.BytesIO(legacy)):
                    revisit = row["response_id"] is not None and row["page_id"] != row["response_id"]
                    digest = hashlib.sha1(row["payload"]).hexdigest()
                    refers = record_id(f"{row['response_id']}/{digest}") if revisit else None
                    warc = to_warc(arc, f"{row['page_id']}/{digest}", refers, row["response_url"] if revisit else None, "" if row["page_id"] is None else str(row["page_id"]))
                    if revisit:
                        warc.headers["X-Refers-To-Page"] = str(row["response_id"])
                    out.write(write_warc(warc))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n}], schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return staged(decided.mapInArrow(write, "path string, records long"), "warc-manifest")


RECORDS = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("warc_date", pa.string()))


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record read back from the archives; digests of responses are checked against their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: list[dict] = []
                with _open(path, "r") as f:
                    for r in read_warc(f):
                        digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = r.headers["WARC-Type"]
                        if kind != "revisit" and base32_sha1(r.payload) != digest:
                            raise ValueError(f"{path}: {r.headers['WARC-Record-ID']} is damaged")
                        page, refers = r.headers.get("X-Page-ID"), r.headers.get("X-Refers-To-Page")
                        size = int(r.http["Content-Length"]) if "Content-Length" in r.http else len(r.payload)
                        out.append({"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "url": r.headers["WARC-Target-URI"], "record_id": r.headers["WARC-Record-ID"], "warc_date": r.headers["WARC-Date"]})
                        if len(out) == 20_000:
                            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(RECORDS))
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(RECORDS))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, warc_date string"
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **parameters) -> DataFrame:
    return read_archives(write_archives(pages, fresh_dir(spark, "archives"), **parameters))
