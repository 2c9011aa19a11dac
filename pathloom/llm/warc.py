"""Operator 12: legacy ARC archives, converted to WARC.

An ARC file starts with a ``filedesc:`` record, which says the version.  Each
record is a header line (five fields in version 1, ten in version 2, the last
the length of what follows) and so many bytes.  ``read_arc`` parses them by
these declared lengths; ``convert`` writes each ARC file as a WARC file, with
what ARC doesn't have made from what it has: identifiers from the file and the
record's number, timestamps from 14 digits, types from the content, SHA-1
digests of blocks and payloads.  A payload that is there before is written as
a revisit of one record.

Archives are gzip files with a member a record.  Spark's own readers and
writers do all input and output, so any store will do: a file is read as one
row (binaryFile), and a volume of some VOLUME_BYTES is written as one row, by
the text writer.  The separator that it puts after a row is the zero byte that
ends a gzip member of less than 16 MiB, which the row leaves out.

Digests are grouped before records are joined with what they revisit; payloads
that over a thousandth of all records share are broadcast, so no group of
copies meets in one task.  Payloads themselves aren't shuffled, only archives
and the list of a file's revisits; where those are few, nothing is.

Defined cases: a null text is an empty payload; a null URL is ``unknown:``, and
white space and control characters of a URL are percent-encoded; a null id
isn't written and reads as null, and it comes before all others when the
largest is looked for; of repeated rows with the largest id the one that is
last by file and number stays a response; texts of any length make one record,
in a volume of its own if it is large; an empty table gives no archive; other
columns aren't looked at.  On reading, lines that aren't headers are skipped,
a record that ends early keeps what is there and is marked as truncated, and
times that aren't dates read as 1970.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.spark_tools import HOT, join_hot, materialize, shared_dir

#: Bytes of records after which a volume is full.
VOLUME_BYTES = 16 << 20
#: Revisits whose lists are broadcast (some 50 MB).
BROADCAST_REVISITS = 200_000
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000

#: The header fields of both versions of ARC, as a file's first record spells them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ADDRESS = "0.0.0.0"
NO_DATE = "1970-01-01T00:00:00Z"
PAGE_HEADER = "X-Page-Id"

ARC_RECORD = (
    "file string, number long, version int, url string, ip string, date string, type string, status int, truncated boolean, "
    "page_id long, record_id string, payload_bytes long, payload_digest string"
)
WARC_RECORD = "file string, record_type string, record_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


# -- bytes -------------------------------------------------------------------

def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def closed(members: list[bytes]) -> bytes:
    """A volume without its last byte, which is zero and the writer's."""
    out = b"".join(members)
    return (out if out.endswith(b"\0") else out + member(b""))[:-1]


def opened(content: bytes) -> BinaryIO:
    """A stream over a file, compressed or not; only what is read is inflated."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload); no headers for
    a block that isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _page(head: bytes) -> int | None:
    value = http_field(head, PAGE_HEADER)
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) else None


def iso_date(digits: str) -> str:
    """YYYYMMDDhhmmss (or a beginning of it, from the day on) in ISO 8601."""
    try:
        return datetime.strptime(digits[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if len(digits) >= 8 else NO_DATE
    except ValueError:
        return NO_DATE


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def labelled(digest: str) -> str:
    """A digest as archives spell it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def plain(label: str) -> str:
    """Lower-case hex of a labelled SHA-1, in base 32 or hex."""
    value = label.partition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record_id(file: str, number: int) -> str:
    """The same for the same record of the same file, whenever it is converted."""
    name = f"{file.rsplit('/', 1)[-1]}#{number}"
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}"


# -- ARC ---------------------------------------------------------------------

def arc_line(version: int, url: str, date: str, kind: str, length: int, status: int, offset: int, name: str, ip: str = NO_ADDRESS) -> bytes:
    between = [] if version == 1 else [str(status), "-", "-", str(offset), name]
    return " ".join([url, ip, date, kind, *between, str(length)]).encode() + b"\n"


def _encoded(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url) if url else "unknown:"


def pages_to_volumes(version: int, date: str, volume_bytes: int):
    """Arrow batches of (page_id, url, html) to volumes, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size, count = [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([closed(members)], pa.binary())], ["value"])
        for batch in batches:
            for page_id, url, html in zip(*[batch.column(c) for c in ("page_id", "url", "html")], strict=True):
                payload = (html.as_py() or "").encode()
                name = f"volume-{count}.arc.gz"
                if not members:
                    body = f"{version} 0 pathloom\n{FIELDS[version]}\n".encode()
                    first = arc_line(version, f"filedesc://{name}", date, "text/plain", len(body), 200, 0, name) + body + b"\n"
                    members, size = [member(first)], len(first)
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                head += [f"{PAGE_HEADER}: {page_id.as_py()}"] if page_id.is_valid else []
                block = "\r\n".join([*head, "", ""]).encode() + payload
                record = arc_line(version, _encoded(url.as_py()), date, "text/html", len(block), 200, size, name) + block + b"\n"
                members.append(member(record))
                size += len(record)
                if size >= volume_bytes:
                    yield row()
                    members, size, count = [], 0, count + 1
        if members:
            yield row()

    return pack


def write_volumes(volumes: DataFrame, path: str) -> str:
    """Each row's bytes, and a zero byte, as a file of its own."""
    text = volumes.select(F.col("value").cast("string"))
    text.write.mode("append").option("maxRecordsPerFile", 1).option("lineSep", "\u0000").option("compression", "none").text(path)
    return path


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000", volume_bytes: int = VOLUME_BYTES) -> str:
    """Pages (page_id, url, html) as ARC files in a folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return write_volumes(rows.mapInArrow(pages_to_volumes(version, date, volume_bytes), "value binary"), path)


def arc_records(stream: BinaryIO) -> Iterator[dict]:
    """number, version, url, ip, date, type, status, block, truncated; the
    ``filedesc:`` record sets the version of those after it and has number 0."""
    version, number = 1, 0
    while line := stream.readline():
        fields = [f.lower() for f in FIELDS[version].split()]
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if line.startswith(b"filedesc:"):
            parts = line.split()  # version 2 has fields in between
            parts = [x.decode("utf-8", "replace") for x in (*parts[:4], parts[-1])]
            fields = [f.lower() for f in FIELDS[1].split()]
        if len(parts) != len(fields) or not parts[0] or not re.fullmatch(r"\d+", parts[2]) or not re.fullmatch(r"\d{1,18}", parts[-1]):
            continue
        got = dict(zip(fields, parts, strict=True))
        length = int(got["archive-length"])
        block = stream.read(length)
        if line.startswith(b"filedesc:"):
            said = block[:1]
            version = int(said) if said in (b"1", b"2") else 1
        else:
            number += 1
        status = got.get("result-code", "")
        if not status.isdigit() and (found := re.match(rb"HTTP/\S+ +(\d{3})", block)):
            status = found[1].decode()
        yield {
            "number": 0 if line.startswith(b"filedesc:") else number,
            "version": version, "url": got["url"], "ip": got["ip-address"], "date": iso_date(got["archive-date"]), "type": got["content-type"],
            "status": int(status) if status.isdigit() and len(status) < 9 else None, "block": block, "truncated": len(block) < length,
        }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select(F.col("path").alias("file"), "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC_RECORD of all records in a folder, payloads only measured."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _ARROW[k]) for n, k in (c.split() for c in ARC_RECORD.split(", "))])
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                rows, name = [], file.as_py()
                for r in arc_records(opened(content.as_py())):
                    if not r["number"]:
                        continue
                    head, payload = http_parts(r.pop("block"))
                    rows.append(r | {"file": name, "page_id": _page(head), "record_id": record_id(name, r["number"]), "payload_bytes": len(payload), "payload_digest": sha1(payload)})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).mapInArrow(parse, ARC_RECORD)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


# -- WARC --------------------------------------------------------------------

def revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """file, number, refers_to_id, refers_to_url, refers_to_date of records whose payload of
    at least so many bytes another record has, with a larger (page_id, file, number).
    ``records`` should be a table: it is read more than once."""
    total = records.count()
    large = records.where(F.col("payload_bytes") >= least)
    place = F.struct("page_id", "file", "number", F.col("record_id").alias("refers_to_id"), F.col("url").alias("refers_to_url"), F.col("date").alias("refers_to_date"))
    groups = large.groupBy("payload_digest").agg(F.max(place).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = groups.where(F.col("n") > total // HOT).select("payload_digest")
    met = join_hot(large.select("file", "number", "record_id", "payload_digest"), "payload_digest", groups.select("payload_digest", "kept"), "payload_digest", hot, F.col("record_id"))
    others = met.where(F.col("kept").isNotNull() & (F.col("kept.refers_to_id") != F.col("record_id")))
    return others.select("file", "number", *[f"kept.{c}" for c in ("refers_to_id", "refers_to_url", "refers_to_date")])


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def as_warc(file: str, r: dict, revisit: dict | None) -> bytes:
    """The WARC record of an ARC record, which may revisit another one."""
    head, payload = http_parts(r["block"])
    fields: dict[str, str | None] = {"WARC-Type": "response" if head else "resource", "WARC-Target-URI": r["url"], "WARC-Date": r["date"]}
    fields |= {"WARC-Record-ID": f"<{record_id(file, r['number'])}>", "WARC-IP-Address": r["ip"] if r["ip"] != NO_ADDRESS else None}
    fields["Content-Type"] = "application/http; msgtype=response" if head else r["type"]
    fields["WARC-Payload-Digest"] = labelled(sha1(payload))
    fields["WARC-Truncated"] = "unspecified" if r["truncated"] else None
    block = r["block"]
    if revisit:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{revisit['refers_to_id']}>"}
        fields |= {"WARC-Refers-To-Target-URI": revisit["refers_to_url"], "WARC-Refers-To-Date": revisit["refers_to_date"]}
        block = head
    return warc_record(fields | {"WARC-Block-Digest": labelled(sha1(block))}, block)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> str:
    """Each ARC file in a folder as a WARC file in another one."""
    records = materialize(read_arc(spark, arc_path), "arc-records")
    fields = [c for c in ("number", "refers_to_id", "refers_to_url", "refers_to_date")]
    again = materialize(revisits(records, least), "arc-revisits")
    lists = again.groupBy("file").agg(F.collect_list(F.struct(*fields)).alias("revisits"))  # of one file
    # Few enough are broadcast, so that archives aren't shuffled; with more, archives meet their lists in a shuffle.
    lists = F.broadcast(lists) if again.count() <= BROADCAST_REVISITS else lists

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, found in zip(*[batch.column(c) for c in ("file", "content", "revisits")], strict=True):
                name, at = file.as_py(), {x["number"]: x for x in found.as_py() or ()}
                members = []
                for r in arc_records(opened(content.as_py())):
                    if r["number"]:
                        members.append(member(as_warc(name, r, at.get(r["number"]))))
                        continue
                    about = f"software: pathloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {r['url']}\r\n".encode()
                    fields = {"WARC-Type": "warcinfo", "WARC-Date": r["date"], "WARC-Record-ID": f"<{record_id(name, 0)}>", "Content-Type": "application/warc-fields"}
                    members.append(member(warc_record(fields, about)))
                if members:
                    yield pa.RecordBatch.from_arrays([pa.array([closed(members)], pa.binary())], ["value"])

    return write_volumes(_files(spark, arc_path).join(lists, "file", "left").mapInArrow(pack, "value binary"), warc_path)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block)."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_RECORD of responses, resources and revisits in a folder.  Digests are
    worked out from payloads and held against those in the archive; a revisit's
    is the archive's, and its size isn't known here."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _ARROW[k]) for n, k in (c.split() for c in WARC_RECORD.split(", "))])
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                rows, name = [], file.as_py()
                for fields, block in warc_records(opened(content.as_py())):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    said = fields.get("warc-payload-digest")
                    digest = plain(said) if kind == "revisit" and said else sha1(payload)
                    if said and plain(said) != digest:
                        raise ValueError(f"{name}: the payload of {fields.get('warc-record-id')} has another digest than the archive says")
                    to = fields.get("warc-refers-to")
                    rows.append({
                        "file": name, "record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
                        "page_id": _page(head), "payload_bytes": None if kind == "revisit" else len(payload), "payload_digest": digest, "refers_to_id": to.strip("<>") if to else None,
                    })
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).mapInArrow(parse, WARC_RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` (a table) with refers_to, the page of the record that a
    revisit refers to, whose payload's size it takes."""
    total = records.count()
    targets = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    hot = records.where("refers_to_id is not null").groupBy("refers_to_id").count().where(F.col("count") > total // HOT).select("refers_to_id")
    met = join_hot(records, "refers_to_id", targets, "target", hot, F.col("record_id"))
    return met.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in ARC files (even ids in version 1, others in version 2),
    converted to WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    run = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    even: Column = F.coalesce(F.col("page_id") % 2 == 0, F.lit(True))
    write_arc(pages.where(even), f"{run}/arc", 1)
    write_arc(pages.where(~even), f"{run}/arc", 2)
    read = materialize(read_warc(spark, convert(spark, f"{run}/arc", f"{run}/warc")), "warc-records")
    return resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT row_number() OVER () AS i, page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT i, page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, first_value(i) OVER w AS first, first_value(page_id) OVER w AS top FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, i))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN i = first OR payload_bytes < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN i <> first AND payload_bytes >= 1000 THEN top END AS refers_to FROM k
"""
