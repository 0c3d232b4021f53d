"""WARC archives: written as monolithic gzip streams, normalised to a member per record with an offset index, and read back.

Records with equal payloads are stored once: the one with the smallest page id is a
response, the others are revisits that refer to it. What is shuffled for that are ids and
digests; the digests of repeated payloads then meet the pages by broadcast, if there are few
enough, else by a join that deals heavy payloads out. An archive is first written as one
gzip stream over all its records. The normaliser inflates such a stream once, from front
to back, cuts it into records by their Content-Length, rewrites every record as a gzip
member of its own, and lists each member's offset and length beside it. The reader seeks
members by that index, inflates them one by one and checks the payload digests.

Archives are rows of a table in the shared folder: name, content, and (normalised) the
index. They are cut at ``ARCHIVE_BYTES`` of records, so that a task holds one at a time,
however long its partition is; a record alone may be longer.

Null and empty html is an empty payload, deduplicated like any other. A null page id is
larger than all others. Rows equal in page id and payload are all responses if their id is
the smallest. An empty table gives no archives and an empty result. Other columns are
ignored, but for the url, which may be null.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, dealt_join, written

ARCHIVE_BYTES = 8 << 20
LEVEL = 4
INDEX = "array<struct<offset:long,length:long,record_id:string,record_type:string,digest:string>>"
DATE = "2024-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, with the two line ends behind it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], int]:
    """A record's headers and where its block begins."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress(data) + z.flush()


def records(stream: bytes, step: int = 1 << 20):
    """The records of a gzip stream of one or more members, inflated once, in pieces."""
    held, z, at = bytearray(), zlib.decompressobj(wbits=31), 0
    data = stream
    while data or held:
        if data:
            held += z.decompress(data[at : at + step])
            at += step
            if z.eof:
                data, at = z.unused_data + data[at:], 0
                z = zlib.decompressobj(wbits=31)
            elif at >= len(data):
                held += z.flush()
                data = b""
        start = 0
        while (end := held.find(b"\r\n\r\n", start)) >= 0:
            head, body = headers(bytes(held[start : end + 4]))
            stop = start + body + int(head["Content-Length"]) + 4
            if stop > len(held):
                break
            yield head, bytes(held[start:stop])
            start = stop
        del held[:start]
        if not data and held:
            raise ValueError("a record breaks off")


def normalised(stream: bytes) -> tuple[bytes, list[dict]]:
    """The stream with a gzip member for each record, and the index of the members."""
    out, index, at = [], [], 0
    for head, raw in records(stream):
        member = gzip(raw)
        index.append({"offset": at, "length": len(member), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "digest": head["WARC-Payload-Digest"]})
        out.append(member)
        at += len(member)
    return b"".join(out), index


def _archives(batches):
    import pyspark

    part, made, z, size, out = pyspark.TaskContext.get().partitionId(), 0, None, 0, []
    for b in batches:
        for page, url, html, refers, revisit in zip(*[c.to_pylist() for c in b.columns], strict=True):
            z = z or zlib.compressobj(LEVEL, wbits=31)
            raw = record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers, revisit)
            out.append(z.compress(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_pydict({"name": [f"pages-{part:06d}-{made:06d}"], "content": [b"".join([*out, z.flush()])]})
                made, z, size, out = made + 1, None, 0, []
    if out:
        yield pa.RecordBatch.from_pydict({"name": [f"pages-{part:06d}-{made:06d}"], "content": [b"".join([*out, z.flush()])]})


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, revisit: the response of each payload is looked up by its digest."""
    key = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = pages.select("page_id", "url", "html", key.alias("_key"))
    first = cut(rows.groupBy("_key").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1 and _first is not null"))
    count = first.count()
    if count <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(first.drop("n")), "_key", "left")
    else:
        out = dealt_join(rows, first.drop("n"), "_key", F.monotonically_increasing_id(), "left", counts=first.select("_key", "n"))
    revisit = F.coalesce((F.col("_first") != F.col("page_id")) | (F.col("_first").isNotNull() & F.col("page_id").isNull()), F.lit(False))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def monolithic(pages: DataFrame) -> DataFrame:
    """name, content: archives of one gzip stream each, in the shared folder."""
    return written(deduplicated(pages).mapInArrow(_archives, "name string, content binary"), "warc-monolithic")


def normalise(archives: DataFrame) -> DataFrame:
    """name, content, index: the archives with a member for each record, in the shared folder."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                new, index = normalised(content.as_py())
                kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("digest", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([new], pa.binary()), pa.array([index], kind)], ["name", "content", "index"])

    return written(archives.select("name", "content").mapInArrow(run, f"name string, content binary, index {INDEX}"), "warc-normalised")


def page_number(urn: str | None) -> int | None:
    n = (urn or "")[len("<urn:page:") : -1]
    return int(n) if n else None


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record of normalised archives, sought by the index."""

    def run(batches):
        for b in batches:
            for content, index in zip(b.column(0), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                out = []
                for i in index.as_py():
                    raw = zlib.decompress(data[i["offset"] : i["offset"] + i["length"]], wbits=31)
                    head, at = headers(raw)
                    body = raw.index(b"\r\n\r\n", at) + 4
                    size = int(raw[at:body].rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = None
                    if head["WARC-Type"] == "response":
                        payload = raw[body : at + int(head["Content-Length"])]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what was written")
                    out.append((page_number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page_number(head.get("WARC-Refers-To")), payload))
                for k in range(0, len(out), 256):
                    cols = zip(*out[k : k + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return archives.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """What the normalised archives of pages say of every page."""
    return read_back(normalise(monolithic(pages))).drop("payload")
