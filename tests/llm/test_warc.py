import base64
import hashlib
import zlib

import pytest

from tidemark.llm import warc_normalise as W

from .helpers import rows

SCHEMA = "page_id long, url string, html string, content string, name string"


def brute(data):
    first = {}
    for i, _, h, *_ in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in data:
        raw = (h or "").encode()
        f = first.get(h or "")
        same = f is None or f == i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else f))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(df)), key=str)


DATA = [(1, "http://a/\r\nX: y", "<p>é</p>", "c", "n"), (2, None, "<p>é</p>", "c", "n"), (3, "u", None, "c", "n"), (4, "u", "", "c", "n"), (None, "u", "<p>é</p>", None, None), (None, "u", "lone", None, None), (5, "u", "big \r\n\r\n WARC/1.1 " * 60_000, "c", "n"), (5, "u", "twice", "c", "n"), (5, "u", "twice", "c", "n"), (9, "u", "twice", "c", "n")]


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame(DATA, SCHEMA).repartition(3)
    assert got(W.round_trip(df)) == brute(DATA)
    assert W.round_trip(df.limit(0)).count() == 0


def test_repeated_payloads_beyond_the_broadcast(spark, monkeypatch):
    data = DATA + [(100 + i, "u", "hot", "c", "n") for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    assert got(W.round_trip(df)) == brute(data)


def test_payloads_and_members(spark):
    df = spark.createDataFrame(DATA, SCHEMA).coalesce(1)
    mono = W.monolithic(df)
    for r in mono.collect():
        z = zlib.decompressobj(wbits=31)
        z.decompress(bytes(r.content))
        assert z.eof and not z.unused_data  # one member
    norm = W.normalise(mono)
    for r in norm.collect():
        content = bytes(r.content)
        assert sum(i.length for i in r["index"]) == len(content)
        for i in r["index"]:
            z = zlib.decompressobj(wbits=31)
            z.decompress(content[i.offset :])
            assert z.eof and len(content) - i.offset - len(z.unused_data) == i.length
    back = {(r.page_id, r.payload_digest): bytes(r.payload) for r in W.read_back(norm).where("record_type = 'response'").collect()}
    assert back[(5, base64.b32encode(hashlib.sha1(DATA[6][2].encode()).digest()).decode())] == DATA[6][2].encode()


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    data = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert got(W.round_trip(pages)) == brute(data)


def test_archives_of_several_members_and_broken_ones():
    a = [W.record(i, "u", b"x" * i * 1000, None, False) for i in range(1, 60)]
    stream = W.gzip(b"".join(a[:20])) + W.gzip(b"".join(a[20:]))
    for step in (7, 1000, 1 << 20):
        assert [raw for _, raw in W.records(stream, step)] == a
    with pytest.raises(ValueError):
        list(W.records(W.gzip(b"".join(a)[:-10])))
