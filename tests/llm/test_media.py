import hashlib
import random
import struct
import zlib

import pytest

from tidemark.llm import media_matroska as M

from .helpers import rows

SCHEMA = "doc_id long, text string, media string, track int, n int"


def test_round_trip_of_many_lengths():
    rng = random.Random(1)
    for n in [64, 512, 576, 4096, 4160, 8192, 65_536, 65_600, 70_016, 300_032]:
        raw = rng.randbytes(n)
        media = M.muxed(raw)
        m = M.parsed(media)
        assert M.payload(media, m) == raw
        assert [p[1] for p in m.packets] == [k * M.FRAME_MS for k in range(len(m.packets))]
        assert all(p[2] for p in m.packets)
        for ms, track, offset in m.cues:
            assert media[offset : offset + 4] == M.CLUSTER.to_bytes(4, "big") and track == 1
        assert len(m.cues) == m.clusters
        assert m.duration_ms == n / 8


@pytest.mark.parametrize("lacing", [M.XIPH, M.EBML_LACE])
def test_lacing(lacing):
    rng = random.Random(2)
    for _ in range(200):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 127, 254, 255, 256, 510, 9000, 70_000])) for _ in range(rng.randint(2, 9))]
        b = M.laced(frames, lacing)
        sizes, at = M.lace_sizes(b, 0, len(b), lacing)
        assert sizes == [len(f) for f in frames]
        assert b[at:] == b"".join(frames)


def two_tracks(unknown):
    def master(kind, data):
        return kind.to_bytes(4, "big") + (b"\xff" if unknown else M.vint(len(data))) + data

    tracks = b"".join(M.element(M.TRACK, M.uint(M.NUMBER, k) + M.element(M.CODEC, c)) for k, c in ((1, b"V_X"), (2, b"S_TEXT")))
    one = M.uint(M.TIME, 100) + M.element(M.SIMPLE, M.block(1, 5, [b"key"], M.NO_LACE, 0x80)) + M.element(M.GROUP, M.element(M.BLOCK, M.block(2, -3, [b"hello"], M.NO_LACE, 0)) + M.element(M.REFERENCE, b"\x01"))
    two = M.uint(M.TIME, 300) + M.element(0xEC, b"void") + M.element(M.SIMPLE, M.block(1, 0, [b"ab", b"cd"], M.FIXED, 0))
    body = M.element(M.INFO, M.uint(M.SCALE, 2_000_000)) + M.element(M.TRACKS, tracks) + master(M.CLUSTER, one) + master(M.CLUSTER, two)
    return M.element(M.EBML, b"") + master(M.SEGMENT, body)


@pytest.mark.parametrize("unknown", [False, True])
def test_tracks_groups_and_unknown_sizes(unknown):
    b = two_tracks(unknown)
    m = M.parsed(b)
    assert [(p[0], p[1], p[2], b[p[4] : p[4] + p[5]]) for p in m.packets] == [(1, 210, True, b"key"), (2, 194, False, b"hello"), (1, 600, False, b"ab"), (1, 600, False, b"cd")]
    assert m.clusters == 2 and m.tracks[2]["codec"] == "S_TEXT"


def test_cues_are_sought():
    b = M.muxed(random.Random(4).randbytes(300_032))
    m = M.parsed(b)
    for ms in (0, 1, 8192, 20_000, 10**9):
        there = M.sought(b, m, ms).packets
        at = max(c[0] for c in m.cues if c[0] <= ms)
        assert there == [p for p in m.packets if at <= p[1] < at + M.LACE * M.BLOCKS * M.FRAME_MS]
    assert M.sought(b[:5000], m, 10**9).packets == [] and M.sought(b, M.Media(), 5).packets == []
    lacings = {p[3] for p in m.packets}
    assert M.EBML_LACE in lacings or M.XIPH in lacings


def test_null_media_and_tables_of_packets(spark):
    rows_ = [(1, None, 5), (2, b"no media", 6), (3, bytes(M.muxed(bytes(128))), 7)]
    df = spark.createDataFrame(rows_, "doc_id long, media binary, size int")
    got = {r["doc_id"]: r for r in rows(M.with_packets(df))}
    assert got[1]["packets"] is None and got[2]["packets"] == [] and got[3]["payload_bytes"] == 128 and got[3]["size"] == 7
    assert M.packet_table(df).count() == 1


def test_broken_files():
    b = M.muxed(bytes(range(256)) * 64)
    whole = M.parsed(b).packets
    for cut in range(0, len(b), 97):
        got = M.parsed(b[:cut]).packets
        assert got == whole[: len(got)]
    assert M.parsed(b"").packets == [] and M.parsed(b"RIFF....").packets == []
    rng = random.Random(3)
    for _ in range(300):
        bad = bytearray(b[:2000])
        bad[rng.randrange(2000)] = rng.randrange(256)
        M.parsed(bytes(bad))


def test_features_and_packets(spark):
    data = [(1, "a" * 64, "x", 1, 1), (2, None, "x", 1, 1), (3, "", "x", 1, 1), (4, "é" * 40, "x", 1, 1), (5, "long " * 40_000, "x", 1, 1), (None, "z", None, None, None), (1, "a" * 64, "x", 1, 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = rows(M.features(df))
    assert len(got) == len(data)
    texts = {r[0]: r[1] for r in data}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pay))
        assert r["payload_sha256"] == hashlib.sha256(pay).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(pay[-64:])
        assert r["media_sha256"] == hashlib.sha256(M.muxed(pay)).hexdigest()
        frames = [pay[k : k + M.SAMPLES] for k in range(0, len(pay), M.SAMPLES)]
        told = dict(x.split("=") for x in r["feature"].split(";"))
        signs = [x >= 128 for x in pay]
        assert int(told["energy"]) == sum((x - 128) ** 2 for x in pay)
        assert int(told["crossings"]) == sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        assert int(told["packets"]) == len(frames) and told["sought"] == told["cues"] == told["clusters"]
        mean = [sum((x - 128) ** 2 for x in f) / len(f) for f in frames]
        assert int(told["loudest_ms"]) == mean.index(max(mean)) * M.FRAME_MS
    media = M.with_media(df.drop("media", "track", "n"))
    table = M.packet_table(media)
    assert table.where("doc_id = 1").count() == 2
    assert table.where("doc_id = 5").agg({"size": "sum"}).first()[0] == 200_000
    assert M.features(df.limit(0)).count() == 0
    assert M.packet_table(media.limit(0)).count() == 0
    assert struct.calcsize(">hB") == 3
