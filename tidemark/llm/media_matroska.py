"""Matroska media columns: files are written to and read from binary columns, and parsed into packet tables.

The parser walks variable-length EBML elements: segment, info, tracks, clusters with
simple blocks and block groups, and cues. A block's frames are split by its lacing (none,
Xiph, fixed-size or EBML). Every frame is one packet: track, timestamp in milliseconds,
keyframe flag, lacing, and its byte range in the file. Elements of unknown size end where
an element of their parents' kind begins. Elements of no interest are skipped, files that
break off give the packets up to there, and what is no Matroska gives none.

The writer stores a payload as unsigned 8-bit PCM samples (its bytes, unchanged) in one
audio track: frames of 512 samples, eight to a block with fixed-size lacing, the last
block with EBML or (in clusters of odd number) Xiph lacing, clusters of 16 blocks, and a
cue for each cluster. It uses no clock and no random ids, so equal payloads give equal
files.

``features`` stores the files as a table in the shared folder, parses the stored bytes into
a packet table (an array of packets for each file, with the energy and zero crossings of
the samples in each byte range), and seeks every cue: the cluster it points at, parsed by
itself, must give the packets of that time. What it tells is summed up from the packets.

Null texts count as empty; empty texts are stored as 64 zero bytes. Null media have no
packets. Repeated rows, null ids and further columns need nothing special, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import written

# Element ids of the Matroska format.
EBML, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
LACED, AUDIO, RATE, CHANNELS, DEPTH = 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, BLOCK_TIME, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_POS = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

SAMPLES, LACE, BLOCKS, HZ = 512, 8, 16, 8000
FRAME_MS = SAMPLES * 1000 // HZ


def vint(n: int, width: int = 0) -> bytes:
    """A size: the number of leading zero bits tells the width."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The frames of a block, behind the table of their sizes."""
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
            head += vint(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def block(track: int, at: int, frames: list[bytes], lacing: int, flags: int) -> bytes:
    return vint(track) + struct.pack(">hB", at, flags | lacing << 1) + laced(frames, lacing)


def muxed(payload: bytes) -> bytes:
    frames = [payload[i : i + SAMPLES] for i in range(0, len(payload), SAMPLES)]
    head = element(EBML, element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(FRAME_NS, FRAME_MS * 1_000_000) + uint(LACED, 1) + audio
    info = uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / HZ)) + element(MUXER, b"tidemark") + element(WRITER, b"tidemark")
    body, cues = [element(INFO, info), element(TRACKS, element(TRACK, track))], []
    pos, per = sum(map(len, body)), LACE * BLOCKS
    for c in range(0, len(frames), per):
        t = c * FRAME_MS
        parts = [uint(TIME, t)]
        for b in range(c, min(c + per, len(frames)), LACE):
            some = frames[b : b + LACE]
            if len(some) == LACE and len(some[-1]) == SAMPLES:
                parts.append(element(SIMPLE, block(1, (b - c) * FRAME_MS, some, FIXED, 0x80)))
            else:
                lacing = (XIPH if c // per % 2 else EBML_LACE) if len(some) > 1 else NO_LACE
                parts.append(element(GROUP, element(BLOCK, block(1, (b - c) * FRAME_MS, some, lacing, 0)) + uint(BLOCK_TIME, len(some) * FRAME_MS)))
        cues.append(element(CUE, uint(CUE_TIME, t) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_POS, pos))))
        body.append(element(CLUSTER, b"".join(parts)))
        pos += len(body[-1])
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds. packets: track, ms, keyframe, lacing, offset, size. cues: ms, track, offset of the cluster in the file."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0
    duration_ms: float = 0.0
    scale: int = 1_000_000


def read_vint(b: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A number and where it ends; -1 for an unknown size. keep: with the width mark, as in ids."""
    first = b[at]
    w = 9 - first.bit_length()
    if w > 8 or at + w > len(b):
        raise ValueError("no variable-length number")
    n = int.from_bytes(b[at : at + w], "big")
    if keep:
        return n, at + w
    n &= (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def lace_sizes(b: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if lacing == NO_LACE:
        return [end - at], at
    n, at = b[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("frames of unequal size in a fixed-size lace")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + b[at], at + 1
        else:
            start = at
            size, at = read_vint(b, at)
            if k:
                size += sizes[-1] - (1 << 7 * (at - start) - 1) + 1
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise ValueError("a lace beyond its block")
    return [*sizes, rest], at


def parsed(b: bytes) -> Media:
    """The packets, tracks and cues of a Matroska file, up to where it is whole."""
    m = Media()
    try:
        if read_vint(b, 0, True)[0] == EBML:
            _walk(b, 0, m)
    except (IndexError, ValueError, struct.error):
        pass
    return m


def sought(b: bytes, m: Media, ms: int) -> Media:
    """The cluster at which the last cue at or before ms points, parsed by itself; nothing is read before it."""
    here = Media(tracks=m.tracks, scale=m.scale)
    cues = [c for c in m.cues if c[0] <= ms]
    try:
        if cues and read_vint(b, max(cues)[2], True)[0] == CLUSTER:
            _walk(b, max(cues)[2], here, one=True)
    except (IndexError, ValueError, struct.error):
        pass
    return here


def _walk(b: bytes, at: int, m: Media, one: bool = False) -> None:
    """Takes in elements from a place on; with ``one`` until the first is closed."""
    scale, now, base, start = m.scale, 0, 0, at
    open_: list[tuple[int, int, dict]] = []  # element, its end (or -1), its values
    values = {}
    while at < len(b) or open_:
        while open_ and open_[-1][1] >= 0 and at >= open_[-1][1]:
            kind, _, values = open_.pop()
            _closed(m, kind, values, base)
        if one and at > start and not open_:
            break
        if at >= len(b):
            if not open_ or open_[-1][1] >= 0:
                break
            kind, _, values = open_.pop()
            _closed(m, kind, values, base)
            continue
        kind, data = read_vint(b, at, True)
        size, data = read_vint(b, data)
        while open_ and open_[-1][1] < 0 and open_[-1][0] != SEGMENT and kind in TOP:
            k, _, values = open_.pop()
            _closed(m, k, values, base)
        if one and at > start and not open_:
            break
        end = data + size if size >= 0 else -1
        if end > len(b) and kind not in PARENTS:
            break
        values = open_[-1][2] if open_ else {}
        if kind in PARENTS:
            if kind == SEGMENT:
                base = data
            elif kind == CLUSTER:
                m.clusters += 1
            open_.append((kind, end, {"up": values, "scale": scale}))
            at = data
            continue
        if kind in (SIMPLE, BLOCK):
            track, p = read_vint(b, data)
            delta, flags = struct.unpack_from(">hB", b, p)
            lacing = flags >> 1 & 3
            sizes, p = lace_sizes(b, p + 3, end, lacing)
            t = (now + delta) * scale / 1e6
            step = m.tracks.get(track, {}).get("frame_ns", 0) / 1e6
            first = len(m.packets)
            for k, n in enumerate(sizes):
                m.packets.append((track, int(t + k * step), flags >> 7 == 1, lacing, p, n))
                p += n
            m.blocks += 1
            values["packets"] = (first, kind)
        elif kind == TIME:
            now = int.from_bytes(b[data:end], "big")
        elif kind == SCALE:
            scale = m.scale = int.from_bytes(b[data:end], "big")
        elif kind == DURATION:
            m.duration_ms = struct.unpack(">d" if size == 8 else ">f", b[data:end])[0] * scale / 1e6
        elif kind == RATE:
            values["up"][kind] = struct.unpack(">d" if size == 8 else ">f", b[data:end])[0]
        elif kind == CODEC:
            values[kind] = b[data:end].decode("latin-1")
        elif kind in (NUMBER, KIND, FRAME_NS, CUE_TIME, CUE_TRACK, CUE_POS):
            values[kind] = int.from_bytes(b[data:end], "big")
        elif kind == REFERENCE:
            values["reference"] = True
        at = end


def _closed(m: Media, kind: int, v: dict, base: int) -> None:
    if kind == TRACK:
        m.tracks[v.get(NUMBER, 0)] = {"kind": v.get(KIND), "codec": v.get(CODEC), "frame_ns": v.get(FRAME_NS, 0), "rate": v.get(RATE)}
    elif kind == GROUP and "packets" in v:  # a group's block is a keyframe if it refers to none
        first = v["packets"][0]
        m.packets[first:] = [(*p[:2], "reference" not in v, *p[3:]) for p in m.packets[first:]]
    elif kind == CUE_AT:
        m.cues.append((int(v["up"].get(CUE_TIME, 0) * v["scale"] / 1e6), v.get(CUE_TRACK, 0), base + v.get(CUE_POS, 0)))


def payload(b: bytes, m: Media) -> bytes:
    """The frames of all packets, in order, by their byte ranges."""
    return b"".join([b[p[4] : p[4] + p[5]] for p in m.packets])


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def with_media(docs: DataFrame, to: str = "media") -> DataFrame:
    """docs with the text as a Matroska file in a binary column."""

    @F.pandas_udf("binary")
    def mux(text):
        return text.map(lambda t: muxed(padded(t)))

    return docs.withColumn(to, mux("text"))


PACKET = "struct<track:int,ms:long,keyframe:boolean,lacing:int,offset:long,size:long,energy:long,crossings:long>"


def measured(b: bytes, m: Media) -> list[tuple]:
    """The packets with the energy (squares of samples about the middle) and zero crossings of their bytes."""
    if not m.packets:
        return []
    samples = np.frombuffer(payload(b, m), np.uint8).astype(np.int64) - 128
    ends = np.cumsum([p[5] for p in m.packets])
    energy = np.append(0, np.cumsum(samples * samples))
    sign = samples >= 0
    cross = np.append(0, np.cumsum(np.append(False, sign[1:] != sign[:-1])))  # a crossing counts where it arrives
    starts = ends - [p[5] for p in m.packets]
    return [(*p, int(e), int(c)) for p, e, c in zip(m.packets, energy[ends] - energy[starts], cross[ends] - cross[starts], strict=True)]


def with_packets(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the column media replaced by what its files hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, clusters, duration_ms, packets, cues, and sought: the cues that lead to the packets of their time."""
    kept = [f for f in df.schema.fields if f.name != media]
    made = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, clusters long, duration_ms double, packets array<{PACKET}>, cues array<struct<ms:long,track:int,offset:long>>, sought long"
    made = StructType.fromDDL(made)

    def told(raw: bytes) -> tuple:
        m = parsed(raw)
        back = payload(raw, m)
        packets = measured(raw, m)
        sums = hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:])
        hit, first = 0, 0
        for ms, _, at in sorted(m.cues):
            there = sought(raw, m, ms).packets
            while first < len(packets) and packets[first][4] < at:
                first += 1
            hit += bool(there) and there[0][1] == ms and there == m.packets[first : first + len(there)]
        codec = ",".join(str(m.tracks[k]["codec"]) for k in sorted(m.tracks))
        return (len(back), *sums, len(raw), hashlib.sha256(raw).hexdigest(), codec, m.clusters, m.duration_ms, [dict(zip(named, p, strict=True)) for p in packets], [dict(zip(("ms", "track", "offset"), c, strict=True)) for c in m.cues], hit)

    def run(batches):
        for b in batches:
            raws = b.column(media)
            for k in range(0, b.num_rows, 64):  # packets of few files at a time
                part = b.slice(k, 64)
                cols = list(zip(*[told(x.as_py()) if x.is_valid else (None,) * len(types) for x in raws[k : k + 64]], strict=True))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [f.name for f in kept] + made.names)

    packet = pa.struct([("track", pa.int32()), ("ms", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("energy", pa.int64()), ("crossings", pa.int64())])
    cue = pa.struct([("ms", pa.int64()), ("track", pa.int32()), ("offset", pa.int64())])
    named = [packet.field(i).name for i in range(packet.num_fields)]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(packet), pa.list_(cue), pa.int64()]
    return df.mapInArrow(run, StructType(kept + made.fields))


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet: key, n, and the packet's track, ms, keyframe, lacing, offset, size, energy, crossings."""
    return with_packets(df.select(key, media), media).select(key, F.posexplode("packets").alias("n", "_p")).select(key, F.col("n").cast("long").alias("n"), "_p.*")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row, as a table in the shared folder."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return written(with_media(docs.select("doc_id", n, "text")).drop("text"), "media")


def features(docs: DataFrame) -> DataFrame:
    """Every text stored as media, and what the packets of the stored files say of it."""
    df = with_packets(stored(docs))

    def total(of, when=None) -> Column:
        some = F.filter("packets", when) if when else F.col("packets")
        return F.aggregate(some, F.lit(0).cast("long"), lambda n, p: n + of(p))

    one = F.lit(1).cast("long")
    loudest = F.array_max(F.transform("packets", lambda p: F.struct((p["energy"] / F.greatest(p["size"], one)).alias("mean"), (-p["offset"]).alias("first"), p["ms"].alias("ms"))))
    what = {
        "codec": "codec",
        "packets": F.size("packets"),
        "clusters": "clusters",
        "cues": F.size("cues"),
        "sought": "sought",
        "laced": F.concat_ws("/", *[total(lambda p: one, lambda p, k=k: p["lacing"] == k) for k in range(4)]),
        "last_ms": F.array_max(F.col("packets.ms")),
        "duration_ms": F.col("duration_ms").cast("long"),
        "energy": total(lambda p: p["energy"]),
        "crossings": total(lambda p: p["crossings"]),
        "loudest_ms": loudest["ms"],
    }
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("0"))) for k, c in what.items()])
    return df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
