"""Operator 9, media columns: Matroska.

``mux`` writes a payload as an 8-bit PCM track of a Matroska file: EBML header,
segment with info, tracks, clusters of laced SimpleBlocks, and cues.  ``parse``
reads any such file into a packet table (track, timestamp, byte range, key
flag, lacing, place in lace) and cue points; it handles unknown-size segments
and clusters, BlockGroups, and no, Xiph, fixed-size and EBML lacing.  Frames
of a lace follow each other by the track's default duration or their share of
the block's; without either, those after the first have no timestamp.  What is
no Matroska file becomes a row of the packet table with ``error`` set.

A text is stored as its UTF-8 bytes padded with zero bytes to a positive
multiple of 64, one byte per sample at 64,000 samples a second, so each 64-byte
frame lasts a millisecond.  Null is empty.  The file depends on the payload
only, so equal texts have equal values.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.spark_tools import documents, tidied

UNIT, FRAME, LACE, CLUSTER_MS = 64, 4096, 8, 30_000

# Element identifiers of the EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
TRACK_ENTRY, TRACK_NUMBER, CODEC_ID, DEFAULT_DURATION, TIMESTAMP_SCALE = 0xAE, 0xD7, 0x86, 0x23E383, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, TRACK_ENTRY, CUE_POINT, CUE_TRACK_POSITIONS))
LACING = ("none", "xiph", "fixed", "ebml")
#: Elements that end a segment, and a cluster, of unknown size.
_AFTER_SEGMENT = frozenset((EBML, SEGMENT))
_AFTER_CLUSTER = _AFTER_SEGMENT | {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS}


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; all ones is kept for unknown sizes."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
        if value < (1 << 7 * width) - 1:
            break
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: memoryview, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next place, unknown size)."""
    if at >= len(data):
        raise ValueError(f"nothing at {at}")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & (1 << 7 * width) - 1
    return (value if keep_marker else bare), at + width, bare == (1 << 7 * width) - 1


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: str) -> bytes:
    """The lacing head and the frames of one block."""
    body = b"".join(frames)
    if mode == "none":
        return body
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if mode == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == "ebml" and len(sizes) > 1:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < n - before < (1 << 7 * width - 1):
                width += 1
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head + body


def block(track: int, offset: int, frames: list[bytes], mode: str) -> bytes:
    flags = 0x80 | LACING.index(mode) << 1
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", offset, flags) + lace(frames, mode))


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds ``payload`` as 8-bit samples."""
    rate = UNIT * 1000
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"gaugeworks") + element(0x5741, b"gaugeworks") + element(0x4489, struct.pack(">d", len(payload) / UNIT)))
    audio = element(0xE1, element(0xB5, struct.pack(">d", float(rate))) + number(0x9F, 1) + number(0x6264, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME // UNIT * 1_000_000) + audio))
    body, cues = info + tracks, []
    per_cluster = CLUSTER_MS * UNIT
    for start in range(0, len(payload), per_cluster):
        part = payload[start : start + per_cluster]
        cluster = [number(TIMESTAMP, start // UNIT)]
        for at in range(0, len(part), FRAME * LACE):
            frames = [part[k : k + FRAME] for k in range(at, min(at + FRAME * LACE, len(part)), FRAME)]
            mode = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml" if len(frames) % 2 else "xiph"
            cluster.append(block(1, at // UNIT, frames, mode))
        cues.append(element(CUE_POINT, number(CUE_TIME, start // UNIT) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body)))))
        body += element(CLUSTER, b"".join(cluster))
    return head + element(SEGMENT, body + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp_ms: float | None
    start: int
    end: int
    key: bool
    lacing: str
    place: int


@dataclass
class Media:
    scale: int = 1_000_000
    codecs: dict[int, str] = field(default_factory=dict)
    durations: dict[int, int] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[float, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _unlace(data: memoryview, at: int, end: int, mode: str) -> list[tuple[int, int]]:
    if mode == "none":
        return [(at, end)]
    if at >= end:
        raise ValueError("a lace without a head")
    count = data[at] + 1
    at += 1
    if mode == "fixed":
        if (end - at) % count:
            raise ValueError("a fixed-size lace does not divide")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if mode == "xiph":
                n = 0
                while at < end and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= end:
                    raise ValueError("a lace is cut off")
                n, at = n + data[at], at + 1
            elif not k:
                n, at, _ = read_vint(data, at)
            else:
                begin = at
                n, at, _ = read_vint(data, at)
                n += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    spans = []
    for n in sizes:
        spans.append((at, at + n))
        at += n
    return spans


@dataclass
class _Block:
    track: int
    ticks: int
    spans: list[tuple[int, int]]
    key: bool
    mode: str
    duration: int | None = None


def parse(raw: bytes) -> Media:
    """Packet table and cues of a Matroska file; ValueError if it is none."""
    data, out = memoryview(raw), Media()
    if raw[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("no EBML header")
    blocks: list[_Block] = []
    cues: list[tuple[int, int, int]] = []
    now = dict.fromkeys(("cluster", "segment", "track", "default", "time", "cue_track", "place", "duration", "first", "referred"), 0)
    codec = ""

    def ended(ident: int) -> None:
        if ident == TRACK_ENTRY:
            out.codecs[now["track"]] = codec
            if now["default"]:
                out.durations[now["track"]] = now["default"]
        elif ident == CUE_TRACK_POSITIONS:
            cues.append((now["time"], now["cue_track"], now["segment"] + now["place"]))
        elif ident == BLOCK_GROUP:
            for block in blocks[now["first"] :]:
                block.key, block.duration = not now["referred"], now["duration"] or None

    open_ = [(0, len(data), False)]  # (element, end, unknown size)
    at = 0
    while open_:
        if at >= open_[-1][1]:
            ended(open_.pop()[0])
            continue
        here = at
        ident, at, _ = read_vint(data, at, keep_marker=True)
        while open_[-1][2] and ident in (_AFTER_SEGMENT if open_[-1][0] == SEGMENT else _AFTER_CLUSTER):
            ended(open_.pop()[0])
        size, at, unknown = read_vint(data, at)
        stop = open_[-1][1] if unknown else at + size
        if stop > open_[-1][1]:
            raise ValueError(f"element {ident:X} at {here} is cut off")
        if ident in MASTERS:
            if ident == SEGMENT:
                now["segment"] = at
            elif ident == CLUSTER:
                out.clusters.append(here)
            elif ident == TRACK_ENTRY:
                now |= {"track": 0, "default": 0}
                codec = ""
            elif ident == CUE_TRACK_POSITIONS:
                now |= {"cue_track": 0, "place": 0}
            elif ident == BLOCK_GROUP:
                now |= {"first": len(blocks), "duration": 0, "referred": 0}
            open_.append((ident, stop, unknown))
            continue
        if ident == CODEC_ID:
            codec = bytes(data[at:stop]).decode("utf-8", "replace")
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, place, _ = read_vint(data, at)
            if place + 3 > stop:
                raise ValueError(f"the block at {here} is cut off")
            offset, flags = struct.unpack(">hB", data[place : place + 3])
            mode = LACING[flags >> 1 & 3]
            blocks.append(_Block(track, now["cluster"] + offset, _unlace(data, place + 3, stop, mode), bool(flags & 0x80), mode))
        elif ident == REFERENCE:
            now["referred"] = 1
        elif stop - at <= 8 and (name := _NUMBERS.get(ident)):
            now[name] = int.from_bytes(data[at:stop], "big")
            if ident == TIMESTAMP_SCALE:
                out.scale = now[name]
        at = stop
    for b in blocks:
        start, step = b.ticks * out.scale / 1e6, out.durations.get(b.track, 0) / 1e6
        if b.duration is not None:
            step = b.duration * out.scale / 1e6 / len(b.spans)
        for k, (x, y) in enumerate(b.spans):
            out.packets.append(Packet(b.track, start + k * step if step or not k else None, x, y, b.key, b.mode, k))
    out.cues = [(time * out.scale / 1e6, track, place) for time, track, place in cues]
    return out


_NUMBERS = {
    TIMESTAMP: "cluster", TIMESTAMP_SCALE: "scale", TRACK_NUMBER: "track", DEFAULT_DURATION: "default", CUE_TIME: "time", CUE_TRACK: "cue_track", CUE_CLUSTER: "place", BLOCK_DURATION: "duration"
}


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


PACKETS = "doc_id long, track int, timestamp_ms double, start long, end long, key boolean, lacing string, place int, error string"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): a Matroska file for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                files = [mux(pad((x.as_py() or "").encode())) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, media binary")


def packet_table(files: DataFrame) -> DataFrame:
    """(doc_id, packet columns, error) of files(doc_id, media); a null file has no row."""
    names = [x.split()[0] for x in PACKETS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, item in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                try:
                    rows = [(doc_id, *vars(p).values(), None) for p in parse(item.as_py()).packets] if item.is_valid else []
                except ValueError as e:
                    rows = [(doc_id, *[None] * 7, str(e))]
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(tidied(run), PACKETS)


def digest(files: DataFrame) -> DataFrame:
    """The payload read back from files(doc_id, media, n_bytes), and features of the packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n_bytes, item in zip(batch.column("n_bytes").to_pylist(), batch.column("media")):
                raw = item.as_py()
                media = parse(raw)
                payload = b"".join(raw[p.start : p.end] for p in media.packets)
                modes = ",".join(sorted({p.lacing for p in media.packets}))
                feature = f"codec={media.codecs.get(1, '')};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={modes};ms={len(payload) // UNIT};mean={sum(payload) / len(payload):.6f}"
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            if rows:
                columns = [pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), RESULT)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raws = [x.as_py().encode() for x in part.column("text")]
                files = [mux(pad(raw)) for raw in raws]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return digest(docs.mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary"))
