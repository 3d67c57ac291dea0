"""Media columns: bytes kept as a PCM track in Matroska, and a parser that turns Matroska into packet tables.

The parser walks variable-length EBML elements (known and unknown sizes), reads the track table, clusters, simple
blocks and block groups with all three kinds of lacing, and cues. It lists packets with their track, timestamp and
byte range; nothing but element heads and lace sizes is copied.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from calibra.llm.common import documents, map_arrow, slices

# Element identifiers of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VERSIONS = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8))
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285

FRAME, LACED, BLOCKS = 576, 8, 64  # bytes a frame, frames a block, blocks a cluster at most
LATEST = (1 << 15) - 1  # a block's time from its cluster's is a signed 16-bit number
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PACKET_SCHEMA = "doc_id long, packet long, track long, timestamp long, keyframe boolean, cluster_at long, byte_start long, byte_length long"


def vint(value: int, width: int | None = None) -> bytes:
    """An EBML size of the least width that doesn't read as 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | value).to_bytes(width, "big")


def element(ident: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def store(payload: bytes, rate: int = 8000) -> bytes:
    """A Matroska file with ``payload`` as 8-bit mono samples: frames of 576, fixed-size lacing, clusters and cues."""
    head = element(EBML, b"".join(element(i, v) for i, v in VERSIONS) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    audio = element(SAMPLING, struct.pack(">d", rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)
    track = element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, audio))
    parts = [element(INFO, element(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    frame_ms = FRAME * 1000 // rate
    n = len(payload) // FRAME
    span = LACED * min(BLOCKS, LATEST // (LACED * frame_ms) + 1)  # frames a cluster
    for c in range(0, n, span):
        body = [element(CLUSTER_TIME, c * frame_ms)]
        for b in range(c, min(n, c + span), LACED):
            k = min(LACED, n - b)
            flags = 0x80 | (0x04 if k > 1 else 0)
            head_of_block = vint(1) + struct.pack(">hB", (b - c) * frame_ms, flags) + (bytes([k - 1]) if k > 1 else b"")
            body.append(element(SIMPLE_BLOCK, head_of_block + payload[b * FRAME : (b + k) * FRAME]))
        cues.append((c * frame_ms, at))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(element(CUE_POINT, element(CUE_TIME, t) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, p))) for t, p in cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds: tracks {number: (type, codec)}, packets (track, timestamp, keyframe, cluster at, start, length), cues (time, track, cluster at)."""

    tracks: dict[int, tuple[int, str]] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    clusters: int = 0
    scale: int = 1_000_000


class Malformed(ValueError):
    """The bytes aren't a well-formed Matroska file."""


def read_vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, next position, width); ``keep`` leaves the length marker in, as identifiers have it."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep else value & ((1 << 7 * width) - 1), at + width, width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()):
    """(identifier, body start, body end) of each child. One of unknown size ends where its parent or a ``stop`` element does."""
    while at < end:
        ident, body, _ = read_vint(data, at, end, keep=True)
        size, body, width = read_vint(data, body, end)
        if size == (1 << 7 * width) - 1:
            last = end
            if ident == CLUSTER:
                for child, start, _ in elements(data, body, end, frozenset({CLUSTER, CUES, INFO, TRACKS})):
                    if child in (CLUSTER, CUES, INFO, TRACKS):
                        last = start
                        break
        else:
            last = body + size
        if last > end:
            raise Malformed(f"element {ident:#x} at {at} runs past its parent")
        if ident in stop:
            yield ident, at, last
            return
        yield ident, body, last
        at = last


def number(data: bytes, at: int, end: int) -> int:
    """An unsigned number of 62 bits at most, so that times and places made of it fit 64."""
    value = int.from_bytes(data[at:end], "big")
    if value >> 62:
        raise Malformed("a number of over 62 bits")
    return value


def read_block(data: bytes, at: int, end: int, time: int, cluster_at: int, media: Media, key: bool | None) -> None:
    """Append a block's packets: no lacing, or Xiph, fixed-size or EBML lacing. Laced packets share the block's timestamp."""
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end:
        raise Malformed("block without a head")
    (offset, flags), at = struct.unpack(">hB", data[at : at + 3]), at + 3
    lacing = flags >> 1 & 3
    media.lacings[lacing] += 1
    sizes = [end - at]
    if lacing:
        if at >= end:
            raise Malformed("laces without a count")
        n, at = data[at] + 1, at + 1
        if lacing == 2:
            if (end - at) % n:
                raise Malformed("fixed-size laces don't divide the block")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if lacing == 1:
                    size = 0
                    while True:
                        if at >= end:
                            raise Malformed("cut off in a lace size")
                        size, at = size + data[at], at + 1
                        if data[at - 1] < 255:
                            break
                else:
                    size, at, width = read_vint(data, at, end)
                    if k:
                        size += sizes[-1] - ((1 << 7 * width - 1) - 1)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Malformed("laces are longer than their block")
    for size in sizes:
        media.packets.append((track, time + offset, bool(flags & 0x80) if key is None else key, cluster_at, at, size))
        at += size


def parse(data: bytes) -> Media:
    media = Media()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML head")
    for ident, segment, end in top[1:]:
        if ident != SEGMENT:
            continue
        for ident, a, b in elements(data, segment, end):
            if ident == INFO:
                for i, x, y in elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        media.scale = number(data, x, y)
            elif ident == TRACKS:
                for i, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        of = {j: data[p:q] for j, p, q in elements(data, x, y)}
                        media.tracks[int.from_bytes(of.get(TRACK_NUMBER, b""), "big")] = (int.from_bytes(of.get(TRACK_TYPE, b""), "big"), of.get(CODEC_ID, b"").decode("ascii", "replace"))
            elif ident == CLUSTER:
                media.clusters += 1
                time = 0
                for i, x, y in elements(data, a, b):
                    if i == CLUSTER_TIME:
                        time = number(data, x, y)
                    elif i == SIMPLE_BLOCK:
                        read_block(data, x, y, time, a, media, None)
                    elif i == BLOCK_GROUP:
                        children = list(elements(data, x, y))
                        for j, p, q in children:
                            if j == BLOCK:
                                read_block(data, p, q, time, a, media, not any(j == 0xFB for j, _, _ in children))
            elif ident == CUES:
                for i, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        found = {j: (p, q) for j, p, q in elements(data, x, y)}
                        place = {j: number(data, p, q) for j, p, q in elements(data, *found[CUE_POSITIONS])}
                        media.cues.append((number(data, *found[CUE_TIME]), place.get(CUE_TRACK, 0), segment + place.get(CUE_CLUSTER, 0)))
    return media


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with 255 up to a positive multiple of 576; and the bytes before filling."""
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def feature(media: Media) -> str:
    """A line of facts about the packet table."""
    last = max((t for _, t, *_ in media.packets), default=0)
    return (
        f"tracks={len(media.tracks)};codec={'+'.join(c for _, c in media.tracks.values())};clusters={media.clusters};packets={len(media.packets)};"
        f"laced={sum(media.lacings[1:])};bytes={sum(p[-1] for p in media.packets)};last_timestamp={last};cues={len(media.cues)}"
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text as a Matroska file, read it back through the packet table, and digest both.

    Null and empty texts are 576 bytes of 255; repeated rows give a row each; an empty table gives none; extra columns
    are left behind. One document is in memory at a time, and no shuffle takes place.
    """

    def work(batches):
        for batch in slices(batches):
            out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
            out["doc_id"] = batch.column("doc_id")
            for text in batch.column("text").to_pylist():
                payload, n = padded(text)
                data = store(payload)
                media = parse(data)
                back = b"".join([data[at : at + size] for *_, at, size in media.packets])
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-32:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(feature(media))
            yield out

    return map_arrow(documents(docs), work, SCHEMA)


def packet_table(docs: DataFrame, column: str = "media") -> DataFrame:
    """The packets of binary Matroska files, one row each; null or malformed files have none."""
    from pyspark.sql import functions as F

    def work(batches):
        names = [k.split()[0] for k in PACKET_SCHEMA.split(", ")]
        for batch in slices(batches, "media"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    packets = parse(data).packets if data else []
                except (Malformed, KeyError):
                    packets = []
                rows += [(doc_id, k, *p) for k, p in enumerate(packets)]
            yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("media")), work, PACKET_SCHEMA)
