"""Matroska: a writer and a parser of EBML elements, clusters, laced blocks and cues; packet tables.

Payloads are stored as 8-bit mono PCM at 8000 samples a second, eight samples to a millisecond.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.common import modest_batches

# Element identifiers of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID, CRC = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC, 0xBF
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")

UNIT, FRAME, FRAMES, BLOCKS, PER_MS = 64, 512, 8, 16, 8


# ---- numbers of variable length


def vint(n: int, width: int = 0) -> bytes:
    """``n`` with its length marked by the leading zeros of the first byte."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """The number at ``at`` (None: unknown size) and where it ends."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError(f"bad number at {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"bad identifier at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


# ---- writer


def laced(frames: list[bytes], turn: int) -> tuple[int, bytes]:
    """Lacing flag bits and body of a block.  ``turn`` picks the lacing, so all kinds occur."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1 and turn % 3 == 2:
        kind, lengths = 2, b""
    elif turn % 3 == 1:
        steps = b"".join(vint(b - a + (1 << 13) - 1, 2) for a, b in zip(sizes, sizes[1:-1]))
        kind, lengths = 3, vint(sizes[0]) + steps
    else:
        kind, lengths = 1, b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    return kind, head + lengths + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file of one audio track whose packets, joined, are the payload.  It depends on the payload alone."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"granary") + element(WRITER, b"granary") + element(DURATION, struct.pack(">d", len(payload) / PER_MS)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", 1000.0 * PER_MS)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    place = len(info) + len(tracks)
    step = FRAME * FRAMES
    for c, at in enumerate(range(0, len(payload), step * BLOCKS)):
        start, blocks = at // PER_MS, []
        for b, p in enumerate(range(at, min(at + step * BLOCKS, len(payload)), step)):
            part = payload[p : p + step]
            flags, inner = laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)], b + c)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", p // PER_MS - start, 0x80 | flags << 1) + inner))
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


# ---- parser


@dataclass
class Media:
    """What a file holds.  Clusters: where their elements begin.  Packets: track, timestamp in ns, offset, length, key frame, lacing, cluster number."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    scale: int = 1_000_000
    complete: bool = True


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Identifier, start and end of each element in a range.  One of unknown size ends before the next
    element that stands a level higher, or where the range does."""
    while at < end:
        ident, inner = read_id(data, at)
        size, inner = read_vint(data, inner)
        if size is None:
            stop = inner
            while stop < end:
                follows, after = read_id(data, stop)
                if ident != SEGMENT and follows in TOP:
                    break
                skip, after = read_vint(data, after)
                if skip is None:
                    if follows not in TOP:
                        raise ValueError(f"unknown size at {stop}")
                    stop = end
                    break
                stop = after + skip
        else:
            stop = inner + size
        if stop > end:
            raise ValueError(f"element at {at} ends beyond its parent")
        yield ident, inner, stop
        at = stop


def whole(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def real(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end - at in (4, 8) else 0.0


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and where the first starts."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for i in range(n - 1):
            width = 9 - data[at].bit_length()
            value, at = read_vint(data, at)
            value = (1 << 7 * width) - 1 if value is None else value
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("frames of a fixed lace differ")
        return [(end - at) // n] * n, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    return sizes, at


def read_block(media: Media, data: bytes, at: int, end: int, cluster: int, time: int, key: bool | None, lasting: int | None) -> None:
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, kind)
    start = (time + relative) * media.scale
    per_ms = media.tracks.get(track, {}).get("bytes_per_ms")
    each = lasting * media.scale // len(sizes) if lasting else None
    for size in sizes:
        media.packets.append((track, start, at, size, bool(flags & 0x80) if key is None else key, LACINGS[kind], cluster))
        at += size
        start += each if each is not None else round(size / per_ms * 1_000_000) if per_ms else 0
    media.blocks += 1


def read_tracks(media: Media, data: bytes, at: int, end: int) -> None:
    for ident, a, b in children(data, at, end):
        if ident != ENTRY:
            continue
        found = {"number": 0, "codec": "", "kind": 0}
        for i, x, y in children(data, a, b):
            if i == NUMBER:
                found["number"] = whole(data, x, y)
            elif i == KIND:
                found["kind"] = whole(data, x, y)
            elif i == CODEC:
                found["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif i == AUDIO:
                sound = {j: (real if j == RATE else whole)(data, p, q) for j, p, q in children(data, x, y) if j in (RATE, CHANNELS, DEPTH)}
                if DEPTH in sound and found["codec"].startswith("A_PCM"):
                    found["bytes_per_ms"] = sound.get(RATE, 8000.0) * sound.get(CHANNELS, 1) * sound[DEPTH] / 8000
        media.tracks[found["number"]] = found


def read_cluster(media: Media, data: bytes, begin: int, at: int, end: int) -> None:
    cluster, time = len(media.clusters), 0
    media.clusters.append(begin)
    for ident, a, b in children(data, at, end):
        if ident == TIMESTAMP:
            time = whole(data, a, b)
        elif ident == SIMPLE_BLOCK:
            read_block(media, data, a, b, cluster, time, None, None)
        elif ident == BLOCK_GROUP:
            inner = list(children(data, a, b))
            lasting = next((whole(data, x, y) for i, x, y in inner if i == BLOCK_DURATION), None)
            for i, x, y in inner:
                if i == BLOCK:
                    read_block(media, data, x, y, cluster, time, all(j != REFERENCE for j, *_ in inner), lasting)


def read_cues(media: Media, data: bytes, at: int, end: int, base: int) -> None:
    for ident, a, b in children(data, at, end):
        if ident != CUE_POINT:
            continue
        time = 0
        for i, x, y in children(data, a, b):
            if i == CUE_TIME:
                time = whole(data, x, y)
            elif i == CUE_PLACES:
                place = {j: whole(data, p, q) for j, p, q in children(data, x, y) if j in (CUE_TRACK, CUE_CLUSTER)}
                media.cues.append((time * media.scale, place.get(CUE_TRACK, 0), base + place.get(CUE_CLUSTER, 0)))


def parse(data: bytes) -> Media:
    """Everything up to the first damage; ``complete`` is False where there is any.  Empty input is damage."""
    media = Media(complete=bool(data))
    try:
        for ident, a, b in children(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            begin = a  # siblings follow one another, so each begins where the last has ended
            for i, x, y in children(data, a, b):
                if i == INFO:
                    media.scale = next((whole(data, p, q) for j, p, q in children(data, x, y) if j == SCALE), 1_000_000)
                elif i == TRACKS:
                    read_tracks(media, data, x, y)
                elif i == CLUSTER:
                    read_cluster(media, data, begin, x, y)
                elif i == CUES:
                    read_cues(media, data, x, y, a)
                begin = y
    except (ValueError, IndexError, struct.error):
        media.complete = False
    return media


# ---- operators


def store_media(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: each text as UTF-8, filled with zeros to a positive multiple of 64, muxed.

    A null text is empty; an empty one is stored as 64 zeros; repeated rows each get their row; an empty table
    gives no rows; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [(t or "").encode() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [len(x) for x in raw], "media": [mux(x + b"\0" * (-len(x) % UNIT or (UNIT if not x else 0))) for x in raw]})

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInPandas(written, schema)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: per packet its file's id, track, timestamp (ns), offset, length, key frame, lacing,
    cluster number, and whether a cue points to its cluster.  Null, empty and damaged files give the packets
    before the damage, which may be none."""
    kind = media.schema[id_col].dataType
    names = ["track", "timestamp_ns", "offset", "length", "key_frame", "lacing", "cluster"]
    kinds = [T.LongType()] * 4 + [T.BooleanType(), T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, k) for n, k in zip(names, kinds)], T.StructField("cued", T.BooleanType())])

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ident, data in zip(frame["doc_id"], frame["media"]):
                found = parse(bytes(data) if data is not None else b"")
                cued = {p for *_, p in found.cues}
                starts = [p in cued for p in found.clusters]
                rows = [(ident, *p, starts[p[-1]]) for p in found.packets]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

    return media.select(media[id_col].alias("doc_id"), media[media_col].alias("media")).mapInPandas(listed, schema)


def described(data: bytes) -> tuple[bytes, str]:
    """Payload and features of a file that :func:`mux` has written."""
    media = parse(data)
    payload = b"".join(data[p[2] : p[2] + p[3]] for p in media.packets)
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256)[np.newaxis] / max(1, len(x))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    kinds = ",".join(f"{k}:{sum(q[5] == k for q in media.packets)}" for k in LACINGS)
    codec = media.tracks[1]["codec"] if 1 in media.tracks else "-"
    last = media.packets[-1][1] // 1_000_000 if media.packets else 0
    return payload, (
        f"codec={codec};clusters={len(media.clusters)};blocks={media.blocks};packets={len(media.packets)};cues={len(media.cues)};laced={kinds};"
        f"last_ms={last};mean={float(x.mean()) if len(x) else 0:.4f};entropy={entropy:.4f};complete={int(media.complete)}"
    )


def read_back(media: DataFrame) -> DataFrame:
    """What :func:`store_media`'s files hold: lengths, hashes and features, computed from the stored bytes.

    A null or damaged file holds what stands before the damage, which may be nothing; repeated rows each get their
    row; an empty table gives no rows; other columns are ignored.
    """
    modest_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType
    names = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, k) for n, k in names.items()]])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ident, n, data in zip(frame["doc_id"], frame["n_bytes"], frame["media"]):
                payload, feature = described(data := bytes(data) if data is not None else b"")
                rows.append((ident, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=schema.names)

    return media.mapInPandas(read, schema)
