"""Byte-level functions, as pandas UDFs: entropy, features, classes, formats, embedded text, chunking, codecs."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"binary": T.BinaryType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def fields(text: str) -> T.StructType:
    """``name kind`` by commas as a struct; unlike a DDL string it needs no session when this module is read."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


# ---- entropy

#: Bytes sampled at the head of each stride, and the limits of bits per byte.
HEAD, STRIDE, SAMPLE_LIMIT, FULL_LIMIT = 4096, 65536, 7.5, 7.95
#: Bytes of a file that decide its class: for statistics, and for signatures and entropy.
SAMPLE, BLOCK = 1 << 16, 1 << 20


def entropy_of(data: bytes) -> float:
    """Order-0 bits per byte; 0 for nothing."""
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return max(0.0, float(-(p * np.log2(p)).sum()))


def sampled_entropy(data: bytes) -> float:
    return entropy_of(b"".join(data[i : i + HEAD] for i in range(0, len(data), STRIDE)))


def is_incompressible(data: bytes) -> bool:
    """The sample first; only if that looks random, all of it."""
    return sampled_entropy(data) >= SAMPLE_LIMIT and entropy_of(data) >= FULL_LIMIT


@F.pandas_udf(T.DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else entropy_of(bytes(b)))


@F.pandas_udf(T.DoubleType())
def entropy_sampled(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else sampled_entropy(bytes(b)))


@F.pandas_udf(T.BooleanType())
def incompressible(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else is_incompressible(bytes(b)))


# ---- features and classes

FEATURES = "len long, entropy double, printable double, nul double, control double, newline double, utf8 boolean, max_byte double"


def valid_utf8(data: bytes) -> bool:
    """Valid, but for one character that the end cuts off."""
    try:
        data.decode()
    except UnicodeDecodeError as fault:
        return fault.reason == "unexpected end of data" and len(data) - fault.start < 4
    return True


def features_of(data: bytes) -> tuple:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    control = counts[:32].sum() - counts[[9, 10, 13]].sum() + counts[127]
    printable = counts[32:127].sum() + counts[[9, 10, 13]].sum()
    return (len(data), entropy_of(data), printable / n, counts[0] / n, control / n, counts[10] / n, valid_utf8(data), counts.max() / n)


#: Classes by what files begin with.
MAGIC = [
    ("jpeg", b"\xff\xd8\xff"), ("png", b"\x89PNG\r\n\x1a\n"), ("deflate-container", b"PK\x03\x04"), ("deflate-container", b"PK\x05\x06"),
    ("deflate-container", b"PK\x07\x08"), ("deflate-container", b"\x1f\x8b\x08"), ("deflate-container", b"%PDF-"), ("executable", b"\x7fELF"),
    ("executable", b"\xfe\xed\xfa\xce"), ("executable", b"\xfe\xed\xfa\xcf"), ("executable", b"\xce\xfa\xed\xfe"), ("executable", b"\xcf\xfa\xed\xfe"),
    ("audio", b"fLaC"), ("audio", b"OggS"), ("video", b"\x1aE\xdf\xa3"), ("image-raw", b"II*\x00"), ("image-raw", b"MM\x00*"),
    ("image-raw", b"GIF87a"), ("image-raw", b"GIF89a"), ("compressed", b"7z\xbc\xaf\x27\x1c"), ("compressed", b"\xfd7zXZ\x00"),
    ("compressed", b"\x28\xb5\x2f\xfd"), ("compressed", b"Rar!\x1a\x07"), ("compressed", b"\xff\x0a"), ("compressed", b"\x00\x00\x00\x0cJXL "),
]
CLASSES = ["text", "jpeg", "deflate-container", "png", "executable", "audio", "image-raw", "video", "compressed", "high-entropy", "other"]
#: Classes that are stored as they are.
STORED = ["high-entropy", "video", "compressed", "jpeg", "png"]
#: Kilobits a second of MPEG audio frames by version 1 layer III, version 1 layer II and version 2, by index
#: 1 to 14; and samples a second of versions 1, 2 and 2.5, by index.
RATES_1_3 = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_1_2 = [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
RATES_2 = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
SAMPLES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def mpeg_frame(data: bytes, at: int = 0) -> int:
    """Length of the MPEG audio frame (layer II or III) whose header is there; 0 for none."""
    if len(data) < at + 3:
        return 0
    bits = int.from_bytes(data[at : at + 3], "big")
    version, layer, rate, samples, pad = bits >> 11 & 3, bits >> 9 & 3, bits >> 4 & 15, bits >> 2 & 3, bits >> 1 & 1
    # Layer 3 in these bits is layer I, which a UTF-16 mark looks like; version 1 is reserved.
    if bits >> 13 != 0x7FF or version not in SAMPLES or layer not in (1, 2) or rate in (0, 15) or samples == 3:
        return 0
    kilobits = (RATES_2 if version != 3 else RATES_1_3 if layer == 1 else RATES_1_2)[rate - 1]
    per_bit = 72 if version != 3 and layer == 1 else 144
    return per_bit * kilobits * 1000 // SAMPLES[version][samples] + pad


def is_mpeg(data: bytes) -> bool:
    """A frame that leads to another, or beyond the end."""
    length = mpeg_frame(data)
    return bool(length) and (len(data) < length + 4 or mpeg_frame(data, length) > 0)


def signed_class(data: bytes) -> str | None:
    """The class by signature, as far as one tells."""
    for name, magic in MAGIC:
        if data.startswith(magic):
            return name
    if data[:2] == b"MZ":  # a header that points to another
        at = int.from_bytes(data[60:64], "little")
        return "executable" if len(data) >= 64 and data[at : at + 4] == b"PE\0\0" else None
    if data[:3] == b"ID3":
        right = len(data) >= 10 and 2 <= data[3] <= 4 and data[4] != 0xFF and max(data[6:10]) < 0x80
        return "audio" if right else None
    if data[:4] == b"\xca\xfe\xba\xbe":  # few architectures, or a Java class of some version
        return "executable" if len(data) >= 8 and int.from_bytes(data[4:8], "big") < 0x20 else "other"
    if data[:4] == b"RIFF" and len(data) >= 12:
        return {b"WAVE": "audio", b"AVI ": "video", b"WEBP": "compressed"}.get(data[8:12])
    if data[4:8] == b"ftyp" and len(data) >= 12:
        return {b"M4A ": "audio", b"avif": "compressed", b"heic": "compressed", b"mif1": "compressed"}.get(data[8:12], "video")
    if re.match(rb"BZh[1-9]", data):
        return "compressed"
    if data[:2] == b"BM" and len(data) >= 14 and data[6:10] == bytes(4):
        return "image-raw"
    if re.match(rb"P[1-6][ \t\n\r][0-9#]", data):
        return "image-raw"
    return "audio" if is_mpeg(data) else None


def class_of(data: bytes) -> str:
    """Signature, then text (no NUL, valid UTF-8, hardly any controls), then by entropy."""
    if not data:
        return "other"
    head = data[:BLOCK]
    found = signed_class(head)
    if found:
        return found
    _, _, _, nul, control, _, utf8, _ = features_of(data[:SAMPLE])
    if not nul and utf8 and control < 0.005:
        return "text"
    return "high-entropy" if is_incompressible(head) else "other"


@F.pandas_udf(fields(FEATURES))
def features(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(bytes(b) if b is not None else b"") for b in content], columns=[c.split()[0] for c in FEATURES.split(", ")])


@F.pandas_udf(T.StringType())
def classify(content: pd.Series) -> pd.Series:
    return content.map(lambda b: class_of(bytes(b) if b is not None else b""))


#: Container formats by patterns of their first bytes, the first that fits deciding.
FORMATS = [
    ("7z", rb"7z\xbc\xaf\x27\x1c"), ("rar", rb"Rar!\x1a\x07(\x00|\x01\x00)"), ("zip", rb"PK(\x03\x04|\x05\x06|\x07\x08PK\x03\x04)"), ("gzip", rb"\x1f\x8b\x08"),
    ("bzip2", rb"BZh[1-9](\x31\x41\x59\x26\x53\x59|\x17\x72\x45\x38\x50\x90)"), ("xz", rb"\xfd7zXZ\x00"), ("zstd", rb"\x28\xb5\x2f\xfd"), ("lzip", rb"LZIP"),
    ("cab", rb"MSCF\x00{4}.{16}\x03\x01"), ("ar", rb"!<arch>\n"), ("rpm", rb"\xed\xab\xee\xdb"), ("cpio", rb"07070[127]|(\xc7\x71|\x71\xc7).{24}"),
    ("compress", rb"\x1f\x9d"), ("lha", rb"..(-lh[0-7d]-|-lz[s45]-).{13}[\x00-\x03]"), ("tar", rb".{257}ustar"),
]
ISO_AT, ISO = 0x8001, b"CD001"
_FORMATS = [(name, re.compile(pattern, re.DOTALL)) for name, pattern in FORMATS]
#: A line that begins a uuencoded or base64 file, with its octal mode.
_BEGIN = re.compile(rb"(?:\A|\n)begin(?:-base64)? [0-7]{3,4} ")
#: Bytes in which such a line is looked for.
BEGIN_WITHIN = 1 << 16


def tar_sum_fits(data: bytes) -> bool:
    """Whether a block is a tar header without a name of its format: its octal sum is that of its bytes."""
    stated = re.fullmatch(rb" *([0-7]+)[ \0]*", data[148:156])
    return len(data) >= 512 and bool(stated) and data[0] != 0 and int(stated[1], 8) == sum(data[:148]) + sum(data[156:512]) + 8 * 32


def lzma_alone(data: bytes) -> bool:
    """The header of a bare LZMA stream: sane properties, dictionary and size."""
    if len(data) < 13 or data[0] >= 9 * 5 * 5:
        return False
    dictionary, size = int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:13], "little")
    low = dictionary & -dictionary
    return dictionary >= 4096 and dictionary in (low, 3 * low) and (size == (1 << 64) - 1 or size < 1 << 48)


def format_of(data: bytes) -> str | None:
    for name, pattern in _FORMATS:
        if pattern.match(data):
            return name
    if tar_sum_fits(data):
        return "tar"
    if lzma_alone(data):
        return "lzma"
    if _BEGIN.search(data[:BEGIN_WITHIN]):
        return "uue"
    return "iso" if data[ISO_AT : ISO_AT + len(ISO)] == ISO else None


@F.pandas_udf(T.StringType())
def container_format(content: pd.Series) -> pd.Series:
    """The format by magic, never by name; null for none.  Needs 32,774 bytes to tell an ISO image."""
    return content.map(lambda b: format_of(bytes(b)) if b is not None else None)


# ---- embedded text

RUN = re.compile(rb"[A-Za-z0-9+/\r\n]{256,}={0,2}")


def base64_runs(data: bytes) -> list[tuple[int, int, int]]:
    """(start, length, decoded length) of runs that decode and, encoded again at their line length, are the same."""
    found = []
    for m in RUN.finditer(data):
        text = m[0].rstrip(b"\r\n")
        lines = re.split(rb"(\r\n|\n)", text)
        width, end = len(lines[0]), lines[1] if len(lines) > 1 else b""
        bare = b"".join(lines[::2])
        if len(bare) < 256 or len(bare) % 4:
            continue
        try:
            raw = base64.b64decode(bare, validate=True)
        except ValueError:
            continue
        again = base64.b64encode(raw)
        if end:
            again = end.join(again[i : i + width] for i in range(0, len(again), width))
        if again == text:
            found.append((m.start(), len(text), len(raw)))
    return found


@F.pandas_udf(T.ArrayType(fields("start long, length long, decoded long")))
def base64_spans(content: pd.Series) -> pd.Series:
    return content.map(lambda b: [dict(zip(("start", "length", "decoded"), r)) for r in base64_runs(bytes(b) if b is not None else b"")])


#: Bytes that tell the byte order of text without a mark, and units of a run inside other content.
UTF16_SAMPLE, RUN_UNITS = 1 << 16, 32
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[[9, 10, 13, *range(0x20, 0x7F)]] = True


def utf16_kind(data: bytes) -> str | None:
    """le or be, by mark, or if half of one half's bytes are zero, hardly any of the other's, and nine units in ten
    are printable ASCII; null if neither."""
    if len(data) < 4:
        return None
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "le" if data[:2] == b"\xff\xfe" else "be"
    pairs = np.frombuffer(data[: min(len(data), UTF16_SAMPLE) // 2 * 2], np.uint8).reshape(-1, 2)
    zero, shown, n = pairs == 0, _PRINTABLE[pairs], len(pairs)
    for kind, low, high in (("le", 0, 1), ("be", 1, 0)):
        if 2 * zero[:, high].sum() >= n and 50 * zero[:, low].sum() <= n and 10 * (zero[:, high] & shown[:, low]).sum() >= 9 * n:
            return kind
    return None


def utf16_runs(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of runs of at least 32 printable ASCII units in either byte order, at any place, in order; of
    runs that overlap, as one run's two orders do, the first."""
    x = np.frombuffer(data, np.uint8)
    found = []
    for align in (0, 1):
        pairs = x[align : align + (len(x) - align) // 2 * 2].reshape(-1, 2)
        for low, high in ((0, 1), (1, 0)):
            unit = np.concatenate([[False], (pairs[:, high] == 0) & _PRINTABLE[pairs[:, low]], [False]])
            edges = np.flatnonzero(unit[1:] != unit[:-1]).reshape(-1, 2)
            found += [(align + 2 * a, 2 * (b - a)) for a, b in edges.tolist() if b - a >= RUN_UNITS]
    kept: list[tuple[int, int]] = []
    for start, length in sorted(found):
        if not kept or sum(kept[-1]) <= start:
            kept.append((start, length))
    return kept


def utf16_text(data: bytes, kind: str) -> bytes:
    """The text as generalized UTF-8, in which a lone surrogate is three bytes of its own."""
    return data.decode(f"utf-16-{kind}", "surrogatepass").encode("utf-8", "surrogatepass")


def utf16_bytes(text: bytes, kind: str) -> bytes:
    """The way back."""
    return text.decode("utf-8", "surrogatepass").encode(f"utf-16-{kind}", "surrogatepass")


@F.pandas_udf(fields("kind string, text binary, exact boolean"))
def utf16(content: pd.Series) -> pd.DataFrame:
    """UTF-16 as generalized UTF-8; exact tells whether the way back gives the same bytes (an odd byte at the end
    has no way back, and no text)."""
    rows = []
    for b in content:
        data = bytes(b) if b is not None else b""
        kind = utf16_kind(data)
        text = utf16_text(data, kind) if kind and len(data) % 2 == 0 else None
        rows.append((kind, text, text is not None and utf16_bytes(text, kind) == data))
    return pd.DataFrame(rows, columns=["kind", "text", "exact"])


@F.pandas_udf(T.ArrayType(fields("start long, length long")))
def utf16_spans(content: pd.Series) -> pd.Series:
    """The runs inside other content."""
    return content.map(lambda b: [dict(zip(("start", "length"), r)) for r in utf16_runs(bytes(b) if b is not None else b"")])


# ---- content-defined chunks

#: FastCDC 2020 (Xia and others), normalized by one level.
LEAST, AVERAGE, MOST = 4 << 10, 64 << 10, 512 << 10
#: The published masks by their number of bits, from 5 on.
MASKS = [
    0x0000000001804110, 0x0000000001803110, 0x0000000018035100, 0x0000001800035300, 0x0000019000353000, 0x0000590003530000, 0x0000D90003530000,
    0x0000D90103530000, 0x0000D90303530000, 0x0000D90313530000, 0x0000D90F03530000, 0x0000D90303537000, 0x0000D90703537000, 0x0000D90707537000,
    0x0000D91707537000, 0x0000D91747537000, 0x0000D91767537000, 0x0000D93767537000, 0x0000D93777537000, 0x0000D93777577000, 0x0000DB3777577000,
]
#: The published gear table by its rule: the first eight bytes of the MD5 of 64 times each byte.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64, usedforsecurity=False).digest()[:8], "big") for i in range(256)], np.uint64)
#: No mask looks at a higher bit, and a byte's share of the hash moves up a bit with each byte after it.
MEMORY = 64
#: Bytes hashed at once, which with their hashes stay in a core's cache.
CACHED = 1 << 15


def rolled(gears: np.ndarray) -> np.ndarray:
    """The hash after each byte, over it and the 63 before: sums of 1, 2, 4, ... terms, each of two halves."""
    out = gears.copy()
    for bits in (1, 2, 4, 8, 16, 32):
        out[bits:] += out[:-bits] << np.uint64(bits)  # the right side is computed before it is added
    return out


def cut_points(data: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[int]:
    """Ends of chunks.

    A chunk's hash starts anew at its least length.  Up to the average length the stricter of two masks must be
    met to cut, beyond it the looser.  But for the first bytes after that start the hash depends on the last 64
    bytes alone, so it is computed for all of the data at once and only those first bytes once for each chunk.
    """
    if not 64 <= least <= average <= most or least % 2 or average % 2 or most % 2:
        raise ValueError("sizes must be even, 64 at least, and least <= average <= most")
    raw = np.frombuffer(data, np.uint8)
    bits = round(float(np.log2(average)))
    strict, loose = (np.uint64(MASKS[b - 5]) for b in (bits + 1, bits - 1))
    marks: tuple[list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    for at in range(0, len(raw), CACHED):
        before = min(at, MEMORY - 1)
        hashes = rolled(GEAR[raw[at - before : at + CACHED]])[before:]
        for found, mask in zip(marks, (strict, loose)):
            found.append(np.flatnonzero((hashes & mask) == 0) + at)
    hard, soft = map(np.concatenate, marks)

    def first(near: np.ndarray, at: int, marks: np.ndarray, mask: np.uint64, begin: int, end: int) -> int | None:
        """The first place in [begin, end) whose hash meets the mask; ``near`` are the hashes from ``at`` on."""
        known = at + len(near)
        for place in (np.flatnonzero((near[begin - at : max(0, end - at)] & mask) == 0) + begin).tolist() if begin < known else ():
            return place
        i = int(np.searchsorted(marks, max(begin, known)))
        return int(marks[i]) if i < len(marks) and marks[i] < end else None

    out, start = [], 0
    while start < len(data):
        left = min(len(data) - start, most)
        if left > least:
            # The places tried come in pairs, so an odd last one isn't.
            middle, end = start + min(average, left) // 2 * 2, start + left // 2 * 2
            at = start + least
            near = rolled(GEAR[raw[at : min(at + MEMORY, end)]])
            cut = first(near, at, hard, strict, at, middle)
            if cut is None:
                cut = first(near, at, soft, loose, max(at, middle), end)
            left = left if cut is None else cut - start
        out.append(start + left)
        start = out[-1]
    return out


def cdc_chunks(files, sizes: tuple[int, int, int] = (LEAST, AVERAGE, MOST), key: str = "path"):
    """(key, pos, start, len, hash) of content-defined chunks of ``content`` (binary); none for null and empty."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["key"], frame["content"]):
                data, start = bytes(content) if content is not None else b"", 0
                for pos, end in enumerate(cut_points(data, *sizes)):
                    rows.append((name, pos, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            yield pd.DataFrame(rows, columns=["key", "pos", "start", "len", "hash"])

    return files.select(F.col(key).cast("string").alias("key"), F.col("content").cast("binary").alias("content")).mapInPandas(cut, "key string, pos long, start long, len long, hash string")


# ---- codecs


#: Stripes and bytes of a trial's sample.
STRIPES, TRIAL = 4, 1 << 18


def stripes(data: bytes, sample: int = TRIAL) -> list[bytes]:
    """Stretches at 0, 1/4, 1/2 and 3/4, each a quarter of the sample; all in one, where the sample holds it."""
    if len(data) <= sample:
        return [data]
    return [data[len(data) // STRIPES * i :][: sample // STRIPES] for i in range(STRIPES)]


def trial_of(data: bytes, sample: int = TRIAL) -> tuple:
    """Codec by trial on stripes, each packed by itself: bzip2 only if strictly smaller than both others; lzma wins
    ties with zstd; store if none helps."""
    some, zstd = stripes(data, sample), zstandard.ZstdCompressor(level=9)
    sizes = {name: sum(len(pack(s)) for s in some) for name, pack in (("zstd", zstd.compress), ("lzma", lzma.compress), ("bzip2", bz2.compress))}
    if sizes["bzip2"] < min(sizes["zstd"], sizes["lzma"]):
        pick = "bzip2"
    else:
        pick = "lzma" if sizes["lzma"] <= sizes["zstd"] else "zstd"
    return ("store" if sizes[pick] >= sum(map(len, some)) else pick, *sizes.values())


@F.pandas_udf(fields("codec string, zstd long, lzma long, bzip2 long"))
def trial(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([trial_of(bytes(b) if b is not None else b"") for b in content], columns=["codec", "zstd", "lzma", "bzip2"])


_ODD = 0x9E3779B97F4A7C15


def window_hashes(data: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every window of so many bytes: differences of running sums of bytes times powers of an odd
    number, whose inverse takes the place out again."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power = lambda f, n: np.cumprod(np.append(np.uint64(1), np.full(n - 1, f, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(x * power(np.uint64(_ODD), len(x))))
    return (sums[size:] - sums[:-size]) * power(np.uint64(pow(_ODD, -1, 1 << 64)), len(x) - size + 1)


def delta_encode(old: bytes, new: bytes, block: int = 32) -> bytes:
    """A patch of copies from ``old`` and literals: found by hashes of old's blocks, extended both ways."""
    out, literal, at = bytearray(), 0, 0
    places, starts, firsts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(old) >= block <= len(new):
        known, firsts = np.unique(window_hashes(old, block)[::block], return_index=True)
        there = window_hashes(new, block)
        spot = np.minimum(np.searchsorted(known, there), len(known) - 1)
        places = np.flatnonzero(known[spot] == there)
        starts = firsts[spot[places]] * block

    def flush(end: int) -> None:
        if end > literal:
            out.extend(b"L" + (end - literal).to_bytes(4, "big") + new[literal:end])

    i = 0
    while (i := i + int(np.searchsorted(places[i:], at))) < len(places):
        at, start = int(places[i]), int(starts[i])
        if new[at : at + block] != old[start : start + block]:  # equal hashes of different bytes
            at += 1
            continue
        begin = at
        while begin > literal and start > 0 and new[begin - 1] == old[start - 1]:
            begin, start = begin - 1, start - 1
        n, step = at - begin + block, 4096
        while step:  # whole stretches first, then ever smaller ones
            if begin + n + step <= len(new) and new[begin + n : begin + n + step] == old[start + n : start + n + step]:
                n += step
            else:
                step //= 2
        flush(begin)
        out.extend(b"C" + start.to_bytes(8, "big") + n.to_bytes(4, "big"))
        at = literal = begin + n
    flush(len(new))
    return bytes(out)


def delta_apply(old: bytes, patch: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(patch):
        if patch[at : at + 1] == b"L":
            n = int.from_bytes(patch[at + 1 : at + 5], "big")
            out += patch[at + 5 : at + 5 + n]
            at += 5 + n
        elif patch[at : at + 1] == b"C":
            start, n = int.from_bytes(patch[at + 1 : at + 9], "big"), int.from_bytes(patch[at + 9 : at + 13], "big")
            if start + n > len(old):
                raise ValueError("copy beyond the old content")
            out += old[start : start + n]
            at += 13
        else:
            raise ValueError(f"bad patch at {at}")
    return bytes(out)


@F.pandas_udf(fields("patch_bytes long, packed_bytes long, exact boolean"))
def delta(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Size of the patch from one content to another, packed too, and whether applying it gives the new one."""
    rows = []
    for a, b in zip(old, new):
        a, b = (bytes(x) if x is not None else b"" for x in (a, b))
        patch = delta_encode(a, b)
        rows.append((len(patch), len(zlib.compress(patch, 6)), delta_apply(a, patch) == b))
    return pd.DataFrame(rows, columns=["patch_bytes", "packed_bytes", "exact"])


# ---- JSON


def json_diff_of(a, b, at: str = "") -> list[str]:
    if isinstance(a, dict) and isinstance(b, dict):
        out = [f"{at}/{k}: missing" for k in sorted(a.keys() - b.keys())] + [f"{at}/{k}: extra" for k in sorted(b.keys() - a.keys())]
        return out + [d for k in sorted(a.keys() & b.keys()) for d in json_diff_of(a[k], b[k], f"{at}/{k}")]
    if isinstance(a, list) and isinstance(b, list):
        out = [f"{at}: {len(a)} and {len(b)} items"] if len(a) != len(b) else []
        return out + [d for i, (x, y) in enumerate(zip(a, b)) for d in json_diff_of(x, y, f"{at}/{i}")]
    return [] if type(a) is type(b) and a == b else [f"{at}: differs"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Where two JSON values differ; text that is no JSON differs as a whole."""
    import json

    def of(x, y):
        try:
            return json_diff_of(json.loads(x), json.loads(y))
        except (TypeError, ValueError):
            return [": no JSON"]

    return pd.Series([of(x, y) for x, y in zip(a, b)])


def absolute_paths_of(value) -> list[str]:
    if isinstance(value, dict):
        return [p for v in value.values() for p in absolute_paths_of(v)]
    if isinstance(value, list):
        return [p for v in value for p in absolute_paths_of(v)]
    return [value] if isinstance(value, str) and re.match(r"(/[^/]|[A-Za-z]:[\\/]|\\\\)", value) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolute_paths(text: pd.Series) -> pd.Series:
    """Strings of a JSON value that are absolute paths."""
    import json

    return text.map(lambda x: absolute_paths_of(json.loads(x)) if x else [])
