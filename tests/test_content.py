"""Classes, formats, embedded text, chunks and codecs against plain Python."""

import base64
import bz2
import gzip
import io
import json
import lzma
import random
import re
import tarfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from granary.functions import content, kinds
from granary.operators import dedup
from granary.plans.catalogue import queries

NOISE = random.Random(6).randbytes(1 << 16)


def frame(n):
    """An MPEG audio frame of version 1, layer III, 48 kbit/s at 32 kHz, and what follows it."""
    return b"\xff\xfb\x38\x00" + bytes(144 * 48000 // 32000 - 4) + n


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (gzip.compress(b"x"), "deflate-container"), (b"PK\x07\x08more", "deflate-container"), (bz2.compress(b"x"), "compressed"), (lzma.compress(b"x"), "compressed"), (zstandard.compress(b"x"), "compressed"),
        ("Öl und Käse\n".encode(), "text"), ("Öl und Käse €".encode()[:-1], "text"), (b"nul\0", "other"), (b"\x01" + b"x" * 198, "other"), (b"\x01" + b"x" * 200, "text"), (b"", "other"),
        (b"MZ" + b"\x05" * 58 + b"\x40\0\0\0PE\0\0", "executable"), (b"MZ" + b"\x05" * 58 + b"\x44\0\0\0PE\0\0", "other"), (b"MZ says the text", "text"),
        (b"ID3\x02\0\0\0\0\x01\x7f", "audio"), (b"ID3\x02\xff\0\0\0\x01\x7f", "other"), (b"ID3 is text", "text"), (b"\xca\xfe\xba\xbe\0\0\0\x1f", "executable"), (b"\xca\xfe\xba\xbe\0\0\0\x20", "other"),
        (b"RIFF....WEBP", "compressed"), (b"RIFF....MIDI", "text"), (b"\0\0\0\x20ftypqt  ", "video"), (b"\0\0\0\x20ftypavif", "compressed"), (b"BM............", "text"), (b"BMabcd\0\0\0\0abcd", "image-raw"),
        (b"P4\n#", "image-raw"), (b"P7\n1 1", "text"), (b"\xff\x0a", "compressed"), (frame(frame(b"")), "audio"), (frame(b"none"), "other"), (frame(b"")[:100], "audio"), (b"\xff\xfe" + b"a\0" * 99, "other"),
        (NOISE, "high-entropy"), (NOISE + b"z" * (2 << 20), "other"), (b"GIF90a", "text"), (b"II*\0", "image-raw"), (b"fLaC", "audio"),
    ],
)
def test_classes(data, want):
    assert content.class_of(data) == want


def test_corpus_classes(spark):
    png, far = b"\x89PNG\r\n\x1a\n", bytes(0x8001) + b"CD001"
    rows = [
        ("x/.git/a.png", png, "source-git"), ("x/.gitx/a.md", png, "photo-raw-png"), ("shot.jpeg", b"<p>", "other"), ("shot.heic", b"....ftypheic", "other"), ("clip.M4V", b"....ftypM4V ", "video"),
        ("old.ppt", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "office-pdf"), ("setup.msp", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "software-installed"), ("sheet.ods", b"PK\x03\x04", "office-pdf"), ("w.pt", b"PK\x03\x04", "model-weights"),
        ("w.pt", b"PK\x05\x06", "archives-nested"), ("note.md", b"MZ", "text-prose"), ("tool.sys", b"MZ", "software-installed"), ("cd.bin", far, "vm-image"), ("cd.bin", far[:-1], "other"), ("cd.iso", b"", "vm-image"),
        ("m.obj", b"\n  # by hand\n\tusemtl red\n", "game-assets"), ("m.obj", b"v 1\n\xff", "software-installed"), ("m.obj", b"", "software-installed"), ("m.obj", b"# v\nvolume\n", "software-installed"), ("s/.GITMODULES", b"", "source-git"),
        ("film.ts", b"G" + b"." * 187 + b"G" + b"." * 187 + b"G", "video"), ("film.ts", b"Go", "source-git"), ("a.", b"", "other"), ("README", b"words", "other"), (".bashrc", b"words", "other"), ("null.txt", None, "text-prose"),
    ]
    made = spark.createDataFrame([(p, None if h is None else bytearray(h), w) for p, h, w in rows], "path string, head binary, want string")
    assert [r["got"] for r in made.select(kinds.corpus_class(F.col("path"), F.col("head")).alias("got")).collect()] == [w for *_, w in rows]


def test_formats():
    block, tar = bytearray(512), io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w", format=tarfile.USTAR_FORMAT) as t:
        t.addfile(tarfile.TarInfo("a"))
    block[:512] = tar.getvalue()[:512]
    block[257:265] = bytes(8)  # as tar was before it had a name
    block[148:156] = b"%06o\0 " % (sum(block[:148]) + sum(block[156:512]) + 256)
    alone = lzma.compress(b"x" * 99, format=lzma.FORMAT_ALONE)
    cases = {"tar": bytes(block), "lzma": alone, "uue": b"mail\nbegin 644 a.txt\n", "lha": b"\x20\x10-lh5-" + bytes(13) + b"\x02", "cab": b"MSCF" + bytes(20) + b"\x03\x01", "rar": b"Rar!\x1a\x07\x01\0", "cpio": b"\xc7\x71" + bytes(24)}
    assert {k: content.format_of(v) for k, v in cases.items()} == {k: k for k in cases}
    block[0] ^= 1
    nothing = [b"", b"begin the day", b"Rar!\x1a\x07\x02", b"\x1f\x8b\x07", b"BZh9nothing", b"MSCFxxxx" + bytes(20), bytes(block), b"\x5d\0\0\x10\0" + b"\0" * 7 + b"\x10", bytes(600)]
    assert [content.format_of(x) for x in nothing] == [None] * len(nothing)


def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_utf16(spark, small):
    rows = {r["doc_id"]: r for r in queries()["fn_utf16"](spark, small).collect()}
    shown = set(range(0x20, 0x7F)) | {9, 10, 13}
    for ident, text in texts(spark, small).items():
        units = np.frombuffer(text.encode("utf-16-le")[: content.UTF16_SAMPLE], "<u2")
        half = 2 * (units < 256).sum() >= len(units) and 50 * (units % 256 == 0).sum() <= len(units)
        kind = ["le", "be"][ident % 2] if len(units) >= 2 and half and 10 * sum(int(u) in shown for u in units) >= 9 * len(units) else None
        r = rows[ident]
        assert (r["kind"], r["exact"], r["bytes"]) == (kind, kind is not None, len(text.encode()) if kind else None)
        data = b"\x07\x01\x02" + text.encode("utf-16-le") + b"\xff\x01\x03"
        found = [(m.start(), len(m[0])) for p in (rb"(?s)(?:[\x20-\x7e\t\n\r]\x00){32,}", rb"(?s)(?:\x00[\x20-\x7e\t\n\r]){32,}") for m in re.finditer(p, data)]
        want = []
        for start, length in sorted(found):
            if not want or sum(want[-1]) <= start:
                want.append((start, length))
        assert [(s["start"], s["length"]) for s in r["runs"]] == want
    lone = "a\ud800b".encode("utf-16-le", "surrogatepass")
    assert content.utf16_bytes(content.utf16_text(lone, "le"), "le") == lone and len(content.utf16_text(lone, "le")) == 5
    assert content.utf16_kind(b"\xfe\xff\0a") == "be" and content.utf16_kind(b"a\0") is None and content.utf16_kind(bytes(64)) is None


def plain_cuts(data, least, average, most):
    """The published loop, byte by byte."""
    bits, mask64, gear = round(float(np.log2(average))), (1 << 64) - 1, [int(g) for g in content.GEAR]
    strict, loose = content.MASKS[bits + 1 - 5], content.MASKS[bits - 1 - 5]
    out, at = [], 0
    while at < len(data):
        part, h = data[at : at + most], 0
        cut = len(part)
        for p in range(least, len(part) // 2 * 2):
            h = ((h << 1) + gear[part[p]]) & mask64
            if not h & (strict if p < min(average, len(part)) // 2 * 2 else loose):
                cut = p
                break
        at += cut
        out.append(at)
    return out


@pytest.mark.parametrize("sizes", [(256, 1024, 8192), (64, 256, 256), (64, 64 << 4, 4096)])
def test_cuts_are_those_of_the_plain_loop(monkeypatch, sizes):
    monkeypatch.setattr(content, "CACHED", 1000)
    rng = random.Random(11)
    assert (int(content.GEAR[0]), int(content.GEAR[1])) == (0x3B5D3C7D207E37DC, 0x784D68BA91123086)
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 321, 1023, 5001, 30_000):
        for data in (rng.randbytes(n), bytes(rng.choice(b"ab \n") for _ in range(n)), bytes(n)):
            assert content.cut_points(data, *sizes) == plain_cuts(data, *sizes)
    for bad in ((62, 256, 1024), (256, 128, 1024), (65, 256, 1024)):
        with pytest.raises(ValueError):
            content.cut_points(b"abc", *bad)


def test_chunks_of_all_documents(spark, small):
    rows = sorted((int(r["key"]), r["pos"], r["start"], r["len"]) for r in queries()["dom_cdc"](spark, small).collect())
    want = []
    for ident, text in sorted(texts(spark, small).items()):
        start = 0
        for pos, end in enumerate(plain_cuts(text.encode(), 256, 1024, 8192)):
            want.append((ident, pos, start, end - start))
            start = end
    assert rows == want


def plain_delta(old, new, block=32):
    """Byte by byte: the first block of old that equals what follows, extended both ways."""
    where, out, literal, at = {}, [], 0, 0
    for i in range(0, len(old) - block + 1, block):
        where.setdefault(old[i : i + block], i)
    while at + block <= len(new):
        start = where.get(new[at : at + block])
        if start is None:
            at += 1
            continue
        begin, n = at, block
        while begin > literal and start > 0 and new[begin - 1] == old[start - 1]:
            begin, start, n = begin - 1, start - 1, n + 1
        while begin + n < len(new) and start + n < len(old) and new[begin + n] == old[start + n]:
            n += 1
        out += [("L", new[literal:begin])] * (begin > literal) + [("C", start, n)]
        at = literal = begin + n
    return out + [("L", new[literal:])] * (len(new) > literal)


def test_deltas_are_those_of_the_plain_loop():
    rng = random.Random(13)
    for k in range(150):
        n = rng.choice([0, 5, 31, 32, 33, 100, 1000, 5000])
        old = bytes(rng.choice(b"ab") for _ in range(n)) if k % 3 == 0 else rng.randbytes(n)
        cut = rng.randrange(n + 1)
        new = old[:cut] + rng.randbytes(rng.randrange(40)) + old[max(0, cut - 50) :][: rng.choice([0, 10, n])] + rng.randbytes(3)
        want = b"".join(b"L" + len(x[1]).to_bytes(4, "big") + x[1] if x[0] == "L" else b"C" + x[1].to_bytes(8, "big") + x[2].to_bytes(4, "big") for x in plain_delta(old, new))
        assert content.delta_encode(old, new) == want and content.delta_apply(old, want) == new


def test_trials(spark, small):
    data = b"".join(bytes([65 + i]) * 5000 + NOISE[:7000] for i in range(30))
    quarter, packed = 1 << 10, zstandard.ZstdCompressor(level=9).compress
    parts = [data[len(data) // 4 * i : len(data) // 4 * i + quarter] for i in range(4)]
    assert content.trial_of(data, 4 * quarter)[1:] == tuple(sum(len(f(p)) for p in parts) for f in (packed, lzma.compress, bz2.compress))
    assert content.trial_of(NOISE)[0] == "store" and content.trial_of(b"")[0] == "store"
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries()["dom_trial"](spark, small).collect()}
    for ident, text in texts(spark, small).items():
        raw = text.encode()
        z, x, b = (len(f(raw)) for f in (packed, lzma.compress, bz2.compress))
        name, least = ("bzip2", b) if b < min(z, x) else ("lzma", x) if x <= z else ("zstd", z)
        assert rows[ident] == ("store" if least >= len(raw) else name, z, x, b)


def test_base64_of_all_documents(spark, small):
    rows = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in queries()["fn_base64"](spark, small).collect()}
    for ident, text in texts(spark, small).items():
        raw = f"{text} {text}".encode()
        length = len(base64.b64encode(raw))
        lines = -(-length // 76)  # as the engine wraps them
        assert rows[ident] in ([(3, length, len(raw))], [(3, length + 2 * (lines - 1), len(raw))]) or (length < 256 and not rows[ident])


def test_json_differences(spark, small):
    rows = {r["event_id"]: r["diff"] for r in queries()["fn_json_diff"](spark, small).collect()}
    props = {r["event_id"]: json.loads(r["props"]) for r in spark.read.parquet(f"{small}/events.parquet").collect()}
    assert rows == {i: [] if p == {"k": 69} else ["/k: differs"] for i, p in props.items()}
    assert content.json_diff_of({"a": [1, {"b": 2}], "c": 1, "t": True}, {"a": [1, {"b": "2"}, 3], "d": 1, "t": 1}) == ["/c: missing", "/d: extra", "/a: 2 and 3 items", "/a/1/b: differs", "/t: differs"]


@pytest.mark.parametrize(("stretch", "sizes"), [(50_000, [0, 1, 10, 400, 999, 1000, 1500]), (7, [0, 1, 10, 400, 999, 1000, 1500]), (5, [0, 1, 30]), (3, [2000]), (4, [0])])
def test_blocks(spark, monkeypatch, stretch, sizes):
    """One chunk after another, against stretches that blocks run through, end in and begin with."""
    monkeypatch.setattr(dedup, "STRETCH", stretch)
    rng = random.Random(8)
    rows = [(f"c{i % 3 if i < 600 else 0}", i, rng.choice(sizes)) for i in range(1200)]
    want = []
    for cluster in ("c0", "c1", "c2"):
        at = None
        for _, chunk, length in [r for r in rows if r[0] == cluster]:
            if at and at[4] + length <= 1000:
                at[3], at[4] = at[3] + 1, at[4] + length
            else:
                at = [cluster, at[1] + 1 if at else 0, chunk, 1, length]
                want.append(at)
    frame = spark.createDataFrame(rows, "cluster string, chunk long, len long").repartition(4)
    assert sorted(map(list, dedup.pack_blocks(frame, 1000).collect())) == want
    assert dedup.pack_blocks(frame.limit(0), 1000).count() == 0


def test_generations_grow_batch_by_batch(spark, tmp_path):
    from granary.sources import sinks
    from granary.streaming import ingest

    for i, rows in enumerate([[("a", "x" * 10), ("b", "y" * 7)], [("a", "x" * 8 + "zz"), ("c", "")]]):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        q = ingest.append_generations(ingest.arriving(spark, f"{tmp_path}/in", "path string, content string"), f"{tmp_path}/out", f"{tmp_path}/state", 4)
        q.processAllAvailable()
        q.stop()
    assert sinks.committed(spark, f"{tmp_path}/out") == [1, 2]
    for generation, want in ((1, {"a": "x" * 10, "b": "y" * 7}), (2, {"a": "x" * 8 + "zz", "b": "y" * 7})):
        entries, members, blobs = sinks.read_container(spark, f"{tmp_path}/out", generation)
        assert {r["path"]: r["size"] for r in entries.collect()} == {k: len(v) for k, v in want.items()} | ({"c": 0} if generation == 2 else {})
        assert {r["path"]: r["content"] for r in sinks.extract(members, blobs).collect()} == want
    assert blobs.count() == blobs.select("hash").distinct().count() == 5


def test_streams_write_files_and_count_late_rows(spark, tmp_path):
    from granary.streaming import ingest

    rows = [(1, "a"), (9000, "a"), (2, "a"), (3, "b")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "t long, k string").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = ingest.arriving(spark, f"{tmp_path}/in", "t long, k string")
    assert {tuple(r) for r in ingest.totals(stream, ["k"], f"{tmp_path}/sums", f"{tmp_path}/s1").collect()} == {("a", 3), ("b", 1)}
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("t") + 10**9))
    new = ingest.drain(ingest.new_chunks(timed, "ts", "k"), f"{tmp_path}/new", f"{tmp_path}/s2")
    assert sorted(r["k"] for r in new.collect()) == ["a", "b"]
