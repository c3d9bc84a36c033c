"""Foreign archives of every kind, and damage."""

import binascii
import bz2
import gzip
import io
import lzma
import random
import struct
import tarfile
import zipfile

import zstandard

from granary.sources import archives


def tar(mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, kind, body in (("d", tarfile.DIRTYPE, b""), ("d/a.txt", tarfile.REGTYPE, b"hello"), ("link", tarfile.SYMTYPE, b"")):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.mtime, info.linkname = kind, len(body), 7, "d/a.txt"
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../up.txt", b"climbs")
        f.writestr("empty/", b"")
    files = {
        "a.tar": tar(), "a.tar.gz": tar("w:gz"), "a.tar.xz": tar("w:xz"), "x.zip": z.getvalue(), "t.gz": gzip.compress(b"text"), "t.bz2": bz2.compress(b"text"),
        "t.xz": lzma.compress(b"text"), "t.zst": zstandard.compress(b"text"), "bad.zip": z.getvalue()[:40], "bad.gz": gzip.compress(b"text" * 99)[:-9], "none": b"plain", "empty": b"",
    }
    rows = archives.read_archives(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "path string, content binary"), content=True).collect()
    got = {}
    for r in rows:
        got.setdefault(r["archive"], []).append(r)
    for name in ("a.tar", "a.tar.gz", "a.tar.xz"):
        assert [(r["member"], r["kind"], r["size"]) for r in got[name]] == [("d", "Directory", 0), ("d/a.txt", "File", 5), ("link", "Symlink", 0)]
        assert bytes(got[name][1]["content"]) == b"hello" and got[name][1]["mtime_s"] == 7
    assert [(r["member"], r["kind"]) for r in got["x.zip"]] == [("../up.txt", "File"), ("empty", "Directory")]
    for name in ("t.gz", "t.bz2", "t.xz", "t.zst"):
        assert [(r["member"], bytes(r["content"])) for r in got[name]] == [("t", b"text")]
    for name in ("bad.zip", "bad.gz", "none", "empty", "null"):
        assert got[name][-1]["fault"] and got[name][-1]["member"] is None


def ar(members):
    return b"!<arch>\n" + b"".join(b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (name, 7, 0, 0, 0o644, len(body)) + body + b"\n" * (len(body) % 2) for name, body in members)


def cpio(kind, members):
    out = b""
    for i, (name, mode, body) in enumerate([*members, (b"TRAILER!!!", 0, b"")]):
        if kind == "new":
            head = b"070701" + b"".join(b"%08X" % n for n in (i, mode, 0, 0, 1, 7, len(body), 0, 0, 0, 0, len(name) + 1, 0)) + name + b"\0"
            out += head + b"\0" * (-len(head) % 4) + body + b"\0" * (-len(body) % 4)
        elif kind == "old":
            out += b"070707" + b"".join(b"%0*o" % (w, n) for w, n in ((6, 0), (6, i), (6, mode), (6, 0), (6, 0), (6, 1), (6, 0), (11, 7), (6, len(name) + 1), (11, len(body)))) + name + b"\0" + body
        else:
            head = struct.pack("<13H", 0x71C7, 0, i, mode, 0, 0, 1, 0, 0, 7, len(name) + 1, 0, len(body)) + name + b"\0"
            out += head + b"\0" * (len(head) % 2) + body + b"\0" * (len(body) % 2)
    return out


def iso():
    def record(name, extent, size, flags):
        head = struct.pack("<B", 0) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([126, 1, 2, 3, 4, 5, 4, flags, 0, 0, 1, 0, 0, 1, len(name)]) + name
        head += b"\0" * ((len(head) + 1) % 2)
        return bytes([len(head) + 1]) + head

    root = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"A.TXT;1", 20, 5, 0) + record(b"SUB", 19, 2048, 2)
    sub = record(b"\0", 19, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"NOEXT.;1", 21, 3, 0)
    first = (b"\x01CD001\x01".ljust(156, b"\0") + record(b"\0", 18, 2048, 2)).ljust(2048, b"\0")
    return bytes(16 * 2048) + first + b"\xffCD001\x01".ljust(2048, b"\0") + root.ljust(2048, b"\0") + sub.ljust(2048, b"\0") + b"hello".ljust(2048, b"\0") + b"abc".ljust(2048, b"\0")


def lzw(data, most=12):
    """Codes of the published method, without a clear code until the table is full."""
    table, width, bits, n, last = {bytes([i]): i for i in range(256)}, 9, 0, 0, b""
    codes, following = [], 257
    for b in data:
        now = last + bytes([b])
        if now in table:
            last = now
            continue
        codes.append((table[last], width))
        if following < 1 << most:
            table[now] = following
            following += 1
            if following > 1 << width and width < most:
                codes.append((None, width))
                width += 1
        last = bytes([b])
    if last:
        codes.append((table[last], width))
    begun = 0
    for code, w in codes:
        if code is None:
            n += -(n - begun) % (8 * w)
            begun = n
        else:
            bits |= code << n
            n += w
    return b"\x1f\x9d" + bytes([most | 0x80]) + bits.to_bytes(-(-n // 8), "little")


def listing(name, data, content=True):
    return [(m[0], m[1], m[2], m[4]) for m in archives.members_of(name, data, content)]


def test_more_formats():
    assert listing("x.a", ar([(b"/", b"table"), (b"//", b"a very long name.o/\n"), (b"/0", b"one"), (b"b.o/", b"two2"), (b"#1/4", b"c.o\0three")])) == [("a very long name.o", "File", 3, b"one"), ("b.o", "File", 4, b"two2"), ("c.o", "File", 5, b"three")]
    members = [(b"d", 0o040755, b""), (b"d/odd", 0o100644, b"hello"), (b"ln", 0o120777, b"d/odd")]
    for kind in ("new", "old", "binary"):
        assert listing("x", cpio(kind, members)) == [("d", "Directory", 0, None), ("d/odd", "File", 5, b"hello"), ("ln", "Symlink", 0, None)]
    assert listing("cd.iso", iso()) == [("A.TXT", "File", 5, b"hello"), ("SUB", "Directory", 0, None), ("SUB/NOEXT", "File", 3, b"abc")]
    assert listing("x.uue", b"mail\nbegin 644 a.txt\n" + binascii.b2a_uu(b"hello") + b"`\nend\n") == [("a.txt", "File", 5, b"hello")]
    assert listing("x.uue", b"begin-base64 644 a.txt\naGVsbG8=\n====\n") == [("a.txt", "File", 5, b"hello")]
    body = bytes(random.Random(1).choice(b"abc") for _ in range(9000))
    raw = lzma.compress(body, lzma.FORMAT_ALONE)[13:]
    packed = b"LZIP\x01\x17" + raw + struct.pack("<IQQ", binascii.crc32(body), len(body), 26 + len(raw))
    assert listing("t.txt.lz", packed + packed) == [("t.txt", "File", 18000, body + body)]
    for data in (b"", b"a", body, b"abababab" * 50, random.Random(2).randbytes(9000)):
        assert listing("t.Z", lzw(data)) == [("t", "File", len(data), data)]


def test_a_member_that_is_too_large_ends_nothing(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", b"x" * 10)
        f.writestr("b", b"x" * 1000)
        f.writestr("c", b"x" * 20)
    files = spark.createDataFrame([("x.zip", bytearray(z.getvalue())), ("y.gz", bytearray(gzip.compress(b"x" * 101)))], "path string, content binary")
    rows = archives.read_archives(files, content=True, most=100).collect()
    assert sorted((r["member"], r["fault"], None if r["content"] is None else len(r["content"])) for r in rows) == [("a", None, 10), ("b", archives.TOO_LARGE, None), ("c", None, 20), ("y", archives.TOO_LARGE, None)]


def test_volumes(spark):
    names = ["a.7z.001", "a.7z.002", "b.7z.002", "b.7z.003", "c.part1.rar", "c.part2.rar", "d.rar", "d.r00", "d.r01", "e.z01", "e.z02", "e.zip", "f.z01", "f.z02", "g.zip", "h.r00", "h.r01", "i.txt"]
    files = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "path string, content binary")
    found = archives.volume_sets(files)
    got = {r["path"]: (r["volume"], r["complete"]) for r in found.collect()}
    whole = {"a.7z.001": 1, "a.7z.002": 2, "c.part1.rar": 1, "c.part2.rar": 2, "d.rar": 1, "d.r00": 2, "d.r01": 3, "e.z01": 1, "e.z02": 2, "e.zip": 3}
    assert {k: v[0] for k, v in got.items() if v[1]} == whole
    assert {k for k, v in got.items() if not v[1]} == {"b.7z.002", "b.7z.003", "f.z01", "f.z02", "h.r00", "h.r01"}
    joined = {r["path"]: bytes(r["content"]) for r in archives.joined_volumes(found, files).collect()}
    assert joined["a.7z (split)"] == b"a.7z.001a.7z.002" and joined["e (zip)"] == b"e.z01e.z02e.zip" and len(joined) == 4
