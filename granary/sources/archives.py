"""Foreign archives: members of ZIP, tar, AR, CPIO and ISO 9660 files, and of single packed files (gzip, bzip2, xz, lzip,
zstd, LZW and uuencoded), found by magic; sets of volumes; ZIP files written."""

from __future__ import annotations

import binascii
import bz2
import calendar
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.content import format_of

#: Bytes to which one member may expand, unless the caller says otherwise; a larger one is reported as a fault, not read.
MOST = 1 << 30

SCHEMA = "archive string, member string, kind string, size long, mtime_s long, content binary, fault string"
TOO_LARGE = "expands beyond the limit"


# ---- single packed files


def lzip_stream(data: bytes) -> io.BytesIO:
    """Members of an lzip file one after another: a header of six bytes, LZMA, a trailer of twenty."""
    out, at = io.BytesIO(), 0
    while data[at : at + 4] == b"LZIP":
        size = 1 << (data[at + 5] & 31)
        size -= (size // 16) * (data[at + 5] >> 5)
        unpack = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size}])
        body = unpack.decompress(data[at + 6 :])
        if not unpack.eof or struct.unpack_from("<I", unpack.unused_data)[0] != binascii.crc32(body):
            raise ValueError("damaged member")
        out.write(body)
        at = len(data) - len(unpack.unused_data) + 20
    out.seek(0)
    return out


def lzw_stream(data: bytes) -> io.BytesIO:
    """What ``compress`` wrote: codes of 9 bits and more, in groups of eight that a change of width ends early."""
    most, block = data[2] & 31, data[2] & 128
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    first, width, at, last, out = len(table), 9, 24, b"", io.BytesIO()
    begun = at
    end = 8 * len(data)
    while at + width <= end:
        code = int.from_bytes(data[at // 8 : at // 8 + 4], "little") >> at % 8 & (1 << width) - 1
        at += width
        if block and code == 256:
            del table[first:]
            at += -(at - begun) % (8 * width)
            width, last, begun = 9, b"", at
            continue
        if code > len(table) or not last and code >= first:
            raise ValueError("damaged codes")
        entry = table[code] if code < len(table) else last + last[:1]
        out.write(entry)
        if last and len(table) < 1 << most:
            table.append(last + entry[:1])
        last = entry
        if len(table) + (1 if len(table) < 1 << most else 0) > 1 << width and width < most:
            at += -(at - begun) % (8 * width)
            width, begun = width + 1, at
    out.seek(0)
    return out


def uue_member(data: bytes) -> tuple[str, bytes]:
    """Name and content of the first uuencoded or base64 file in a text."""
    begin = re.search(rb"(?:\A|\n)begin(-base64)? [0-7]{3,4} ([^\r\n]*)\r?\n", data)
    body, out = data[begin.end() :].splitlines(), []
    for line in body:
        if line.strip() in (b"end", b"===="):
            break
        if begin[1]:
            out.append(binascii.a2b_base64(line))
        elif line:
            out.append(binascii.a2b_uu(line))
    else:
        raise ValueError("no end")
    return begin[2].decode("utf-8", "replace"), b"".join(out)


PACKED = {
    "gzip": lambda data: gzip.GzipFile(fileobj=io.BytesIO(data)), "bzip2": lambda data: bz2.open(io.BytesIO(data)), "xz": lambda data: lzma.open(io.BytesIO(data)),
    "lzma": lambda data: lzma.open(io.BytesIO(data)), "zstd": lambda data: zstandard.open(io.BytesIO(data), "rb"), "lzip": lzip_stream, "compress": lzw_stream,
}


# ---- archives: (member, kind, size, mtime_s, a function that gives the content)


def zip_members(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            kind = "Directory" if info.is_dir() else "Symlink" if info.external_attr >> 28 == 0xA else "File"
            yield info.filename.rstrip("/"), kind, info.file_size, calendar.timegm((*info.date_time, 0, 0, 0)), lambda info=info: z.read(info)


def tar_members(data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for info in t:
            kind = "Directory" if info.isdir() else "Symlink" if info.issym() else "File"
            yield info.name, kind, info.size, int(info.mtime), lambda info=info: (t.extractfile(info) or io.BytesIO()).read()


def ar_members(data: bytes) -> Iterator[tuple]:
    """Names stand in the header, in a table of long names (GNU) or before the content (BSD); tables are no members."""
    at, names = 8, b""
    while at + 60 <= len(data):
        name, mtime, size = data[at : at + 16].rstrip(), data[at + 16 : at + 28].strip(), int(data[at + 48 : at + 58])
        if data[at + 58 : at + 60] != b"`\n" or at + 60 + size > len(data):
            raise ValueError("damaged header")
        body = data[at + 60 : at + 60 + size]
        at += 60 + size + size % 2
        if name == b"//":
            names = body
            continue
        if name in (b"/", b"/SYM64/", b"__.SYMDEF", b"__.SYMDEF SORTED"):
            continue
        if name.startswith(b"#1/"):
            length = int(name[3:])
            name, body = body[:length].rstrip(b"\0"), body[length:]
        elif name[:1] == b"/" and name[1:].isdigit():
            name = names[int(name[1:]) :].partition(b"\n")[0].rstrip(b"/")
        yield name.rstrip(b"/").decode("utf-8", "replace"), "File", len(body), int(mtime or 0), lambda body=body: body


def cpio_members(data: bytes) -> Iterator[tuple]:
    """Headers of hexadecimal (new), octal (old) or binary numbers; the last member says so."""
    at = 0
    while True:
        if data[at : at + 6] in (b"070701", b"070702"):
            n = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
            mode, mtime, size, name_size, head, unit = n[1], n[5], n[6], n[11], 110, 4
        elif data[at : at + 6] == b"070707":
            n = [int(x, 8) for x in struct.unpack_from("6s6s6s6s6s6s6s6s11s6s11s", data, at)]
            mode, mtime, name_size, size, head, unit = n[3], n[8], n[9], n[10], 76, 1
        else:
            order = {b"\xc7\x71": "<", b"\x71\xc7": ">"}.get(data[at : at + 2])
            if not order or at + 26 > len(data):
                raise ValueError("damaged header")
            n = struct.unpack_from(f"{order}13H", data, at)
            mode, mtime, name_size, size, head, unit = n[3], n[8] << 16 | n[9], n[10], n[11] << 16 | n[12], 26, 2
        name = data[at + head : at + head + name_size].rstrip(b"\0")
        begin = at + head + name_size
        begin += -(begin - at) % unit if unit != 4 else -begin % 4
        if name == b"TRAILER!!!":
            return
        if begin + size > len(data):
            raise ValueError("cut off")
        body = data[begin : begin + size]
        at = begin + size + (-size % 2 if unit == 2 else -(begin + size) % unit)
        kind = {0o040000: "Directory", 0o120000: "Symlink"}.get(mode & 0o170000, "File")
        yield name.decode("utf-8", "replace"), kind, size if kind == "File" else 0, mtime, lambda body=body: body


def iso_members(data: bytes) -> Iterator[tuple]:
    """Files of the Joliet tree, if there is one, else of the primary one; versions after ``;`` are cut."""
    trees = {}
    for sector in range(16, min(64, len(data) // 2048)):
        kind, head = data[sector * 2048], data[sector * 2048 : sector * 2048 + 2048]
        if head[1:6] != b"CD001" or kind == 255:
            break
        if kind in (1, 2):
            joliet = kind == 2 and head[88:90] == b"%/"
            if kind == 1 or joliet:
                trees[joliet] = struct.unpack_from("<I4xI", head, 158)
    wide = True in trees
    todo, seen = [("", *trees[wide])], set()
    while todo:
        above, extent, size = todo.pop()
        if extent in seen:
            continue
        seen.add(extent)
        at = begin = extent * 2048
        while at < begin + size:
            length = data[at]
            if not length:  # records don't cross sectors
                at += 2048 - at % 2048
                continue
            where, n = struct.unpack_from("<I4xI", data, at + 2)
            raw = data[at + 33 : at + 33 + data[at + 32]]
            when, flags = data[at + 18 : at + 25], data[at + 25]
            at += length
            if raw in (b"\0", b"\1"):
                continue
            name = above + raw.decode("utf-16-be" if wide else "latin-1").partition(";")[0].rstrip("." if not wide else "")
            mtime = calendar.timegm((1900 + when[0], *when[1:6], 0, 0, 0)) - 900 * struct.unpack("b", when[6:7])[0]
            if flags & 2:
                yield name, "Directory", 0, mtime, bytes
                todo.append((name + "/", where, n))
            else:
                if where * 2048 + n > len(data):
                    raise ValueError("cut off")
                yield name, "File", n, mtime, lambda where=where, n=n: data[where * 2048 : where * 2048 + n]


MEMBERS = {"zip": zip_members, "tar": tar_members, "ar": ar_members, "cpio": cpio_members, "iso": iso_members}


def members_of(name: str, data: bytes, content: bool, most: int = MOST) -> Iterator[tuple]:
    """(member, kind, size, mtime_s, content, fault) of an archive; a member that is too large or damaged is a fault, and
    the next one follows."""
    kind = format_of(data)
    base = name.rpartition("/")[2]
    if kind in PACKED:
        with PACKED[kind](data) as stream:
            plain = stream.read(most + 1)
        inner = base.rpartition(".")[0] or base
        if len(plain) > most:
            yield inner, "File", None, None, None, TOO_LARGE
            return
        if format_of(plain) != "tar":
            yield inner, "File", len(plain), None, plain if content else None, None
            return
        kind, data = "tar", plain
    if kind == "uue":
        inner, plain = uue_member(data)
        yield inner, "File", len(plain), None, plain if content else None, None
        return
    if kind not in MEMBERS:
        raise ValueError("no known format" if kind is None else f"members of {kind} aren't read")
    for member, what, size, mtime, body in MEMBERS[kind](data):
        fault = TOO_LARGE if size > most else None
        raw = None
        if content and what == "File" and not fault:
            try:
                raw = body()
            except Exception as damage:  # any library's complaint about one member
                fault = f"{type(damage).__name__}: {damage}"[:200]
        yield member, what, size, mtime, raw, fault


def read_archives(archives: DataFrame, content: bool = False, most: int = MOST) -> DataFrame:
    """Members of archives (path, content): a damaged or unknown one gives the members before the damage and a
    row with its fault; a member beyond ``most`` bytes has a fault and no content.  Nothing is written, so paths that
    climb out of a folder do no harm here."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        framed = lambda rows: pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime_s": "Int64"})
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                rows, held = [], 0
                try:
                    for member in members_of(path, bytes(data) if data is not None else b"", content, most):
                        rows.append((path, *member))
                        held += len(member[4] or b"") + 200
                        if held > 16_000_000:
                            yield framed(rows)
                            rows, held = [], 0
                except Exception as fault:  # any library's complaint about damaged input
                    rows.append((path, None, None, None, None, None, f"{type(fault).__name__}: {fault}"[:200]))
                yield framed(rows)

    return archives.select("path", "content").mapInPandas(read, SCHEMA)


# ---- volumes


def volume_sets(files: DataFrame) -> DataFrame:
    """(set, volume, path, complete): files that are parts of one archive, numbered from 1 in order.

    Names of parts: ``x.7z.001`` (any extension before the number), ``x.part1.rar``, ``x.r00`` after ``x.rar``, and
    ``x.z01`` before ``x.zip``.  A set is complete if no number is missing and, for the last two, the file with the
    plain name is there; sets of one file are none.  files: path.
    """
    names = r"(?i)^(.*?)(?:\.(\d{3})|\.part(\d+)\.rar|\.r(\d\d)|(\.rar)|\.z(\d\d)|(\.zip))$"
    found = files.select("path", F.regexp_extract("path", names, 1).alias("stem"), *[F.nullif(F.regexp_extract("path", names, i), F.lit("")).alias(c) for i, c in enumerate(("split", "part", "r", "rar", "z", "zip"), 2)])
    kind = F.when(F.col("split").isNotNull(), "split").when(F.col("part").isNotNull(), "rar parts").when(F.coalesce("r", "rar").isNotNull(), "rar").when(F.coalesce("z", "zip").isNotNull(), "zip")
    # The file with the plain name is the first of its RAR set and the last of its ZIP set, however many there are.
    place = F.when(F.col("rar").isNotNull(), 1).when(F.col("zip").isNotNull(), 1 << 20).otherwise(F.coalesce("split", "part", "r", "z").cast("int") + F.when(F.col("r").isNotNull(), 2).otherwise(0))
    parts = found.select("path", "stem", kind.alias("kind"), place.alias("place")).where("kind is not null")
    sets = parts.groupBy("stem", "kind").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.countDistinct("place").alias("different"))
    plain = F.when(F.col("kind") == "zip", F.col("high") == 1 << 20).otherwise(F.lit(True))
    last = F.when((F.col("kind") == "zip") & (F.col("high") == 1 << 20), F.col("n")).otherwise(F.col("high"))
    sets = sets.where("n > 1").withColumn("complete", (F.col("low") == 1) & plain & (last == F.col("n")) & (F.col("different") == F.col("n")))
    order = W.partitionBy("stem", "kind").orderBy("place", "path")
    return parts.join(sets.select("stem", "kind", "complete"), ["stem", "kind"]).select(F.concat_ws(" ", "stem", F.concat(F.lit("("), "kind", F.lit(")"))).alias("set"), F.row_number().over(order).alias("volume"), "path", "complete")


def joined_volumes(volumes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content): the volumes of complete sets laid end to end, as plain splitting parted them.  files: path, content."""
    rows = volumes.where("complete").join(files.select("path", "content"), "path")
    listed = F.array_sort(F.collect_list(F.struct("volume", "content")))  # one file, as it was
    return rows.groupBy(F.col("set").alias("path")).agg(listed.alias("v")).select("path", F.aggregate("v", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"))


# ---- writing


def write_zips(files: DataFrame, folder: str, by: str = "archive") -> DataFrame:
    """A ZIP per group of files (archive, member, content) below a folder that executors share: path, members, bytes.

    Members are written as they come, in name order, so a task holds a batch of them and never an archive."""
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, archive, done, n = None, None, None, [], 0
        part = f"{root}/.{TaskContext.get().taskAttemptId()}.part"

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()
                system.move(part, f"{root}/{name}")
                done.append((name, n, system.get_file_info(f"{root}/{name}").size))

        for frame in frames:
            for group, member, content in zip(frame[by], frame["member"], frame["content"]):
                if group != name:
                    close()
                    name, n, out = group, 0, system.open_output_stream(part)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
                n += 1
        close()
        yield pd.DataFrame(done, columns=["path", "members", "bytes"])

    rows = files.select(by, "member", "content").repartition(parts, by).sortWithinPartitions(by, "member")
    return rows.mapInPandas(packed, "path string, members long, bytes long")
