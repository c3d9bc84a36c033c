"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard holds documents in ascending order of key.  Its blocks (about ``BLOCK`` bytes before zstd) hold entries of
shared prefix length, rest of the key, and ids; the index holds each block's first key and place; the footer, of
fixed length, tells where index and filter are.  A lookup reads footer, filter and index, then a single block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm import tokens
from granary.llm.common import fresh_path, modest_batches, spread, stored

MAGIC, BLOCK, BITS, HASHES = b"GRSST01\n", 1 << 16, 10, 7
#: Bytes of text, each document counting as 64 more, from which there are more shards than tasks of a shuffle.
SHARD = 64 << 20
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, its length, filter at, its length, entries, ids, bytes an id, magic


# ---- keys


def key_of(ident: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null, as no bytes, comes first."""
    return b"" if ident is None else struct.pack(">Q", ident + (1 << 63))


def ident_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


# ---- Bloom filter


def probes(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key)
    b = zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def bloom(keys: list[bytes]) -> bytes:
    field = bytearray(max(8, len(keys) * BITS // 8 + 1))
    for key in keys:
        for p in probes(key, 8 * len(field)):
            field[p >> 3] |= 1 << (p & 7)
    return bytes(field)


def maybe(field: bytes, key: bytes) -> bool:
    return all(field[p >> 3] >> (p & 7) & 1 for p in probes(key, 8 * len(field)))


# ---- shards


class Writer:
    """Writes entries, given in order, to an open binary stream."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.pack = stream, width, zstandard.ZstdCompressor(level=1)
        self.at = self.ids = self.held = self.count = 0
        self.block: list[bytes] = []
        self.last = self.first = b""
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        n = len(value) // self.width
        self.block.append(varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:] + value)
        self.held += len(value)
        self.count, self.last, self.ids = self.count + 1, key, self.ids + n
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.held >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            packed = self.pack.compress(raw)
            self.index.append((self.first, self.at, len(packed), len(raw), zlib.crc32(raw)))
            self.put(packed)
            self.block, self.held = [], 0

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush()
        places = [self.at]
        self.put(b"".join(varint(len(k)) + k + b"".join(map(varint, rest)) for k, *rest in self.index))
        places += [self.at - places[0], self.at]
        self.put(bloom(self.keys))
        places.append(self.at - places[2])
        self.put(FOOTER.pack(*places, self.count, self.ids, self.width, MAGIC))
        self.stream.close()


class Table:
    """Reads a shard from a file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        at, length, b_at, b_length, self.count, self.ids, self.width, magic = FOOTER.unpack(self.part(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: no footer")
        raw, self.field, p = self.part(at, length), self.part(b_at, b_length), 0
        self.index = []
        while p < len(raw):
            n, p = read_varint(raw, p)
            key, p = raw[p : p + n], p + n
            rest = []
            for _ in range(4):
                value, p = read_varint(raw, p)
                rest.append(value)
            self.index.append((key, *rest))
        self.firsts = [x[0] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor()

    def part(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length, size, crc = self.index[i]
        raw = self.unpack.decompress(self.part(at, length), max_output_size=size)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        p, last = 0, b""
        while p < len(raw):
            shared, p = read_varint(raw, p)
            rest, p = read_varint(raw, p)
            n, p = read_varint(raw, p)
            last = last[:shared] + raw[p : p + rest]
            p += rest
            yield last, np.frombuffer(raw, f"<u{self.width}", n, p)
            p += n * self.width

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier (none, if it isn't here)."""
        key = key_of(ident)
        if not self.index or not maybe(self.field, key):
            return []
        found = []
        for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.index)):
            if self.firsts[i] > key:
                break
            found += [ids.copy() for k, ids in self.block(i) if k == key]
        return found


def opened(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


# ---- operators


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 1, shards: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards; returns their manifest.

    Manifest: shard, path, entries, ids, bytes, first, last (keys).  There are as many as tasks of a shuffle, or so many
    that each holds about ``SHARD`` bytes of text, which bounds what a task keeps.  Shards are ranges of (id, hash of the text, text), so shard order and
    order within give ascending ids, and repeated ids stand in a defined order.  A null text is empty; null
    ids come first; an empty table gives no shards; other columns are ignored.  Each attempt of a task writes
    a file of its own and only the manifest's files count, so lost executors leave nothing wrong behind.
    """
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    if shards is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64)).first()[0] or 0
        shards = max(spread(spark), -(-size // SHARD))
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, name = TaskContext.get(), None, ""
        encode = tokens.encoder(vocabulary)
        # Two bytes hold an id of any vocabulary of up to 65,536 entries.
        width = 2 if max(end_id, encode.tokenizer.get_vocab_size(with_added_tokens=True)) < 1 << 16 else 4
        for batch in batches:
            if writer is None and batch.num_rows:
                name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
                system, at = fs.FileSystem.from_uri(name)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                writer = Writer(system.open_output_stream(at), width)
            idents = batch.column("doc_id").to_pylist()
            for first, ids, ends in encode(batch.column("text"), end_id):
                raw, start = ids.astype(f"<u{width}").tobytes(), 0
                for i, end in enumerate(ends.tolist()):
                    writer.add(key_of(idents[first + i]), raw[width * start : width * end])
                    start = end
        if writer is not None:
            writer.close()
            made = {"shard": [task.partitionId()], "path": [name], "entries": [writer.count], "ids": [writer.ids], "bytes": [writer.at], "first": [writer.keys[0]], "last": [writer.keys[-1]]}
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_pydict(made, pa.schema(list(zip(made, kinds))))

    return stored(ranged.mapInArrow(write, "shard int, path string, entries long, ids long, bytes long, first binary, last binary"), "shard-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of the shards, read from the files: doc_id, start, n_tokens, ids (32-bit, little-endian)."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard
    starts = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame_of(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
            return out.astype({"doc_id": "Int64"})

        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                rows, held = [], 0
                with opened(path) as file:
                    for key, ids in Table(file).scan():
                        rows.append((ident_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held > 8_000_000:
                            yield frame_of(rows)
                            rows, held = [], 0
                if rows:
                    yield frame_of(rows)

    spark = manifest.sparkSession
    return starts.select("path", "start").repartition(spread(spark)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, ident: int | None) -> list[np.ndarray]:
    """Ids of one document, by binary search in the shards whose range holds its key: one, or where a repeated id
    lies across a border, its neighbours too."""
    found, key = [], F.lit(key_of(ident))
    for row in manifest.where((F.col("first") <= key) & (key <= F.col("last"))).orderBy("shard").select("path").collect():
        with opened(row["path"]) as file:
            found += Table(file).get(ident)
    return found


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
