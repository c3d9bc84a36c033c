"""Recovery shards: Reed-Solomon over groups of shards of files, scans for damage, and repair."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import modest_batches

#: Data shards of a group and bytes of a shard, unless told otherwise; the most that a group may have, with its recovery
#: shards, in a field of 256; the most that recovery may take, in percent.
GROUP, LENGTH, MOST, MOST_PERCENT = 64, 1 << 16, 256, 20


# ---- the field of 256 elements, by the polynomial x^8 + x^4 + x^3 + x^2 + 1


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Products of all pairs, and inverses (0 has none and stands as 0)."""
    power, log = np.zeros(510, np.int64), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    product = power[log[:, None] + log[None, :]]
    product[0], product[:, 0] = 0, 0
    inverse = power[255 - log]
    inverse[0] = 0
    return product.astype(np.uint8), inverse.astype(np.uint8)


def cauchy(recovery: int, data: int) -> np.ndarray:
    """Rows of recovery shards by columns of data shards: 1 / (x + y) of different x and y, so that every square part
    of it has an inverse."""
    if recovery + data > MOST:
        raise ValueError(f"a group has {MOST} shards at most")
    return tables()[1][np.arange(data, data + recovery)[:, None] ^ np.arange(data)[None, :]]


def times(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """The product of a matrix and rows of bytes."""
    product, out = tables()[0], np.zeros((len(matrix), shards.shape[1]), np.uint8)
    for column, shard in zip(matrix.T, shards):
        out ^= product[column[:, None], shard[None, :]]
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    product, inverse = tables()
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n, dtype=np.uint8)])
    for i in range(n):
        pivot = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = product[inverse[work[i, i]], work[i]]
        for j in range(n):
            if j != i and work[j, i]:
                work[j] ^= product[work[j, i], work[i]]
    return work[:, n:]


def encode(shards: np.ndarray, recovery: int) -> np.ndarray:
    return times(cauchy(recovery, len(shards)), shards)


def rebuild(shards: np.ndarray, lost: list[int], recovery: dict[int, np.ndarray], total: int) -> np.ndarray:
    """The lost rows of ``shards`` from as many of the ``total`` recovery shards, given by number."""
    use = sorted(recovery)[: len(lost)]
    if len(use) < len(lost):
        raise ValueError("more shards are lost than can be rebuilt")
    matrix = cauchy(total, len(shards))[use]
    there = np.delete(np.arange(len(shards)), lost)
    rest = np.stack([recovery[u] for u in use]) ^ times(matrix[:, there], shards[there])
    return times(inverted(matrix[:, lost]), rest)


# ---- operators


def shards_of(files: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(path, grp, shard, data, hash): the bytes of files (path, content) in shards, the last shorter, in groups of so many.

    An empty or null file has none.
    """
    count = F.ceil(F.octet_length("content") / length).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1))
    rows = files.where(F.octet_length("content") > 0).select("path", F.col("content").cast("binary").alias("content"), at.alias("n"))
    data = F.substring("content", F.col("n") * length + 1, F.lit(length))
    return rows.select("path", F.floor(F.col("n") / group).cast("int").alias("grp"), (F.col("n") % group).cast("int").alias("shard"), data.alias("data")).withColumn("hash", F.sha2("data", 256))


def padded(values, length: int) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(v if v is not None else b"").ljust(length, b"\0")[:length], np.uint8) for v in values])


def gathered(shards: DataFrame) -> DataFrame:
    """(path, grp, at, data, hash): the shards of a group as arrays in order of their numbers, where there is a hash with it."""
    columns = [c for c in ("shard", "data", "hash") if c in shards.columns]
    held = shards.groupBy("path", "grp").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("held"))
    return held.select("path", "grp", *[F.col(f"held.{c}").alias("at" if c == "shard" else c) for c in columns])


def parts(column: pa.Array) -> list[list]:
    """Arrays of a batch as lists; none for null."""
    flat, ends = column.flatten().to_pylist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[x:y] for x, y in zip([0, *ends], ends)]


def side_by_side(groups: list[list[bytes | None]], length: int) -> np.ndarray:
    """Groups of as many shards as rows of bytes, one group beside the other: what is computed for one row is for all."""
    raw = b"".join((d or b"").ljust(length, b"\0")[:length] for group in groups for d in group)
    return np.frombuffer(raw, np.uint8).reshape(len(groups), -1, length).transpose(1, 0, 2).reshape(-1, len(groups) * length)


def room(length: int) -> int:
    """The power of two from ``length`` on: groups of so many bytes are computed together, zeros behind them changing nothing."""
    return 1 << max(0, length - 1).bit_length()


def encoded(groups: list[list[bytes]], percent: int) -> list[list[bytes]]:
    """The recovery shards of each group, as long as its longest shard."""
    alike, out = defaultdict(list), [[] for _ in groups]
    for i, group in enumerate(groups):
        alike[len(group), room(max(map(len, group)))].append(i)
    for (n, length), several in alike.items():
        made = encode(side_by_side([groups[i] for i in several], length), max(1, -(-n * percent // 100)))
        made = made.reshape(-1, len(several), length)
        for j, i in enumerate(several):
            own = max(map(len, groups[i]))
            out[i] = [row[j, :own].tobytes() for row in made]
    return out


def protect(shards: DataFrame, percent: int = 10) -> DataFrame:
    """A frame per group of :func:`shards_of`: path, grp, length, hashes and sizes of its shards, recovery shards, and hash, which
    covers all of these.  A group has a recovery shard at least."""
    if not 1 <= percent <= MOST_PERCENT:
        raise ValueError(f"recovery takes 1 to {MOST_PERCENT} percent")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, hashes = parts(batch.column("data")), parts(batch.column("hash"))
            recovery = encoded(groups, percent)
            lengths, sizes = [max(map(len, g)) for g in groups], [list(map(len, g)) for g in groups]
            own = [frame_hash(*x) for x in zip(lengths, hashes, sizes, recovery)]
            columns = [pa.array(lengths, pa.int32()), pa.array(hashes, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32())), pa.array(recovery, pa.list_(pa.binary())), pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("grp"), *columns], names=["path", "grp", "length", "hashes", "sizes", "recovery", "hash"])

    modest_batches(shards.sparkSession)
    kind = shards.schema["path"].dataType.simpleString()
    return gathered(shards.select("path", "grp", "shard", "data", "hash")).mapInArrow(framed, f"path {kind}, grp int, length int, hashes array<string>, sizes array<int>, recovery array<binary>, hash string")


def frame_hash(length: int, hashes, sizes, recovery) -> str:
    head = f"{length};{','.join(hashes)};{','.join(str(int(s)) for s in sizes)};".encode()
    return hashlib.sha256(head + b"".join(bytes(r) for r in recovery)).hexdigest()


def checked(frames: DataFrame) -> DataFrame:
    """The frames with ``usable``: whether a frame's own hash holds."""

    @F.pandas_udf("boolean")
    def usable(length: pd.Series, hashes: pd.Series, sizes: pd.Series, recovery: pd.Series, hash: pd.Series) -> pd.Series:
        return pd.Series([frame_hash(int(n), h, s, r) == want for n, h, s, r, want in zip(length, hashes, sizes, recovery, hash)], dtype=bool)

    return frames.withColumn("usable", usable("length", "hashes", "sizes", "recovery", "hash"))


def scan(frames: DataFrame, shards: DataFrame) -> DataFrame:
    """Per frame: path, grp, usable, shards, damaged (those that are missing or whose bytes have another hash).

    What an unusable frame would say of its shards isn't known: it is counted and its shards are not.
    """
    known = checked(frames).select("path", "grp", "usable", F.size("hashes").alias("shards"), F.posexplode("hashes").alias("shard", "want"))
    have = shards.select("path", "grp", "shard", F.sha2("data", 256).alias("have"))
    bad = F.col("have").isNull() | (F.col("have") != F.col("want"))
    return known.join(have, ["path", "grp", "shard"], "left").groupBy("path", "grp", "usable", "shards").agg(F.count_if(F.col("usable") & bad).alias("damaged"))


def mended(frames: list[dict | None], groups: list[dict]) -> list[tuple[list, list]]:
    """Of each group (number: bytes) by its usable frame the shards' bytes and states; groups that lost the same shards are
    rebuilt together."""
    out, alike = [], defaultdict(list)
    for i, (f, have) in enumerate(zip(frames, groups)):
        if f is None:
            out.append(([], []))
            continue
        data = [have.get(k) for k in range(len(f["hashes"]))]
        data = [d if d is not None and hashlib.sha256(d).hexdigest() == h else None for d, h in zip(data, f["hashes"])]
        lost = tuple(k for k, d in enumerate(data) if d is None)
        out.append((data, ["lost" if d is None else "whole" for d in data]))
        if lost and len(lost) <= len(f["recovery"]):
            alike[len(data), len(f["recovery"]), lost, room(f["length"])].append(i)
    for (_, total, lost, length), several in alike.items():
        extra = side_by_side([frames[i]["recovery"] for i in several], length)
        rows = rebuild(side_by_side([out[i][0] for i in several], length), list(lost), dict(enumerate(extra)), total).reshape(len(lost), -1, length)
        for j, i in enumerate(several):
            for k, row in zip(lost, rows):
                raw = row[j].tobytes()[: frames[i]["sizes"][k]]
                if hashlib.sha256(raw).hexdigest() == frames[i]["hashes"][k]:
                    out[i][0][k], out[i][1][k] = raw, "rebuilt"
    return out


def repair(frames: DataFrame, shards: DataFrame) -> DataFrame:
    """The shards (path, grp, shard, data, state) as far as they are whole or can be rebuilt; state: whole, rebuilt, lost, or
    unknown where the frame is unusable.  A group is held by one task: its size is bounded by the field."""
    inner = ["length", "hashes", "sizes", "recovery", "hash"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("length").to_pylist(), *[parts(batch.column(c)) for c in inner[1:4]], batch.column("hash").to_pylist()]
            known = [dict(zip(inner[:4], f)) if f[0] is not None and frame_hash(*f[:4]) == f[4] else None for f in zip(*columns)]
            at, data = parts(batch.column("at")), parts(batch.column("data"))
            found = mended(known, [dict(zip(k, d)) if f else {} for f, k, d in zip(known, at, data)])
            whole = [(range(len(done)), done, states) if f else (k, d, ["unknown"] * len(k)) for f, k, d, (done, states) in zip(known, at, data, found)]
            of = pa.array(np.repeat(np.arange(len(whole)), [len(w[0]) for w in whole]))
            flat = [list(chain.from_iterable(c)) for c in zip(*whole)] or [[], [], []]
            columns = [batch.column("path").take(of), batch.column("grp").take(of), pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.binary()), pa.array(flat[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "grp", "shard", "data", "state"])

    modest_batches(shards.sparkSession)
    kind = shards.schema["path"].dataType.simpleString()
    one = frames.select("path", "grp", *inner).alias("f")
    held = gathered(shards.select("path", "grp", "shard", "data")).alias("s")
    same = F.col("f.path").eqNullSafe(F.col("s.path")) & F.col("f.grp").eqNullSafe(F.col("s.grp"))
    key = [F.coalesce(f"f.{c}", f"s.{c}").alias(c) for c in ("path", "grp")]
    return one.join(held, same, "full_outer").select(*key, *inner, "at", "data").mapInArrow(told, f"path {kind}, grp int, shard int, data binary, state string")
