"""Packing token ids into windows by non-negative least squares over the histogram of lengths.

Shallow combinations of two or three lengths that fill a window are enumerated; how often each is used is solved
for against the histogram, rounded, and what remains is packed greedily: first in exact fills, then as a stream
that is cut at the windows' ends.  The plan speaks of lengths and ranks only, so it is small whatever the input;
documents find their place in it by the rank they have among those of their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm import tokens
from granary.llm.common import fresh_path, modest_batches, stored

WINDOW = 4096
#: Second lengths tried for each first length of a triple, steps of the solver, and the bit where ranks end in a key.
PARTNERS, STEPS, RANK = 24, 200, 44


# ---- the plan, on the driver


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of lengths that fill the window, as rows of three (0: none), without repeats.

    All pairs are tried; of triples those whose second length is one of the ``PARTNERS`` commonest.  That bounds the
    system to solve and loses no document: what no combination takes goes into the stream.
    """
    have = np.flatnonzero(hist)
    common = have[np.argsort(-hist[have], kind="stable")][:PARTNERS]
    a, b = np.meshgrid(have, common, indexing="ij")
    c = window - a - b
    ok = (c > 0) & (hist[np.clip(c, 0, window)] > 0)
    triples = np.sort(np.stack([a[ok], b[ok], c[ok]], 1), 1)
    pairs = np.stack([np.zeros(len(have), np.int64), have, window - have], 1)[(hist[window - have] > 0) & (2 * have <= window)]
    rows = np.concatenate([triples.reshape(-1, 3), pairs.reshape(-1, 3)]).astype(np.int64)
    return np.unique(rows, axis=0) if len(rows) else rows


def solve(rows: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Non-negative least squares for the repeats of each combination, by multiplicative steps."""
    if not len(rows):
        return np.zeros(0)
    weight = (rows > 0).astype(float)
    times = lambda x: np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), len(hist))
    back = lambda y: (y[rows] * weight).sum(1)
    goal, x = back(hist.astype(float)), np.ones(len(rows)) * hist.sum() / len(rows) / 3
    for _ in range(STEPS):
        x *= goal / np.maximum(back(times(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Where the document of a given length and rank goes.

    A segment starts at ``keys`` (length << RANK | rank) and either gives each rank a sequence of its own from
    ``base`` on, at ``offset``, or (offset -1) lays them end to end in the stream from position ``base`` on.
    """

    window: int
    keys: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    stream_at: int
    cuts: np.ndarray  # ends of the stream's last, shorter sequences
    full: int  # of the stream's sequences so many are whole windows

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces."""
        key = length << RANK | rank
        i = int(np.searchsorted(self.keys, key, "right")) - 1
        if self.offset[i] >= 0:
            return [(int(self.base[i]) + key - int(self.keys[i]), int(self.offset[i]), length)]
        at = int(self.base[i]) + (key - int(self.keys[i])) * length
        out, end = [], at + length
        while at < end:
            n = at // self.window
            if n < self.full:
                start, stop = n * self.window, (n + 1) * self.window
            else:
                j = int(np.searchsorted(self.cuts, at, "right"))
                start, stop, n = int(self.cuts[j - 1]) if j else self.full * self.window, int(self.cuts[j]), self.full + j
            take = min(end, stop) - at
            out.append((self.stream_at + n, at - start, take))
            at += take
        return out


def make_plan(hist: np.ndarray, first: int = 0, window: int = WINDOW) -> Plan:
    """``hist[n]``: documents whose rest has length n (0 < n < window).  Sequences are numbered from ``first``."""
    left, used = hist.astype(np.int64).copy(), np.zeros(window + 1, np.int64)
    left[0] = left[window] = 0
    segments: list[tuple[int, int, int]] = []
    following = first

    def use(lengths: list[int], n: int) -> None:
        nonlocal following
        offset = 0
        for length in lengths:
            segments.append((length << RANK | int(used[length]), following, offset))
            used[length] += n
            left[length] -= n
            offset += length
        following += n

    def room(lengths: list[int]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in lengths)

    rows = combinations(left, window)
    x = solve(rows, left)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths = sorted((int(v) for v in rows[i] if v), reverse=True)
        if n := min(round(float(x[i])), room(lengths)):
            use(lengths, n)
    # What rounding leaves: the longest first, filled with the longest that fit.
    loose: list[int] = []
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            lengths, space = [longest], window - longest
            while space:
                free = left[: min(space, longest) + 1].copy()
                for length in lengths:
                    if length < len(free):
                        free[length] -= 1
                fits = np.flatnonzero(free > 0)
                if not len(fits):
                    break
                # One length that fills the window, else two that do, else the longest that fits.
                other = space - fits
                second = np.where(other < len(free), free[np.minimum(other, len(free) - 1)], 0)
                done = fits[second > (other == fits)]
                take = space if fits[-1] == space else int(done[-1]) if len(done) else int(fits[-1])
                lengths.append(take)
                space -= take
            n = room(lengths) if not space else 0
            if not n:
                loose.append(longest)
                break
            use(lengths, n)
    at = 0
    for length in loose:
        if left[length]:
            segments.append((length << RANK | int(used[length]), at, -1))
            at += length * int(left[length])
    full, tail = divmod(at, window)
    # A sequence whose length is a power of two needs no padding, so the tail becomes such ones.
    bits = [1 << b for b in range(window.bit_length(), -1, -1) if tail >> b & 1]
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 3)
    return Plan(window, table[:, 0], table[:, 1], table[:, 2], following, full * window + np.cumsum(bits, dtype=np.int64), full)


# ---- the operator


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A stored table of rid, doc_id, n and ids (two or four bytes each) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        width = 2 if max(end_id, encode.tokenizer.get_vocab_size(with_added_tokens=True)) < 1 << 16 else 4
        for batch in batches:
            for first, ids, ends in encode(batch.column("text"), end_id):
                part = batch.slice(first, len(ends))
                raw = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
                offsets = np.append(0, ends)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(np.diff(offsets)), binary.cast(pa.binary())], names=["rid", "doc_id", "n", "ids"])

    spark = docs.sparkSession
    out = rows.mapInArrow(encoded, "rid long, doc_id long, n long, ids binary")
    path_out = fresh_path(spark, "pack-ids")
    out.write.option("compression", "zstd").parquet(path_out)
    return spark.read.schema(out.schema).parquet(path_out)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (32-bit, little-endian), doc_tokens, sequence_id, offset.

    Whole windows of a document are sequences of their own; its rest goes where the plan says, whole or (in the
    stream) cut at a window's end.  A null text is empty and still has its end id; repeated rows are packed
    each; a null id stays null; an empty table gives no pieces; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    table = tokenized(docs, vocabulary, end_id, text_col, id_col)
    lengths = table.select("rid", "n", (F.col("n") % window).cast("int").alias("rest"), F.floor(F.col("n") / window).cast("long").alias("wholes"))
    hist = np.zeros(window + 1, np.int64)
    n_docs = n_wholes = 0
    for row in lengths.groupBy("rest").agg(F.count("*").alias("n"), F.sum("wholes").alias("w")).collect():  # a row per length
        hist[row["rest"]] = row["n"]
        n_docs, n_wholes = n_docs + row["n"], n_wholes + row["w"]
    plan = make_plan(hist, n_wholes, window)

    # Ranks by length, and numbers of whole windows: by hash bucket first, so that a length that fills a third
    # of the table is counted in many tasks.
    buckets = min(1 << 16, max(8, math.ceil(n_docs / 2000)))
    dealt = lengths.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    by_class = dealt.groupBy("rest", "bucket").agg(F.count("*").alias("c"), F.sum("wholes").alias("w"))
    before = lambda what, *by: F.coalesce(F.sum(what).over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = by_class.withColumn("rank0", before("c", "rest"))
    whole0 = by_class.groupBy("bucket").agg(F.sum("w").alias("w"))
    whole0 = whole0.select("bucket", F.coalesce(F.sum("w").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("whole0"))
    in_bucket = W.partitionBy("bucket").orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    in_class = W.partitionBy("bucket", "rest").orderBy("rid")
    starts = stored(ranks.select("rest", "bucket", "rank0"), "pack-ranks")
    placed = (
        dealt.join(starts, ["bucket", "rest"])
        .join(stored(whole0, "pack-wholes"), "bucket")
        .select(
            "rid",
            (F.col("rank0") + F.row_number().over(in_class) - 1).alias("rank"),
            (F.col("whole0") + F.coalesce(F.sum("wholes").over(in_bucket), F.lit(0))).alias("whole"),
        )
    )
    joined = table.join(stored(placed, "pack-places"), "rid").select("doc_id", "n", "ids", "rank", "whole")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, min(500, batch.num_rows - at))
                rows, ids = [], []
                for ident, n, raw, rank, whole in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "ids", "rank", "whole"))):
                    width = len(raw) // n
                    wide = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    pieces = [(whole + i, 0, window) for i in range(n // window)]
                    if n % window:
                        pieces += plan.place(n % window, rank)
                    start = 0
                    for sequence, offset, length in pieces:
                        rows.append((ident, start, length, n, sequence, offset))
                        ids.append(wide[4 * start : 4 * (start + length)])
                        start += length
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])

    return joined.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
