"""Chunks, content addresses, and what deduplication saves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.store import numbered, stored


def fixed_chunks(files: DataFrame, size: int = 1024, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Chunks of ``size`` characters, the last shorter: keys, pos, content, len, hash.  An empty file has none."""
    if size < 1:
        raise ValueError("chunks need a size")
    count = F.ceil(F.length("content") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))
    rows = files.where(F.length("content") > 0).select(*keys, F.posexplode(cut).alias("pos", "content"))
    return rows.select(*keys, "pos", "content", F.length("content").cast("long").alias("len"), F.sha2("content", 256).alias("hash"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("hash", "len").distinct()


def store(chunks: DataFrame, *order: str) -> DataFrame:
    """(hash, len, first): chunks once each, with the place of their first occurrence in order."""
    return chunks.groupBy("hash", "len").agg(F.min(F.struct(*order)).alias("first"))


def known(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks (hash, len, ord) with where they come from: the old table, an earlier new one, or themselves."""
    first = new.groupBy("hash", "len").agg(F.min("ord").alias("first"))
    there = old.groupBy("hash", "len").agg(F.min("chunk").alias("chunk"))
    found = new.join(there, ["hash", "len"], "left").join(first, ["hash", "len"])
    state = F.when(F.col("chunk").isNotNull(), "old").when(F.col("first") < F.col("ord"), "repeated").otherwise("new")
    return found.select("ord", "hash", "len", state.alias("state"), F.coalesce("chunk", "first").alias("source"))


def writer_counts(judged: DataFrame) -> DataFrame:
    """Of :func:`known`'s rows: chunks written, reused from the old table, deduplicated, and bytes saved."""
    return judged.agg(
        F.count_if(F.col("state") == "new").alias("written"),
        F.count_if(F.col("state") == "old").alias("reused"),
        F.count_if(F.col("state") == "repeated").alias("deduped"),
        F.coalesce(F.sum(F.when(F.col("state") != "new", F.col("len"))), F.lit(0)).alias("saved"),
    )


def by_hash(chunks: DataFrame) -> DataFrame:
    """hash -> its first chunk."""
    return chunks.groupBy("hash").agg(F.min("chunk").alias("chunk"))


def savings(files: DataFrame, chunks: DataFrame, corpus: bool = True) -> DataFrame:
    """Per class (and over all, as ``(corpus)``): files, bytes, duplicates, chunks and distinct chunks.

    files: class, size, hash; chunks: class, len, hash.  Each is read once, made distinct by class, and then by
    class and over all in one grouping, so the distinct counts are plain sums, and the corpus counts across
    classes rather than adding theirs up.  A class has no null name.
    """

    label = F.coalesce("class", F.lit("(corpus)"))
    levels = (lambda df, *keys: df.groupingSets([["class", *keys], list(keys)], "class", *keys)) if corpus else (lambda df, *keys: df.groupBy("class", *keys))
    sized = files.groupBy("class", "hash", "size").agg(F.count("*").alias("c"))
    f = levels(sized, "hash", "size").agg(F.sum("c").alias("n")).groupBy(label.alias("class")).agg(
        F.sum("n").alias("files"),
        F.sum(F.col("n") * F.col("size")).alias("bytes"),
        F.sum(F.col("n") - 1).alias("dup_files"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("dup_bytes"),
    )
    pieces = chunks.groupBy("class", "hash", "len").agg(F.count("*").alias("c"))
    c = levels(pieces, "hash", "len").agg(F.sum("c").alias("n")).groupBy(label.alias("class")).agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum("len").alias("unique_chunk_bytes"))
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("chunks", "unique_chunks", "unique_chunk_bytes")]
    return f.join(c, "class", "left").select("class", "files", "bytes", "dup_files", "dup_bytes", *zero)


def growth(chunks: DataFrame) -> DataFrame:
    """Per version (rank): new distinct chunks and bytes, and the running totals."""
    first = chunks.groupBy("hash", "len").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count("*").alias("new_chunks"), F.sum("len").alias("new_bytes"))
    every = chunks.select("rank").distinct().join(new, "rank", "left").select("rank", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new_chunks", "new_bytes")])
    so_far = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # a row per version
    return every.withColumns({"chunks": F.sum("new_chunks").over(so_far), "bytes": F.sum("new_bytes").over(so_far)})


def first_seen(chunks: DataFrame, *order: str) -> DataFrame:
    """Chunk rows with whether each is the first of its hash in order."""
    first = chunks.groupBy("hash").agg(F.min(F.struct(*order)).alias("lead"))
    return chunks.join(first, "hash").withColumn("first", F.struct(*order) == F.col("lead")).drop("lead")


def places(members: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where every chunk of every file lies: path, pos, chunk, block, in_block, in_file, len.

    members: path, pos, chunk; chunks: chunk, len; blocks: block, first, n.  Blocks are ranges of chunk numbers;
    the range join goes by the block's chunks spelt out, which is as many rows as there are chunks.
    """
    spelt = blocks.select("block", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("chunk"))
    before = lambda by, order: F.coalesce(F.sum("len").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    located = chunks.join(spelt, "chunk").withColumn("in_block", before("block", "chunk"))
    return members.join(located, "chunk").withColumn("in_file", before("path", "pos")).select("path", "pos", "chunk", "block", "in_block", "in_file", "len")


def in_range(placed: DataFrame, offset: int, length: int) -> DataFrame:
    """Chunks that hold bytes of ``[offset, offset + length)`` of their file; empty ranges and chunks touch none."""
    return placed.where((F.lit(length) > 0) & (F.col("len") > 0) & (F.col("in_file") < offset + length) & (F.col("in_file") + F.col("len") > offset))


#: Chunks of a stretch that one task packs by itself.
STRETCH = 50_000


def block_starts(lengths: np.ndarray, block_size: int) -> np.ndarray:
    """Of each chunk where the block would end that begins with it: before the chunk that would take it over."""
    ends = np.cumsum(lengths)
    own = ends - lengths
    return np.maximum(np.searchsorted(ends, own + block_size, "right"), np.arange(len(lengths)) + 1)


def stretches(frames: Iterator[pd.DataFrame], by: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``by``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, part in frame.groupby(list(by), sort=False):
            if held and tuple(held[-1][list(by)].iloc[-1]) != tuple(part[list(by)].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def pack_blocks(chunks: DataFrame, block_size: int) -> DataFrame:
    """Blocks of consecutive chunks per cluster: cluster, block, first, n, bytes.

    A block closes before the chunk that would take it over ``block_size``; a larger chunk stands alone.  Where a
    block begins depends on all before it, but only through the first begin in a stretch: so each stretch of
    ``STRETCH`` chunks tells, for every place where that may be, how many blocks follow and what its last one holds.
    One pass over these small rows, a cluster at a time, finds the true begins, and then each stretch cuts its own
    blocks.  Pieces of a block in several stretches are added up.  A cluster has no null name.
    """
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(chunks.select("cluster", "chunk", "len"), "cluster", "chunk", column="at").withColumn("stretch", F.floor(F.col("at") / STRETCH))
    key = ("cluster", "stretch")
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, "chunk")

    def outlined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in stretches(frames, key):
            lengths = group["len"].to_numpy()
            n, ends, following = len(lengths), np.cumsum(lengths), block_starts(lengths, block_size).tolist()
            last, count = list(range(n)), [1] * n
            for i in range(n - 1, -1, -1):
                if following[i] < n:
                    last[i], count[i] = last[following[i]], 1 + count[following[i]]
            most = min(n, int(np.searchsorted(ends, block_size, "right")) + 1)  # the first block begins no later
            held = ends[-1] - (ends - lengths)[last[:most]]
            yield pd.DataFrame({"cluster": [group["cluster"].iat[0]], "stretch": [group["stretch"].iat[0]], "n": [n], "total": [int(ends[-1])], "ends": [ends[:most].tolist()], "held": [held.tolist()], "count": [count[:most]]})

    outline = stored(dealt.mapInPandas(outlined, "cluster string, stretch long, n long, total long, ends array<long>, held array<long>, count array<long>"), "block-outline")

    def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, block, open_bytes = None, 0, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.cluster != cluster:
                    cluster, block, begin = r.cluster, 0, 0
                else:
                    begin = int(np.searchsorted(r.ends, block_size - open_bytes, "right"))
                out.append((r.cluster, r.stretch, begin, block))
                if begin < len(r.ends):
                    block, open_bytes = block + int(r.count[begin]), int(r.held[begin])
                else:
                    open_bytes += r.total
            yield pd.DataFrame(out, columns=["cluster", "stretch", "begin", "block"])

    begins = stored(outline.repartition(parts, "cluster").sortWithinPartitions(*key).mapInPandas(begun, "cluster string, stretch long, begin long, block long"), "block-begins")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in stretches(frames, key):
            lengths, chunk = group["len"].to_numpy(), group["chunk"].to_numpy()
            following, at, starts = block_starts(lengths, block_size), int(group["begin"].iat[0]), []
            while at < len(lengths):
                starts.append(at)
                at = int(following[at])
            block = int(group["block"].iat[0])
            numbers = np.arange(block, block + len(starts))
            if not starts or starts[0] > 0:  # the end of a block that began before
                starts, numbers = [0, *starts], np.append(block - 1, numbers)
            yield pd.DataFrame({"cluster": group["cluster"].iat[0], "block": numbers, "first": chunk[starts], "n": np.diff([*starts, len(lengths)]), "bytes": np.add.reduceat(lengths, starts)})

    placed = rows.join(begins, list(key)).repartition(parts, *key).sortWithinPartitions(*key, "chunk")
    pieces = placed.select("cluster", "stretch", "chunk", "len", "begin", "block").mapInPandas(cut, "cluster string, block long, first long, n long, bytes long")
    return pieces.groupBy("cluster", "block").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def verify(files: DataFrame, members: DataFrame, blobs: DataFrame) -> DataFrame:
    """Faults: chunks whose content has another hash, missing chunks, files whose size isn't the sum."""
    hashed = blobs.where(F.sha2("content", 256) != F.col("hash")).select(F.col("hash").alias("what"), F.lit("hash differs").alias("fault"))
    lengths = blobs.select("hash", F.length("content").alias("len"))
    joined = members.join(lengths, "hash", "left")
    missing = joined.where("len is null").select(F.concat_ws("#", "path", "pos").alias("what"), F.lit("chunk missing").alias("fault"))
    sums = joined.groupBy("path").agg(F.sum("len").alias("total"))
    sizes = files.join(sums, "path", "left").where(F.col("size") != F.coalesce("total", F.lit(0))).select(F.col("path").alias("what"), F.lit("size differs").alias("fault"))
    return hashed.union(missing).union(sizes)


def consistency(rows: DataFrame) -> DataFrame:
    """Rules that :func:`savings`' rows break: (class, rule); none, if they are right."""
    rules = {
        "duplicates are fewer than files": "dup_files < files or files = 0",
        "duplicate bytes are within bytes": "dup_bytes <= bytes",
        "distinct chunks are within chunks": "unique_chunks <= chunks",
        "distinct bytes are within bytes": "unique_chunk_bytes <= bytes",
    }
    broken = F.array_compact(F.array(*[F.when(~F.expr(test), F.lit(name)) for name, test in rules.items()]))
    per_class = rows.select("class", F.explode(broken).alias("rule"))
    sums = {c: [F.sum(F.when(F.col("class") != "(corpus)", F.col(c))).alias(f"s_{c}"), F.max(F.when(F.col("class") == "(corpus)", F.col(c))).alias(f"c_{c}"), F.max(F.when(F.col("class") != "(corpus)", F.col(c))).alias(f"m_{c}")] for c in ("files", "bytes", "dup_files", "unique_chunks")}
    one = rows.agg(*[x for some in sums.values() for x in some])
    tests = {
        "corpus files are the sum": F.col("c_files") == F.col("s_files"),
        "corpus bytes are the sum": F.col("c_bytes") == F.col("s_bytes"),
        "corpus duplicates are at least the sum": F.col("c_dup_files") >= F.col("s_dup_files"),
        "corpus chunks lie between most and sum": F.col("c_unique_chunks").between(F.col("m_unique_chunks"), F.col("s_unique_chunks")),
    }
    whole = one.select(F.explode(F.array_compact(F.array(*[F.when(~t, F.lit(n)) for n, t in tests.items()]))).alias("rule")).select(F.lit("(corpus)").alias("class"), "rule")
    return per_class.union(whole)
