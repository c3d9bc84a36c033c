"""Near duplicates: an LSH forest of sorted MinHash orders, confirmed on the full shingle sets.

1. Every text becomes a set of hashed word shingles, and that a signature of ``ORDERS * DEPTH`` minima.  Equal sets
   are one node from here on.
2. The forest: in each order the signature starts with another block of minima.  Nodes that agree on a block form
   a region.  Regions are range-sorted by the order's signature and walked in runs; a region that is too large
   for one run goes deeper: it is cut into overlapping runs along its sorted order, so what is compared there shares longer
   prefixes than elsewhere.  Within a run, nodes whose signatures look similar enough are joined to candidate clusters.
3. A cluster of moderate size is settled in one task: its pairs, the likeliest first, are compared on their full
   sets unless already connected.  A larger one is dealt into chunks several times, which connects most of it.
4. What runs and chunks can't promise is made exact: all nodes of regions too large for a run and of large clusters are
   joined by the rarest shingles of their sets.  Of two sets similar enough, those prefixes share one.  Only pairs that
   no links connect yet are made, and each is confirmed on its full sets, so the work follows the pairs that
   share something rare, not the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import modest_batches, spread, stored
from granary.llm.components import SHARE, components
from granary.llm.hashing import FACTOR, mixed, random_words, slices, words_of

#: Sorted orders, and minima that make a region of an order.
ORDERS, DEPTH = 24, 4
MINIMA = ORDERS * DEPTH
#: Nodes of a run, of a cluster that one task settles, and how often a larger cluster is dealt into chunks.
RUN, CLUSTER, DEALS = 128, 128, 3
#: Shingles that a posting carries of those before it; counters of shingles, and of a block of them.
RECENT, COUNTERS, COUNTER_BLOCK = 32, 1 << 20, 1 << 12
#: Bits of a filter of hashes at most: 4 MB, which travel with the plan.
FILTER_BITS = 1 << 25
#: How far below the threshold, in standard deviations, a signature's estimate may lie.
MARGIN = 4.0


# ---- shingles and signatures


_SCALE = (random_words(MINIMA, 2) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_SHIFT = (random_words(MINIMA, 3) >> np.uint64(31)).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``size`` words, or all words where there are fewer."""
    for first, last, data, ends in slices(texts):
        words, _, _, text = words_of(data, ends)
        bounds = np.searchsorted(text, np.arange(last - first + 1))
        rolled = words.copy()
        for step in range(1, size):
            rolled = mixed(rolled[: max(0, len(words) - step)] * FACTOR + words[step:])
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = words[a : a + 1]
                for j in range(a + 1, b):
                    whole = mixed(whole * FACTOR + words[j : j + 1])
                yield mixed(whole + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """Of each hash function the low half of its least value, as big-endian shorts, so that bytes sort alike."""
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    items = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(items), 512):
        least = np.minimum(least, (items[at : at + 512, None] * _SCALE + _SHIFT).min(0))
    return (least & np.uint32(0xFFFF)).astype(">u2").tobytes()


def profiles(docs: DataFrame, size: int, text_col: str, id_col: str) -> DataFrame:
    """A stored row per input row: rid, doc_id, text_hash, n_shingles, set_id (null without words), sig."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, sigs = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                names=["rid", "doc_id", "text_hash", "n_shingles", "set_id", "sig"],
            )

    return stored(rows.mapInArrow(made, "rid long, doc_id long, text_hash long, n_shingles long, set_id binary, sig binary"), "dup-profiles")


# ---- the forest


def region_keys(nodes: DataFrame) -> DataFrame:
    """(key, turn, rid): each node once in each order, under its region there."""
    of = lambda t: F.struct(F.xxhash64(F.substring("sig", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)), t).alias("key"), t.cast("int").alias("turn"))
    return nodes.select("rid", F.inline(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), of))).select("key", "turn", "rid")


def regions(nodes: DataFrame) -> DataFrame:
    """A stored row per node and region of two nodes or more: key, rid, turn, n (the region's nodes), sig."""
    counts = stored(region_keys(nodes).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "dup-regions")
    return stored(region_keys(nodes).join(counts, "key").join(nodes.select("rid", "sig"), "rid"), "dup-members")


def runs(frames: Iterator[pd.DataFrame], by: list[str], most: int | None = None) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal ``by`` from sorted batches, at most ``most`` at a time."""
    held: list[pd.DataFrame] = []
    rows = 0

    def take() -> pd.DataFrame:
        return pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

    for frame in frames:
        if not len(frame):
            continue
        values = [frame[c].to_numpy() for c in by]
        change = np.zeros(len(frame) - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (a or any(held[-1][c].iat[-1] != v[0] for c, v in zip(by, values))):
                yield take()
                held, rows = [], 0
            while most and rows + b - a >= most:
                cut = a + most - rows
                held.append(frame.iloc[a:cut])
                yield take()
                held, rows, a = [], 0, cut
            if b > a:
                held.append(frame.iloc[a:b])
                rows += b - a
    if held:
        yield take()


class Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
        return a != b


def unpacked(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, MINIMA)


def likely(sigs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows whose signatures agree in at least that share, the likeliest first."""
    same = np.zeros((len(sigs), len(sigs)), np.int16)
    for k in range(MINIMA):
        same += sigs[:, k, None] == sigs[None, :, k]
    i, j = np.nonzero(np.triu(same >= least * MINIMA, 1))
    order = np.argsort(-same[i, j], kind="stable")
    return i[order], j[order]


def estimate_floor(threshold: int) -> float:
    share = threshold / 100
    return share - MARGIN * (share * (1 - share) / MINIMA) ** 0.5


def candidate_edges(members: DataFrame, threshold: int) -> DataFrame:
    """A spanning forest of the similar nodes in each run of each order.

    Runs of a large region overlap by half.  A range partition may end within such a region, never within a small
    one, whose rows are all equal in the sort's key.
    """
    deeper = F.concat(F.expr(f"substring(sig, turn * {2 * DEPTH} + {2 * DEPTH + 1})"), F.expr(f"substring(sig, 1, turn * {2 * DEPTH})"))
    sorted_members = (
        members.withColumn("deeper", F.when(F.col("n") > RUN, deeper))
        .repartitionByRange(spread(members.sparkSession), "key", "deeper")
        .sortWithinPartitions("key", "deeper", "rid")
        .select("key", "rid", "sig")
    )
    floor = estimate_floor(threshold)

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_out: list[int] = []
        b_out: list[int] = []
        last: tuple | None = None  # key, nodes and signatures that a long region's next run takes up again
        for run in runs(frames, ["key"], RUN):
            key, rid, sigs = run["key"].iat[0], run["rid"].to_numpy(), unpacked(run["sig"].tolist())
            if last and last[0] == key:
                rid, sigs = np.concatenate([last[1], rid]), np.concatenate([last[2], sigs])
            last = (key, rid[-RUN // 2 :], sigs[-RUN // 2 :]) if len(run) == RUN else None
            if len(rid) == 2:
                if (sigs[0] == sigs[1]).mean() >= floor:
                    a_out.append(rid[0])
                    b_out.append(rid[1])
            elif len(rid) > 2:
                joined = Union(len(rid))
                for i, j in zip(*(x.tolist() for x in likely(sigs, floor))):
                    if joined.join(i, j):
                        a_out.append(rid[i])
                        b_out.append(rid[j])
            if len(a_out) > 20_000:
                yield pd.DataFrame({"a": a_out, "b": b_out})
                a_out, b_out = [], []
        yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return sorted_members.mapInPandas(forest, "a long, b long")


# ---- confirming


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def confirm(sets: list[np.ndarray], sigs: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between rows, one for each two components that they connect."""
    joined, found = Union(len(sets)), []
    for i, j in zip(*(v.tolist() for v in likely(sigs, estimate_floor(threshold)))):
        if joined.find(i) != joined.find(j) and linked(sets[i], sets[j], threshold):
            joined.join(i, j)
            found.append((i, j))
    return found


def settle(threshold: int, by: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For tasks over sorted groups (rid, sig, shingles): confirmed links (a, b)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(frames, by):
            found = confirm([np.frombuffer(s, np.uint64) for s in group["shingles"]], unpacked(group["sig"].tolist()), threshold)
            rid = group["rid"].to_numpy()
            yield pd.DataFrame({"a": np.array([rid[i] for i, _ in found], np.int64), "b": np.array([rid[j] for _, j in found], np.int64)})

    return run


def grouped(rows: DataFrame, by: list[str], threshold: int) -> DataFrame:
    wanted = rows.select(*by, "rid", "sig", "shingles")
    return wanted.repartition(spread(rows.sparkSession), *by).sortWithinPartitions(*by, "rid").mapInPandas(settle(threshold, by), "a long, b long")


def bits_of(hashes: DataFrame, column: str) -> bytes:
    """A Bloom filter of a column of 64-bit hashes: an array of bits, two for each hash.

    It has sixteen bits a hash up to ``FILTER_BITS`` in all: beyond that it lets more through, and never less.
    """
    n = hashes.count()
    size = max(1 << 12, min(FILTER_BITS, 1 << (16 * n).bit_length()))
    bit = F.explode(F.array(*places_of(F.col(column), size)))
    words = hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 AS INT))")).alias("w"))
    out = np.zeros(size // 32, "<u4")
    for row in words.collect():  # a row per 32 bits at most
        out[row["at"]] = row["w"]
    return out.tobytes()


def places_of(h: Column, size: int) -> list[Column]:
    """The two bits of a hash in an array of ``size``, a power of two of at most 2^31."""
    return [F.shiftrightunsigned(h, by).bitwiseAND(size - 1) for by in (0, 32)]


def may_hold(bits: bytes, h: Column) -> Column:
    """Whether the filter has both bits of a hash; built-in functions over a literal, so rows are sifted where they are read."""

    def has(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1

    first, second = places_of(h, 8 * len(bits))
    return has(first) & has(second)


def with_sets(docs: DataFrame, wanted: DataFrame, size: int, text_col: str, id_col: str) -> DataFrame:
    """``wanted`` (rid, doc_id, text_hash, …) with the shingles of its texts, read again; stored.

    A filter sifts the texts where they are read, so that few others are hashed and none is shuffled: what is joined
    are sets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where(may_hold(bits_of(wanted, "text_hash"), F.col("h")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), sets], names=["id", "h", "shingles"])

    sets = rows.mapInArrow(made, "id long, h long, shingles binary")
    found = sets.join(wanted, (sets["h"] == wanted["text_hash"]) & sets["id"].eqNullSafe(wanted["doc_id"]))
    return stored(found.select(*[c for c in wanted.columns if c not in ("doc_id", "text_hash")], "shingles"), "dup-sets")


def commonness(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, counted in ``COUNTERS`` slots that many may share: never less than the truth.

    Tasks count for themselves and hand on blocks of counters; what reaches the driver is one array of fixed size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column("shingles"):
                np.add.at(total, slots(np.frombuffer(s.as_buffer(), np.uint64)), 1)
        blocks = total.reshape(-1, COUNTER_BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "counts"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(c, np.int64) for c in frame["counts"]), np.zeros(COUNTER_BLOCK, np.int64))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    out = np.zeros(COUNTERS, np.int64)
    for row in sets.select("shingles").mapInArrow(counted, schema).groupBy("block").applyInPandas(summed, schema).collect():
        out[row["block"] * COUNTER_BLOCK :][:COUNTER_BLOCK] = np.frombuffer(row["counts"], np.int64)
    return out


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(COUNTERS)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, from 1, and shingles of a set's prefix, the rarest first, without those that no other set has."""
    c = counts[slots(shingles)]
    order = np.lexsort((shingles, c))
    n = len(order)
    order = order[: n - -(-n * threshold // 100) + 1]  # enough for a partner of the least size
    shared = np.flatnonzero(c[order] > 1)
    return shared + 1, shingles[order[shared]]


def rare_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """All pairs (a, b) of rows (rid, label, size, shingles) of different labels that may be linked; stored.

    Shingles are put in one order, those of the least counts first.  Sets x and y have an intersection of at least
    m = ceil(t * (|x| + |y|) / (100 + t)) if they are linked, and then share a shingle within the first |x| - m + 1 of
    x and the first |y| - m + 1 of y.  That holds in any order; counts only make it a short search.  Shingles that one
    row alone has need no partner; those that only rows of one label have there make no pair.  Of the others the rows
    outside each shingle's commonest label meet all its rows, in a join of two fresh shuffles, so that a hot shingle
    can be split.  Each row carries the ``RECENT`` shingles before it, so that a pair is seldom made more than once.
    """
    shared = sets.sparkSession.sparkContext.broadcast(commonness(sets))  # of fixed size
    columns = ["rid", "label", "size", "place", "recent"]

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                owner, places, posts, recent, ends = [], [], [], [], [0]
                for i, s in enumerate(part.column("shingles")):
                    place, own = rarest(np.frombuffer(s.as_buffer(), np.uint64), counts, threshold)
                    owner.append(np.full(len(own), i))
                    places.append(place)
                    posts.append(own.view(np.int64))
                    for k in range(len(own)):
                        recent.append(posts[-1][max(0, k - RECENT) : k])
                        ends.append(ends[-1] + len(recent[-1]))
                owner, empty = pa.array(np.concatenate(owner)), np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([empty, *recent])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([empty, *posts])), *[part.column(c).take(owner) for c in ("rid", "label", "size")], pa.array(np.concatenate([empty, *places])), lists],
                    names=["shingle", *columns],
                )

    rows = sets.select("rid", "label", "size", "shingles").mapInArrow(posted, "shingle long, rid long, label long, size long, place long, recent array<long>")
    postings = stored(rows, "dup-postings")
    labels = postings.groupBy("shingle", "label").agg(F.count("*").alias("c")).groupBy("shingle")
    main = labels.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    outside = stored(postings.join(stored(main, "dup-mains", SHARE), "shingle").where("label <> main").drop("main"), "dup-outside")
    x, y = (side.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in columns]) for side, name in ((outside, "x"), (postings, "y")))
    need = F.ceil((F.col("x_size") + F.col("y_size")) * threshold / (100 + threshold))
    fits = (F.col("x_place") <= F.col("x_size") - need + 1) & (F.col("y_place") <= F.col("y_size") - need + 1) & (F.least("x_size", "y_size") >= need)
    # A pair is made at the first shingle that both have: what stands just before tells most others.
    first = ~F.arrays_overlap("x_recent", "y_recent")
    pairs = x.join(y, "shingle").where((F.col("x_label") != F.col("y_label")) & fits & first)
    return stored(pairs.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct(), "dup-pairs")


def confirmed_pairs(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that are linked, on their full sets."""

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(frame["x"], frame["y"])]
            yield frame.loc[ok, ["a", "b"]]

    x, y = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(checked, "a long, b long")


def confirmed_edges(sets: DataFrame, threshold: int) -> DataFrame:
    """Links that connect the nodes as all links would.  ``sets``: cluster, n (its nodes; null without one), dense, rid,
    sig, shingles."""
    edges = grouped(sets.where(F.col("n") <= CLUSTER), ["cluster"], threshold)
    rest = sets.where(F.col("dense") | (F.col("n") > CLUSTER))
    if rest.isEmpty():
        return edges
    chunk = F.pmod(F.xxhash64(F.col("rid"), F.col("deal")), F.ceil(F.col("n") / (CLUSTER // 2))).cast("int")
    dealt = sets.where(F.col("n") > CLUSTER).withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(DEALS)))).withColumn("chunk", chunk)
    first = stored(edges.union(grouped(dealt, ["cluster", "deal", "chunk"], threshold)), "dup-first")
    labels = stored(components(first), "dup-labels", SHARE).withColumnRenamed("node", "rid")
    labelled = rest.join(labels, "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"), (F.octet_length("shingles") / 8).cast("long").alias("size"), "shingles")
    labelled = stored(labelled, "dup-labelled")
    return first.union(confirmed_pairs(rare_pairs(labelled, threshold), labelled, threshold))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, rid and keeper (the rid to keep) of every row.

    Words are lower-cased in A-Z and parted by ASCII space and controls 9 to 13.  Texts are linked if 100 times
    their sets' intersection is at least ``threshold`` times their union; component_id is the smallest doc_id
    that links lead to, and kept tells whether that is the row's own.  A text with fewer words than a shingle
    is one shingle; null, empty and blank texts have none and are linked with nothing.  A null id never is
    the smallest where there is another, and is kept where there is none.  Repeated rows are linked, and each
    counts as kept if its id is the component's, while keeper names one of them.  An empty table gives no
    rows; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    table = profiles(docs, shingle, text_col, id_col)
    nodes = stored(
        table.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min(F.struct("rid", "doc_id", "text_hash", "sig")).alias("r"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("low"))
        .select("set_id", "r.*", "low"),
        "dup-nodes",
    )
    members = regions(nodes)
    candidates = stored(components(candidate_edges(members, threshold)), "dup-clusters", SHARE).select(F.col("node").alias("rid"), F.col("label").alias("cluster"))
    sizes = stored(candidates.groupBy("cluster").agg(F.count("*").alias("n")), "dup-sizes", SHARE)
    dense = stored(members.where(F.col("n") > RUN).select("rid", F.lit(True).alias("dense")).distinct(), "dup-dense", SHARE)
    asked = candidates.join(sizes, "cluster").join(dense, "rid", "full_outer").select("rid", "cluster", "n", F.coalesce("dense", F.lit(False)).alias("dense"))
    wanted = asked.join(nodes.select("rid", "doc_id", "text_hash", "sig"), "rid")
    sets = with_sets(docs, stored(wanted, "dup-wanted"), shingle, text_col, id_col)
    labels = stored(components(confirmed_edges(sets, threshold)), "dup-components", SHARE).withColumnRenamed("node", "rid")
    labelled = nodes.join(labels, "rid", "left").select("set_id", F.coalesce("label", "rid").alias("label"), "low")
    labelled = stored(labelled, "dup-node-labels")
    lows = stored(labelled.groupBy("label").agg(F.min("low").alias("best")), "dup-lows")
    by_set = stored(labelled.join(lows, "label").select("set_id", F.col("best.doc_id").alias("low_id"), F.col("best.rid").alias("low_rid")), "dup-sets-lows")
    joined = table.select("rid", "doc_id", "text_hash", "n_shingles", "set_id").join(by_set, "set_id", "left")
    alone = F.col("set_id").isNull()
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("low_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("low_id"))).alias("kept"),
        "text_hash",
        "rid",
        F.when(alone, F.col("rid")).otherwise(F.col("low_rid")).alias("keeper"),
    )


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The documents with one row of each group; their columns stay as they were, whatever their names.

    Rows without words, null and empty texts among them, are all kept.  Of rows that agree in id and text, which
    nothing tells apart, one is kept where their group's keeper is among them, whatever their other columns hold;
    a null id is like any other there, and an empty table gives no rows.
    """
    found = stored(near_duplicates(docs, text_col=text_col, id_col=id_col, **how).groupBy("doc_id", "text_hash").agg(F.count_if(F.col("rid") == F.col("keeper")).alias("keepers"), F.count("*").alias("rows")), "dup-found")
    spare = lambda name: name if name not in docs.columns else spare(name + "_")
    mark, ident = spare("granary_hash"), spare("granary_id")
    # Rows whose every copy in id and text is its own keeper stay, as all without words do; few others are looked at twice.
    others = found.where("keepers < rows")
    hashed = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    doubtful = may_hold(bits_of(others, "text_hash"), F.col(mark))
    named = others.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark), "keepers")
    same = lambda some: (hashed[mark] == some[mark]) & hashed[id_col].cast("long").eqNullSafe(some[ident])
    left = hashed.where(~doubtful).union(hashed.where(doubtful).join(named, same(named), "left_anti"))
    once = named.where("keepers > 0")
    if not once.isEmpty():
        left = left.union(hashed.where(doubtful).join(once, same(once), "left_semi").dropDuplicates([id_col, mark]))
    return left.drop(mark)
