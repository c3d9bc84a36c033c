"""Exact top-k inner products: vectors in buckets by length, each searched as its local threshold suggests.

1. Vectors are range-sorted by length, longest first, in classes a few hundredths wide, and within a class by their
   greatest coordinates.  Cut by row number, that line gives buckets of like length and, where vectors cluster, like
   direction.
2. A first pass scores every query against its neighbours on that line and against the longest vectors.  The k-th best of
   these is a threshold that all later tasks share.
3. A query visits only buckets that its threshold can't rule out.  What a bucket's candidate must reach, as a cosine,
   decides how it is searched: a high one by sorted coordinate lists, a low one by length.  Only what is left is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import modest_batches, stored
from granary.store import numbered

#: Rows of a cell of candidates, of a block of queries, of a bucket, and of a stretch of neighbours in the first pass.
CELL, QUERIES, BUCKET, NEAR = 4096, 1024, 512, 512
#: From this cosine on, a bucket is searched by coordinates, below it by lengths.
STEEP = 0.6
#: Coordinates looked at per query, those that order vectors of a length, and the width of a class of lengths.
FOCUS, LEADING, WIDTH = 5, 3, math.log(1.05)
#: Products of doubles are exact below this; scores end where a long does.
EXACT, LONG = 2.0**53, 2**63 - 1
#: Bounds are computed in doubles: what a rounding could cost is given away.
SLACK = 1e-9
#: The class of a vector of length 0; doubles have fewer than 30,000 classes on either side of 1.
NOTHING = -40_000


def length_of(v: np.ndarray) -> float:
    most = float(np.abs(v).max(initial=0))
    return most * float(np.sqrt(np.square(v / most).sum())) if most > 0 else 0.0


def class_of(length: float) -> int:
    return max(NOTHING + 1, math.floor(math.log(min(length, 1e308)) / WIDTH)) if length > 0 else NOTHING


def encoded(v: np.ndarray) -> bytes:
    """Whole numbers as two bytes each, where all of them fit, else as doubles; the first byte tells which."""
    return b"s" + v.astype("<i2").tobytes() if np.abs(v).max(initial=0) < 32768 else b"d" + v.astype("<f8").tobytes()


def decoded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<f8", offset=1).astype(np.float64)


def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each vector floor(256 * x), its length and class, and its greatest coordinates with their signs."""
    for frame in frames:
        rows = []
        for v in frame["v"]:
            with np.errstate(over="ignore"):
                whole = np.floor(256.0 * np.asarray(v, np.float64))
            if not np.isfinite(whole).all():
                rows.append((None, 0.0, 0, ""))
                continue
            lead = np.argsort(-np.abs(whole), kind="stable")[:LEADING]
            length = length_of(whole)
            rows.append((encoded(whole), length, class_of(length), ",".join(f"{i:06d}{'+' if whole[i] >= 0 else '-'}" for i in lead)))
        out = pd.DataFrame(rows, columns=["v", "length", "class", "lead"])
        out.insert(0, "id", frame["id"].to_numpy())
        out.insert(1, "q", frame["q"].to_numpy())
        yield out[out["v"].notna()]


def stack(values: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(values), width))
    for i, raw in enumerate(values):
        v = decoded(raw)
        out[i, : len(v)] = v
    return out


def width_of(values) -> int:
    return max(((len(v) - 1) // (2 if v[:1] == b"s" else 8) for v in values), default=0)


def products(q: np.ndarray, c: np.ndarray, reach: float) -> np.ndarray:
    """Whole-numbered inner products; beyond what doubles hold exactly, in Python's integers, clipped to a long."""
    if reach < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(exact(q).dot(exact(c).T), -LONG - 1, LONG).astype(np.int64)


class Bucket:
    """Candidates of like length, the longest first, with what bounds tell about them."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.ids, self.c, self.length = ids[order], c[order], length[order]
        self.low, self.high, self.unit, self.lists = c.min(0), c.max(0), None, None

    def box(self, q: np.ndarray) -> np.ndarray:
        """No candidate's product with a query is above this, coordinate by coordinate."""
        return np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low

    def by_length(self, need: np.ndarray) -> np.ndarray:
        """How many candidates are as long as each query needs."""
        return np.searchsorted(-self.length, -need, "right")

    def by_coordinates(self, q: np.ndarray, local: float, needs: float) -> np.ndarray:
        """Candidates that may reach the cosine ``local`` with the unit vector ``q``.

        An angle to the query bounds the angle to each axis, so a coordinate of such a candidate lies in a
        range: the shortest list is taken and the other ranges, and then what the coordinates not looked at
        could still add, sieve it.  ``needs`` over a candidate's length is the cosine that it must reach itself.
        """
        if self.unit is None:
            self.unit = self.c / np.maximum(self.length, 1e-300)[:, None]
            order = np.argsort(self.unit, axis=0, kind="stable")
            self.lists = order, np.take_along_axis(self.unit, order, 0)
        order, values = self.lists
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        turn, wide = np.arccos(np.clip(q[focus], -1, 1)), math.acos(min(1.0, max(-1.0, local))) + SLACK
        low, high = np.cos(np.minimum(np.pi, turn + wide)) - SLACK, np.cos(np.maximum(0, turn - wide)) + SLACK
        starts = [int(np.searchsorted(values[:, f], x, "left")) for f, x in zip(focus, low)]
        stops = [int(np.searchsorted(values[:, f], x, "right")) for f, x in zip(focus, high)]
        best = int(np.argmin(np.subtract(stops, starts)))
        found = order[starts[best] : stops[best], focus[best]]
        part = self.unit[np.ix_(found, focus)]
        fits = ((part >= low) & (part <= high)).all(1)
        found, part = found[fits], part[fits]
        rest = math.sqrt(max(0.0, 1 - float(q[focus] @ q[focus]))) * np.sqrt(np.maximum(0, 1 - np.square(part).sum(1)))
        return np.sort(found[part @ q[focus] + rest + SLACK >= needs / np.maximum(self.length[found], 1e-300)])


def best(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best candidates of another id, ties to the smaller id: query rows, ids, scores.

    ``theta`` are scores that k candidates, here or elsewhere, are known to reach (or minus infinity).  The last
    array counts the products computed for each query.
    """
    q_len, c_len = (np.array([length_of(v) for v in m]) for m in (q, c))
    theta, made = theta.astype(float), np.zeros(len(q), np.int64)
    rows, ids, scores = (np.empty(0, np.int64) for _ in range(3))
    for at in range(0, len(c), BUCKET):
        bucket = Bucket(c_ids[at : at + BUCKET], c[at : at + BUCKET], c_len[at : at + BUCKET])
        with np.errstate(over="ignore"):
            most = q_len * bucket.length[0]
        vast = most >= EXACT
        able = vast | (theta <= most * (1 + SLACK) + SLACK)
        plain = np.flatnonzero(able & ~vast)
        if len(plain):
            plain = plain[bucket.box(q[plain]) + (1 + np.abs(theta[plain])) * SLACK >= theta[plain]]
        local = np.where(theta[plain] > 0, theta[plain] / np.maximum(most[plain], 1e-300), -1.0)
        steep = local >= STEEP
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, cosine in zip(plain[steep].tolist(), local[steep].tolist()):
            some = bucket.by_coordinates(q[i] / q_len[i], cosine - SLACK, theta[i] / q_len[i])
            if len(some):
                made[i] += len(some)
                new.append((np.full(len(some), i), some, products(q[i : i + 1], bucket.c[some], most[i])[0]))
        flat = plain[~steep]
        need = np.where(theta[flat] > 0, theta[flat] / np.maximum(q_len[flat], 1e-300) * (1 - SLACK), 0.0)
        long = bucket.by_length(need)
        for n in np.unique(long[long > 0]).tolist():  # queries that need as many of the longest share a product of matrices
            some = flat[long == n]
            made[some] += n
            found = products(q[some], bucket.c[:n], 0.0)
            i, j = np.nonzero(found >= theta[some, None])
            new.append((some[i], j, found[i, j]))
        some = np.flatnonzero(vast & able)
        if len(some):
            made[some] += len(bucket.ids)
            found = products(q[some], bucket.c, math.inf)
            new.append((np.repeat(some, len(bucket.ids)), np.tile(np.arange(len(bucket.ids)), len(some)), found.ravel()))
        if not new:
            continue
        r, j, s = (np.concatenate(x) for x in zip(*new))
        fits = (bucket.ids[j] != q_ids[r]) & (s >= theta[r])
        rows, ids, scores = np.append(rows, r[fits]), np.append(ids, bucket.ids[j[fits]]), np.append(scores, s[fits])
        keep = np.lexsort((ids, ~scores, rows))  # the complement turns the order of longs round without overflow
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, ids, scores, nth = rows[nth < k], ids[nth < k], scores[nth < k], nth[nth < k]
        last = np.flatnonzero(nth == k - 1)
        low = scores[last].astype(float)
        theta[rows[last]] = np.maximum(theta[rows[last]], low - np.abs(low) * SLACK)
    return rows, ids, scores, made


def of_cell(k: int, counted: bool):
    """A function of a cell's rows (candidates, and queries with their theta): at, query_id, vec_id, score, products."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        width = width_of(frame["v"])
        q, c = frame[frame["q"]], frame[~frame["q"]].sort_values("at", kind="stable")
        q_ids, q_at, c_ids = q["id"].to_numpy(), q["at"].to_numpy(), c["id"].to_numpy()
        theta = q["theta"].fillna(-np.inf).to_numpy()
        r, ids, scores, made = best(q_ids, stack(list(q["v"]), width), theta, c_ids, stack(list(c["v"]), width), k)
        out = pd.DataFrame({"at": q_at[r], "query_id": q_ids[r], "vec_id": pd.array(ids, "Int64"), "score": pd.array(scores, "Int64"), "products": 0})
        if counted:
            none = pd.array([None] * len(q), "Int64")
            out = pd.concat([out, pd.DataFrame({"at": q_at, "query_id": q_ids, "vec_id": none, "score": none, "products": made})])
        return out

    return run


FOUND = "at long, query_id long, vec_id long, score long, products long"


def line(vectors: DataFrame, every: int, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors, stored in order of class, longest first, and leading coordinates, with their place ``at``."""
    usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
        .withColumn("q", F.col("id") % every == 0)
    )
    # Stored, for the range sort reads it twice.
    rows = stored(clean.mapInPandas(packed, "id long, q boolean, v binary, length double, class int, lead string"), "topk-packed")
    return numbered(rows, F.col("class").desc(), "lead", "id", "v", column="at")


def shared_thresholds(rows: DataFrame, k: int) -> DataFrame:
    """(at, theta): of each query the k-th best of its neighbours on the line and of the longest vectors.

    Candidates are told apart by id and score, so one that is in both is counted once; that may count equal
    rows once too, which only lowers the threshold.
    """
    columns = ["cell", "id", "at", "v", "theta"]
    base = rows.select((F.floor(F.col("at") / NEAR) + 1).alias("cell"), "id", "at", "v", "q", F.lit(None).cast("double").alias("theta"))
    near = base.select(*columns, F.lit(False).alias("q")).union(base.where("q").select(*columns, F.lit(True)))
    # The longest, NEAR at most, stand once more for each 16 such stretches of queries, in cells below 0.
    far = lambda at: -F.floor(at / (NEAR * 16)) - 1
    least = rows.agg(F.coalesce(far(F.max("at")), F.lit(-1))).first()[0]
    longest = base.where(F.col("at") < NEAR).withColumn("cell", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(least).cast("long")))).select(*columns, F.lit(False).alias("q"))
    asked = base.where("q").withColumn("cell", far(F.col("at"))).select(*columns, F.lit(True).alias("q"))
    found = near.union(longest).union(asked).groupBy("cell").applyInPandas(of_cell(k, False), FOUND)
    nth = W.partitionBy("at").orderBy(F.col("score").desc())
    return found.select("at", "vec_id", "score").distinct().withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select("at", F.col("score").cast("double").alias("theta"))


def visits(rows: DataFrame, k: int) -> DataFrame:
    """The queries with theta and ``last``, the last cell that may hold a candidate for them; stored by need."""
    low = F.col("theta") - F.abs("theta") * SLACK
    asked = rows.where("q").join(shared_thresholds(rows, k), "at", "left").withColumn("theta", low)
    need = F.floor(F.log(F.col("theta") / F.col("length")) / WIDTH) - 1  # one class for roundings
    asked = asked.withColumn("need", F.when((F.col("theta") > 0) & (F.col("length") > 0), F.greatest(need, F.lit(NOTHING))).otherwise(F.lit(NOTHING)).cast("int"))
    asked = stored(asked, "topk-asked")
    # At most a row per class of doubles, however many vectors there are.
    ends = rows.groupBy("class").agg(F.max("at").alias("end")).union(asked.select(F.col("need"), F.lit(-1)).distinct())
    ends = ends.groupBy("class").agg(F.max("end").alias("end")).withColumn("end", F.max("end").over(W.orderBy(F.col("class").desc())))
    return asked.join(ends.withColumnRenamed("class", "need"), "need").withColumn("last", F.floor(F.col("end") / CELL)).where("end >= 0")


def search(vectors: DataFrame, k: int, every: int, id_col: str, vector_col: str, counted: bool = False) -> DataFrame:
    """What the cells find: at (the query's place), query_id, vec_id, score; with ``counted`` also a row per query and
    cell whose products tells how many inner products were computed."""
    modest_batches(vectors.sparkSession)
    rows = line(vectors, every, id_col, vector_col)
    # Queries of one block need about as many cells, so that a cell is dealt to few blocks.
    asked = numbered(visits(rows, k), F.col("last").desc(), "at", column="nth").withColumn("block", F.floor(F.col("nth") / QUERIES))
    pairs = asked.groupBy("block").agg(F.max("last").alias("last")).select("block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("cell"))
    columns = ["cell", "block", "id", "at", "v", "theta", "q"]
    candidates = rows.withColumn("cell", F.floor(F.col("at") / CELL)).join(pairs, "cell").withColumns({"theta": F.lit(None).cast("double"), "q": F.lit(False)})
    queries = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    return candidates.select(*columns).union(queries.select(*columns)).groupBy("cell", "block").applyInPandas(of_cell(k, counted), FOUND)


def work(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: the inner products that the second pass computes (the first one's stretches come to about a thousand
    a query) and, as pairs, those that comparing all would."""
    n, q = vectors.where(F.col(vector_col).isNotNull()).agg(F.count(id_col), F.count_if(F.col(id_col) % every == 0)).first()
    return search(vectors, k, every, id_col, vector_col, True).agg(F.coalesce(F.sum("products"), F.lit(0)).alias("products"), F.lit(n * q).alias("pairs"))


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of another id, so copies
    of a query's own row under its own id are left out and those under other ids are not.  Rows with a null
    id, a null vector, a null or non-finite component, or one that is no longer finite times 256 take no part;
    a missing component of a shorter vector counts as 0; an empty vector has length 0 and scores 0; repeated
    rows count each, as queries too; scores beyond a long are clipped to it before they are ranked; an empty
    table gives no rows; other columns are ignored.  Equal vectors stand side by side on the line and are cut
    by row number, so no bucket grows with them.  Vectors without structure leave nothing to prune (see :func:`work`).
    """
    found = search(vectors, k, every, id_col, vector_col)
    # By row, not by id: a repeated query row is answered as often as it stands there.
    ranked = W.partitionBy("query_id", "at").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The report in DuckDB's SQL.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
