"""Mixing sources to target weights as a curriculum; built-in functions only.

Every source has a weight that changes over training time t in [0, 1].  The integral of its schedule is the
source's cumulative demand for words; inverting that integral gives each document the time at which the
training run reaches it.  Documents are then range-sorted by that position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
#: Of each weight its slope g: the schedule is w * (1 + g * (2t - 1)), so heavy sources come late.
SLOPES = (0.5, 0.0, -0.5)
MOST = 3
#: Documents are dealt into so many hash ranges that each holds about this many of all sources' rows.
RANGE_ROWS, TOP_BITS = 250, 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST) -> DataFrame:
    """Of each source (rows: sk, source, source_size) its target in words, weight and slope.

    Shares go by weight; a share above ``most`` times its source stops there and what is over is shared again
    by weight.  Sorted by cap over weight, a source is capped exactly if the level that the sources before it
    leave exceeds its own ratio, so one running sum settles all of them.  There is a row per source here.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pick") + 1).cast(kind)
    named = sizes.withColumn("pick", rank.cast("int")).withColumns({"w": pick(weights, "long"), "g": pick(slopes, "double")})
    cap = F.col("source_size") * most
    order = W.orderBy((cap.cast("double") / F.col("w")), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    level = named.withColumns(
        {
            "total": F.sum(dec(F.col("source_size"))).over(every),
            "all_w": F.sum("w").over(every),
            "caps": F.coalesce(F.sum(dec(cap)).over(before), dec(F.lit(0))),
            "ws": F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    ).withColumn("capped", (F.col("total") - F.col("caps")) * F.col("w") > dec(cap) * (F.col("all_w") - F.col("ws")))
    left = level.withColumns(
        {
            "rest": F.col("total") - F.sum(F.when(F.col("capped"), dec(cap)).otherwise(dec(F.lit(0)))).over(every),
            "rest_w": F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(F.lit(0))).over(every),
        }
    )
    shared = (F.col("rest") * F.col("w")).cast("double") / F.col("rest_w").cast("double")
    return left.select("sk", "source_size", "w", "g", F.when(F.col("capped"), cap.cast("double")).otherwise(shared).alias("target"))


def reached(x: Column, g: Column) -> Column:
    """The time t at which the share x of a source's demand is met: the inverse of t + g * (t * t - t)."""
    x = F.least(x, F.lit(1.0))
    root = F.sqrt((1 - g) * (1 - g) + 4 * g * x)
    return F.when(g == 0, x).otherwise((root - (1 - g)) / (2 * g))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    slopes: tuple[float, ...] = SLOPES,
    most: int = MOST,
    keep: tuple[str, ...] = (),
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Each document with the words that the mix takes of it and where in training it comes.

    Returns doc_id, size, source_size, target, taken, copies (whole passes and the cut one), position (the
    first copy's, null if not taken), positions (of every copy), range-sorted by position, and the columns
    named in ``keep``, as ``kept_<name>``.  In each source the documents stand in the order of a hash of their
    id; the mix passes over them in that order until the target is met, cutting the last document, so a
    source's taken words equal its rounded target.  A null text has size 0, null is a source of its own that
    sorts last, empty documents are never taken, repeated rows count each, an empty table gives no rows.
    Sources are few beside documents: the windows over them run in one task.  The order is by id and text, so
    rows of one id, null ids among them, are dealt apart unless their texts agree too.
    """
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(ident, F.lit("/"), F.md5(text)))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("sk"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    # Sizes are counted once; with texts to carry they are read again rather than stored twice.
    small = stored(base.select("doc_id", "source", "sk", "size", "key"), "mix-sizes")
    rows = (base if keep else small).drop("source")
    sums = small.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = stored(targets(sums, weights, slopes, most), "mix-targets")

    bits = min(TOP_BITS, max(1, math.ceil(math.log2(max(2, small.count() / RANGE_ROWS)))))
    half = bits // 2
    fine = F.shiftright(F.conv(F.substring("key", 1, TOP_BITS // 4), 16, 10).cast("long"), TOP_BITS - bits)
    ranges = small.groupBy("sk", fine.alias("fine")).agg(F.sum("size").alias("s")).withColumn("coarse", F.shiftright("fine", half))
    before = lambda by, order: F.coalesce(F.sum("s").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = ranges.groupBy("sk", "coarse").agg(F.sum("s").alias("s")).select("sk", "coarse", before(["sk"], "coarse").alias("left_of"))
    starts = (
        ranges.select("sk", "coarse", "fine", before(["sk", "coarse"], "fine").alias("inner"))
        .join(wide, ["sk", "coarse"])
        .join(aims, "sk")
        .select("sk", "fine", (F.col("left_of") + F.col("inner")).alias("start"), "source_size", "g", "target")
    )
    local = W.partitionBy("sk", "fine").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("fine", fine).join(stored(starts, "mix-ranges"), ["sk", "fine"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("size").over(local), F.lit(0))
    )
    aim = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(aim / F.greatest("source_size", F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))
    taken = placed.withColumn("passes", passes).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), aim - F.col("passes") * F.col("source_size") - F.col("start")))
    )
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0).cast("long"))
    counted = taken.withColumns({"copies": copies, "taken": F.col("passes") * F.col("size") + F.col("part")})
    at = lambda k: reached((k * F.col("source_size") + F.col("start") + F.col("size") / F.lit(2.0)) / F.col("target"), F.col("g"))
    timed = counted.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        "copies",
        F.when(F.col("copies") > 0, at(F.lit(0))).alias("position"),
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0)).cast("int")), at)).alias("positions"),
        "key",
        "part",
        *[f"kept_{c}" for c in keep],
    )
    if keep:
        return timed
    return stored(timed, "mix-timed").orderBy(F.col("position").asc_nulls_last(), "key").drop("key", "part")


def draw(docs: DataFrame, position_col: str | None = None, **how) -> DataFrame:
    """The mixed corpus itself: the documents' columns, a row per copy, range-sorted in order of training.

    Copies are whole here: the one document that the mix would cut is taken if at least half of it is wanted.
    ``position_col`` names a column for each copy's position in training, from 0 to 1; without it the order of the
    rows alone tells.  Null and empty texts hold no words and are never drawn; a null id or source is like any
    other; repeated rows are drawn each; ties, which are equal in id and text, stand in any order; an empty
    table gives no rows; columns of any name are carried along.
    """
    columns = docs.columns
    if position_col in columns:
        raise ValueError(f"{position_col} is a column of the documents")
    mixed = mix(docs, keep=tuple(columns), **how)
    n = (F.col("taken") - F.col("part")) / F.greatest("size", F.lit(1)) + (F.col("part") * 2 >= F.greatest("size", F.lit(1))).cast("int")
    each = mixed.withColumn("n", n.cast("int")).where("n > 0").withColumn("at", F.explode(F.slice("positions", F.lit(1), F.col("n"))))
    position = [F.col("at").alias(position_col)] if position_col else []
    return each.orderBy("at", "key").select(*[F.col(f"kept_{c}").alias(c) for c in columns], *position)


#: The report in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT sk, source, sum(size)::BIGINT AS source_size FROM d GROUP BY sk, source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS pick FROM s0),
s2 AS (SELECT *, CASE pick WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE pick WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS g FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
   coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws FROM s2
   WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - caps) * w > 3 * source_size * (all_w - ws) AS capped FROM s3),
s5 AS (SELECT *, total - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0) AS rest, sum(w) FILTER (WHERE NOT capped) OVER () AS rest_w FROM s4),
t AS (SELECT sk, source_size, g, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (rest * w)::DOUBLE / rest_w::DOUBLE END AS target FROM s5),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.g, floor(t.target + 0.5)::BIGINT AS aim,
   coalesce(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
   FROM d JOIN t USING (sk)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END AS passes FROM p),
r AS (SELECT *, greatest(0, least(size, aim - passes * source_size - start)) AS part FROM q),
x AS (SELECT *, passes * size + part AS taken, least((start + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS x FROM r)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(1000000 * CASE WHEN g = 0 THEN x ELSE (sqrt((1 - g) * (1 - g) + 4 * g * x) - (1 - g)) / (2 * g) END)::BIGINT END AS position_ppm
FROM x
"""


def digest(mixed: DataFrame) -> DataFrame:
    """The report columns of :func:`mix`'s rows."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.col("position") * 1000000).cast("long").alias("position_ppm"))
