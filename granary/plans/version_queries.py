"""Queries over versions and generations: roots and snapshots are made of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import versions as ops
from granary.plans.registry import query, table

E = F.col

# Roots are users, files are event types by day of the month.
TREE = "tree AS (SELECT DISTINCT user_id AS root, event_type || '/' || day(ts) AS rel FROM events)"
SHARED = TREE + """, sizes AS (SELECT root, count(*) AS n FROM tree GROUP BY root),
pairs AS (SELECT x.root AS a, y.root AS b, count(*) AS common FROM tree x JOIN tree y USING (rel) WHERE x.root < y.root GROUP BY 1, 2),
sib AS (SELECT a, b, common, least(s.n, t.n) AS least FROM pairs JOIN sizes s ON s.root = a JOIN sizes t ON t.root = b)"""
EDGES = SHARED + """, e AS (SELECT a, b FROM sib WHERE common * 20 >= least * 11), links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS label FROM links UNION SELECT b.b, r.label FROM reach r JOIN links b ON b.a = r.node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node)"""
# A dated chain of roots v<k>, ten days each, whose files come and go; the value is a count.
SLICES = "slices AS (SELECT 'v' || (day(ts) - 1) // 10 AS root, ((day(ts) - 1) // 10)::INTEGER AS rank, user_id || '/' || event_type AS rel, count(*) AS value FROM events WHERE user_id % 4 <> (day(ts) - 1) // 10 GROUP BY ALL)"


def tree(spark, d):
    return table(spark, d, "events").select(E("user_id").alias("root"), F.concat_ws("/", "event_type", F.dayofmonth("ts").cast("string")).alias("rel")).distinct()


def slices(spark, d):
    rank = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    rows = table(spark, d, "events").select("user_id", rank.alias("rank"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("rel")).where("user_id % 4 <> rank")
    return rows.groupBy("rank", "rel").agg(F.count("*").alias("value")).withColumns({"root": F.concat(F.lit("v"), E("rank").cast("string")), "grp": F.lit(0)})


@query("j_siblings", f"WITH {SHARED} SELECT a, b, common, least FROM sib WHERE common * 2 >= least")
def _(spark, d):
    return ops.siblings(tree(spark, d))


@query("set_components", f"WITH RECURSIVE {EDGES} SELECT node, label FROM comp")
def _(spark, d):
    return ops.related(tree(spark, d), 11, 20)


@query("dom_version_groups", f"WITH RECURSIVE {EDGES} SELECT node AS root, label AS grp, row_number() OVER (PARTITION BY label ORDER BY node)::INTEGER - 1 AS rank FROM comp")
def _(spark, d):
    return ops.groups(tree(spark, d), 11, 20)


@query("win_rank", "SELECT n_nationkey AS id, n_regionkey AS grp, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER - 1 AS rank FROM nation")
def _(spark, d):
    """Names end in numbers, so natural order is that of the keys."""
    return ops.ranked(table(spark, d, "nation").select(E("n_nationkey").alias("id"), E("n_regionkey").alias("grp"), E("n_name").alias("root"))).select("id", "grp", "rank")


@query("j_base", f"WITH {SLICES} SELECT rank, rel, lag(root) OVER (PARTITION BY rel ORDER BY rank) AS base FROM slices")
def _(spark, d):
    return ops.base(slices(spark, d)).select("rank", "rel", "base")


@query("j_first", f"WITH {SLICES} SELECT rank, rel, nullif(first(root) OVER (PARTITION BY rel ORDER BY rank), root) AS first FROM slices")
def _(spark, d):
    return ops.base(slices(spark, d)).select("rank", "rel", "first")


@query("j_base_of", f"WITH {SLICES}, asked AS (SELECT DISTINCT rel, 3 AS rank FROM slices UNION ALL SELECT DISTINCT rel, 1 FROM slices) SELECT a.rank, a.rel, (SELECT arg_max(s.root, s.rank) FROM slices s WHERE s.rel = a.rel AND s.rank < a.rank) AS base FROM asked a")
def _(spark, d):
    """Asked of paths that their own rank needn't have."""
    rows = slices(spark, d)
    rels = rows.select("rel").distinct()
    asked = rels.select(F.lit(0).alias("grp"), F.lit(3).alias("rank"), "rel").union(rels.select(F.lit(0), F.lit(1), "rel"))
    return ops.base_of(asked, rows).select("rank", "rel", "base")


@query("srt_versions", f"WITH {SLICES}, f AS (SELECT root, rank, rel, root || '/' || rel AS path, rel LIKE '%click' AS grouped FROM slices) SELECT path, row_number() OVER (ORDER BY CASE WHEN grouped THEN rel ELSE path END, CASE WHEN grouped THEN rank ELSE 0 END, path) - 1 AS pos FROM f")
def _(spark, d):
    from granary.store import numbered

    rows = slices(spark, d).withColumns({"path": F.concat_ws("/", "root", "rel"), "grouped": E("rel").endswith("click")})
    return numbered(rows, F.when(E("grouped"), E("rel")).otherwise(E("path")), F.when(E("grouped"), E("rank")).otherwise(0), E("path"), column="pos").select("path", "pos")


@query("dom_chunk_status", f"WITH {SLICES} SELECT rank, rel, CASE WHEN lag(value) OVER w IS NULL THEN 'new' WHEN lag(value) OVER w = value THEN 'unchanged' ELSE 'changed' END AS status FROM slices WINDOW w AS (PARTITION BY rel ORDER BY rank)")
def _(spark, d):
    return ops.chunk_status(slices(spark, d).withColumnRenamed("value", "hash")).select("rank", "rel", "status")


@query("j_merge", f"WITH {SLICES} SELECT coalesce(n.rel, o.rel) AS path, coalesce(n.value, o.value) AS value FROM (SELECT * FROM slices WHERE rank = 0) o FULL JOIN (SELECT * FROM slices WHERE rank = 1) n ON o.rel = n.rel WHERE n.rel IS NOT NULL OR o.rel NOT LIKE '%view'")
def _(spark, d):
    rows = slices(spark, d).withColumnRenamed("rel", "path")
    old, new = rows.where("rank = 0").select("path", "value"), rows.where("rank = 1").select("path", "value")
    return ops.merge(old, new, rows.where("path like '%view'").select("path"))


@query("j_snapshot", f"WITH {SLICES} SELECT rel AS path FROM slices WHERE rank = 0 AND rel NOT IN (SELECT rel FROM slices WHERE rank = 1)")
def _(spark, d):
    rows = slices(spark, d).withColumnRenamed("rel", "path")
    return ops.missing(rows.where("rank = 0"), rows.where("rank = 1"))


# Changes: a slice's files are put in its generation, and those that the slice lacks are deleted.
CHANGES = SLICES + """, gens AS (SELECT DISTINCT rank FROM slices), changes AS (SELECT rel AS path, rank AS generation, 'put' AS op, value FROM slices
 UNION ALL SELECT p.rel, g.rank, 'delete', NULL FROM (SELECT DISTINCT rel FROM slices) p, gens g WHERE g.rank > 0 AND NOT EXISTS (SELECT 1 FROM slices s WHERE s.rel = p.rel AND s.rank = g.rank) AND EXISTS (SELECT 1 FROM slices s WHERE s.rel = p.rel AND s.rank = g.rank - 1))"""


def changes(spark, d):
    rows = slices(spark, d).select(E("rel").alias("path"), E("rank").alias("generation"), F.lit("put").alias("op"), "value")
    out = rows
    for g in (1, 2, 3):  # the month's slices
        old, new = rows.where(E("generation") == g - 1), rows.where(E("generation") == g)
        there = new.limit(1).select(F.lit(True).alias("there"))
        gone = ops.missing(old, new).join(there, how="cross").select("path", F.lit(g).alias("generation"), F.lit("delete").alias("op"), F.lit(None).cast("long").alias("value"))
        out = out.union(gone)
    return out


SNAPSHOT = "SELECT path, arg_max(value, generation) FILTER (WHERE op = 'put') AS value FROM changes WHERE generation <= {g} GROUP BY path HAVING arg_max(op, generation) <> 'delete'"


@query("gen_append", f"WITH {CHANGES} " + SNAPSHOT.format(g=9))
def _(spark, d):
    return ops.snapshot(changes(spark, d), 9)


@query("src_generation", f"WITH {CHANGES} " + SNAPSHOT.format(g=1))
def _(spark, d):
    return ops.snapshot(changes(spark, d), 1)


@query("gen_history", f"WITH {CHANGES}, n AS (SELECT generation, count(*) AS changes FROM changes GROUP BY generation) SELECT generation, changes, coalesce(generation = lag(generation) OVER (ORDER BY generation) + 1, true) AS follows, row_number() OVER (ORDER BY generation DESC)::INTEGER - 1 AS pos FROM n")
def _(spark, d):
    return ops.history(changes(spark, d).groupBy("generation").agg(F.count("*").alias("changes")))


@query("gen_committed", f"WITH {SLICES} SELECT max(rank) AS generation FROM slices WHERE rank < 2")
def _(spark, d):
    """The last slices are torn: they have no marker."""
    return ops.last_committed(slices(spark, d).select(E("rank").alias("generation")).distinct().withColumn("complete", E("generation") < 2))


@query("gen_rollback", f"WITH {CHANGES} SELECT path, generation, op, value FROM changes WHERE generation <= 1")
def _(spark, d):
    return ops.rollback(changes(spark, d), 1)


@query("gen_delete", f"WITH {CHANGES} SELECT path, value FROM ({SNAPSHOT.format(g=9)}) WHERE path NOT IN ('1/click', '2/view')")
def _(spark, d):
    rows = changes(spark, d)
    return ops.snapshot(ops.delete(rows, 10, ["1/click", "2/view"]), 10)
