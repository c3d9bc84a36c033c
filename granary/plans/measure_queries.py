"""Queries over measurements: tool, setting and class are flags and months of ``lineitem``; repeats are lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import measures as ops
from granary.plans.registry import query, table
from granary.store import numbered

E = F.col

#: Lines as measured rows; ord is their order, wide enough to be unique in practice and by price otherwise.
LINES = """
SELECT l_returnflag AS tool, l_linestatus AS setting, 'm' || CAST(month(l_shipdate) AS VARCHAR(2)) AS class, CAST(l_quantity AS BIGINT) AS threads,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS archive_bytes, CAST(round(l_extendedprice * 100) AS BIGINT) + l_partkey AS class_bytes, l_quantity AS wall,
  l_partkey * 1000 AS compress_peak, l_suppkey * 5000 AS extract_peak, l_discount > 0.05 AS flagged,
  l_orderkey * 10 + l_linenumber AS ord, l_tax AS score, l_discount AS discount
FROM {lineitem}
"""
M = f"m AS ({LINES.format(lineitem='lineitem')})"
#: One row per combination: sums and medians of its lines, in whole numbers wherever order could matter.
R = M + """, r AS (SELECT tool, setting, class, min(ord) AS ord, sum(archive_bytes)::BIGINT AS archive_bytes, sum(class_bytes)::BIGINT AS class_bytes, median(wall) AS wall, max(compress_peak) AS compress_peak, max(extract_peak) AS extract_peak,
 round(sum(archive_bytes) * 100.0::DOUBLE / sum(class_bytes), 6) AS size_pct, round(sum(class_bytes) / 1e6::DOUBLE / median(wall), 6) AS mbps FROM m GROUP BY tool, setting, class)"""
MIX = "mix AS (SELECT * FROM (VALUES ('m1', 50), ('m2', 30), ('m3', 20)) v(class, weight))"
RATIO = "sum(weight * archive_bytes / class_bytes::DOUBLE) / sum(weight) * 100"


def lines(spark, d):
    return spark.sql(LINES, lineitem=table(spark, d, "lineitem"))


def combos(spark, d):
    g = lines(spark, d).groupBy("tool", "setting", "class").agg(
        F.min("ord").alias("ord"), F.sum("archive_bytes").alias("archive_bytes"), F.sum("class_bytes").alias("class_bytes"), ops.median_double(E("wall")).alias("wall"),
        F.max("compress_peak").alias("compress_peak"), F.max("extract_peak").alias("extract_peak"),
    )
    return ops.rates(g).withColumns({"size_pct": F.round("size_pct", 6), "mbps": F.round("mbps", 6)})


def mix(spark):
    return spark.createDataFrame([("m1", 50), ("m2", 30), ("m3", 20)], "class string, weight int")


def sql(select: str, more: str = "", base: str = R) -> str:
    return f"WITH {base}{more} {select}"


# ---- medians


@query("agg_median_f64", sql("SELECT tool, setting, class, median(wall) AS wall FROM m GROUP BY ALL", base=M))
def _(spark, d):
    return lines(spark, d).groupBy("tool", "setting", "class").agg(ops.median_double(E("wall")).alias("wall"))


@query("agg_median_u64", sql("SELECT class, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) // 2 AS bytes FROM (SELECT class, list_sort(list(archive_bytes + 4503599627370497)) AS s FROM m GROUP BY class)", base=M))
def _(spark, d):
    return ops.medians_whole(lines(spark, d).select("class", (E("archive_bytes") + 4503599627370497).alias("bytes")), ["class"], ["bytes"])


@query("agg_median_opt", sql("SELECT tool, setting, class, CASE WHEN count(*) = count(nullif(threads, 50)) THEN median(nullif(threads, 50)) END AS threads FROM m GROUP BY ALL", base=M))
def _(spark, d):
    some = F.nullif(E("threads"), F.lit(50))
    return lines(spark, d).groupBy("tool", "setting", "class").agg(ops.median_if_all(some).alias("threads"))


@query("agg_median_struct", sql("SELECT tool, setting, median(wall) AS wall, floor((list_sort(list(archive_bytes))[(count(*) + 1) // 2] + list_sort(list(archive_bytes))[count(*) // 2 + 1]) / 2)::BIGINT AS archive_bytes, bool_or(flagged) AS flagged FROM m GROUP BY ALL", base=M))
def _(spark, d):
    return ops.median_struct(lines(spark, d), ["tool", "setting"], ["wall"], ["archive_bytes"], ["flagged"])


# ---- rates, blends, bests


@query("agg_rates", sql("SELECT tool, setting, class, size_pct, mbps, greatest(compress_peak, extract_peak) / 1048576.0::DOUBLE AS mib, false AS failed FROM r"))
def _(spark, d):
    return combos(spark, d).select("tool", "setting", "class", "size_pct", "mbps", "mib", "failed")


@query("agg_blend", sql("SELECT tool, setting, round(sum(weight * size_pct) / sum(weight), 6) AS size_pct, round(sum(weight) / sum(weight / mbps), 6) AS mbps FROM r JOIN mix USING (class) GROUP BY ALL HAVING count(*) = 3", ", " + MIX))
def _(spark, d):
    return ops.blend(combos(spark, d), mix(spark), ["tool", "setting"]).select("tool", "setting", F.round("size_pct", 6).alias("size_pct"), F.round("mbps", 6).alias("mbps"))


@query("agg_mix_ratio", sql(f"SELECT tool, setting, round({RATIO}, 6) AS ratio_pct FROM r JOIN mix USING (class) GROUP BY ALL", ", " + MIX))
def _(spark, d):
    return ops.mix_ratio(combos(spark, d), mix(spark), ["tool", "setting"]).select("tool", "setting", F.round("ratio_pct", 6).alias("ratio_pct"))


BEST = "SELECT class, tool, setting, archive_bytes FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY archive_bytes, ord) AS n FROM r{where}) WHERE n = 1"


@query("agg_best", sql(BEST.format(where="")))
def _(spark, d):
    return ops.best(combos(spark, d))


@query("agg_best_gate", sql(BEST.format(where=" WHERE tool <> 'A' AND setting <> 'O'")))
def _(spark, d):
    return ops.best(combos(spark, d), keep=(E("tool") != "A") & (E("setting") != "O"))


@query("j_division", sql("SELECT tool, setting FROM r WHERE class IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING count(DISTINCT class) = 3"))
def _(spark, d):
    return ops.on_every_class(combos(spark, d), mix(spark))


@query("agg_best_single", sql("SELECT tool, setting, sum(archive_bytes)::BIGINT AS total FROM r WHERE class IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING count(DISTINCT class) = 3 ORDER BY total, min(ord) LIMIT 1"))
def _(spark, d):
    return ops.best_single(combos(spark, d), mix(spark))


@query("agg_best_mix", sql(f"SELECT tool, setting, round({RATIO}, 6) AS ratio_pct FROM r JOIN mix USING (class) GROUP BY ALL HAVING count(*) = 3 ORDER BY round({RATIO}, 9), min(ord) LIMIT 1", ", " + MIX))
def _(spark, d):
    return ops.best_mix(combos(spark, d), mix(spark)).withColumn("ratio_pct", F.round("ratio_pct", 6))


# ---- comparisons

A_B = ", a AS (SELECT tool, setting, class, CASE WHEN tool = 'R' AND class = 'm1' THEN NULL ELSE archive_bytes END AS value FROM r WHERE NOT (tool = 'N' AND setting = 'O')), b AS (SELECT tool, setting, class, CASE WHEN setting = 'F' AND tool = 'N' AND class = 'm2' THEN NULL ELSE archive_bytes + ord END AS value FROM r WHERE NOT (tool = 'A' AND setting = 'F'))"
SUMS = ", sa AS (SELECT tool, setting, CASE WHEN count(*) = count(value) THEN sum(value) END AS v, 1 AS i FROM a GROUP BY ALL), sb AS (SELECT tool, setting, CASE WHEN count(*) = count(value) THEN sum(value) END AS v, 1 AS i FROM b GROUP BY ALL), j AS (SELECT coalesce(sa.tool, sb.tool) AS tool, coalesce(sa.setting, sb.setting) AS setting, sa.v AS a, sb.v AS b, sa.i AS ia, sb.i AS ib FROM sa FULL JOIN sb ON sa.tool = sb.tool AND sa.setting = sb.setting)"


def two_runs(spark, d):
    rows = combos(spark, d)
    a = rows.where("not (tool = 'N' and setting = 'O')").select("tool", "setting", "class", F.expr("case when tool = 'R' and class = 'm1' then null else archive_bytes end").alias("value"))
    b = rows.where("not (tool = 'A' and setting = 'F')").select("tool", "setting", "class", F.expr("case when setting = 'F' and tool = 'N' and class = 'm2' then null else archive_bytes + ord end").alias("value"))
    return a, b


@query("j_compare", sql("SELECT tool, setting, CASE WHEN ib IS NULL THEN 'only a' WHEN ia IS NULL THEN 'only b' WHEN a IS NULL AND b IS NULL THEN 'failed in both' WHEN a IS NULL THEN 'failed in a' WHEN b IS NULL THEN 'failed in b' ELSE 'both' END AS state FROM j", A_B + SUMS))
def _(spark, d):
    return ops.compare(*two_runs(spark, d)).select("tool", "setting", "state")


@query("agg_compare", sql("SELECT tool, setting, round(abs((b - a) * 100.0::DOUBLE / a), 6) AS pct, abs((b - a) * 100.0::DOUBLE / a) <= 3 AS within FROM j", A_B + SUMS))
def _(spark, d):
    return ops.compare(*two_runs(spark, d)).select("tool", "setting", F.round("pct", 6).alias("pct"), "within")


@query("j_size", sql("SELECT coalesce(a.tool, b.tool) AS tool, coalesce(a.setting, b.setting) AS setting, coalesce(a.class, b.class) AS class, CASE WHEN b.tool IS NULL THEN 'missing' WHEN a.tool IS NULL THEN 'extra' WHEN (b.value - a.value) * 100.0::DOUBLE / a.value > 0.001 THEN 'larger' ELSE 'ok' END AS verdict FROM (SELECT * FROM a WHERE value IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE value IS NOT NULL) b ON a.tool = b.tool AND a.setting = b.setting AND a.class = b.class", A_B))
def _(spark, d):
    a, b = (x.where("value is not null").withColumnRenamed("value", "bytes") for x in two_runs(spark, d))
    return ops.size_gate(a, b, 0.001).select("tool", "setting", "class", "verdict")


@query("agg_growth_pct", "SELECT o_orderkey AS id, CASE WHEN old = 0 AND new = 0 THEN 0.0::DOUBLE WHEN old = 0 THEN 'inf'::DOUBLE ELSE round((new - old) * 100.0::DOUBLE / old, 9) END AS pct FROM (SELECT o_orderkey, o_orderkey % 7 AS old, o_custkey % 11 AS new FROM orders)")
def _(spark, d):
    rows = table(spark, d, "orders").select(E("o_orderkey").alias("id"), (E("o_orderkey") % 7).alias("old"), (E("o_custkey") % 11).alias("new"))
    pct = ops.growth_pct(E("old"), E("new"))
    # Spark's round takes the sign from a zero, which negative keys have here and in SQL.
    return rows.select("id", F.when(pct == 0, pct).otherwise(F.round(pct, 9)).alias("pct"))


TREES = ", x AS (SELECT doc_id::VARCHAR AS path, n_chars AS size, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 3), y AS (SELECT doc_id::VARCHAR AS path, n_chars + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS size, CASE doc_id % 10 WHEN 5 THEN NULL WHEN 6 THEN 'other' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 7)"


@query("j_diff", f"WITH {TREES[2:]} SELECT * FROM (SELECT coalesce(x.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'missing' WHEN x.path IS NULL THEN 'extra' WHEN y.hash IS NULL THEN 'unreadable' WHEN x.size <> y.size THEN 'size' WHEN x.hash <> y.hash THEN 'content' END AS kind, CASE WHEN y.path IS NULL THEN 0 WHEN x.path IS NULL THEN 2 ELSE 1 END AS place FROM x FULL JOIN y ON x.path = y.path) WHERE kind IS NOT NULL")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", E("doc_id").cast("string").alias("path"), E("n_chars").alias("size"), F.sha2("text", 256).alias("hash"))
    k = E("doc_id") % 10
    other = docs.where(k != 7).select("path", (E("size") + F.when(k == 4, 1).otherwise(0)).alias("size"), F.when(k == 6, "other").when(k != 5, E("hash")).alias("hash"))
    return ops.tree_diff(docs.where(k != 3), other)


LATER = ", later AS (SELECT tool, setting, class, archive_bytes + 1 AS archive_bytes FROM r WHERE class IN ('m1', 'm2'))"


@query("j_supersede", sql("SELECT tool, setting, class, archive_bytes FROM r WHERE class NOT IN ('m1', 'm2') UNION ALL SELECT * FROM later", LATER))
def _(spark, d):
    rows = combos(spark, d).select("tool", "setting", "class", "archive_bytes")
    return ops.superseded(rows, rows.where("class in ('m1', 'm2')").withColumn("archive_bytes", E("archive_bytes") + 1), ["tool", "setting", "class"])


@query("set_pool", sql("SELECT tool || '/' || setting || '/' || class AS what, 'repeated' AS fault FROM r WHERE class = 'm3' UNION ALL SELECT 'host', 'differs' UNION ALL SELECT class, 'several manifests' FROM r GROUP BY class HAVING count(DISTINCT CASE WHEN class = 'm4' THEN setting ELSE '' END) > 1"))
def _(spark, d):
    rows = combos(spark, d).select("tool", "setting", "class", F.when(E("class") == "m3", "h2").otherwise("h1").alias("host"), F.lit("full").alias("profile"), F.when(E("class") == "m4", E("setting")).otherwise("").alias("manifest"))
    return ops.pooled_faults(rows.union(rows.where("class = 'm3'")))


@query("set_pool_digest", sql("SELECT class, count(DISTINCT threads) AS n FROM m GROUP BY class HAVING count(DISTINCT threads) > 1", base=M))
def _(spark, d):
    return ops.several_manifests(lines(spark, d).select("class", E("threads").alias("manifest")))


@query("j_plan", sql("SELECT DISTINCT tool, setting, class, first(archive_bytes) OVER (PARTITION BY tool, setting, class ORDER BY ord, archive_bytes) AS value FROM m WHERE class IN ('m1', 'm5')", base=M))
def _(spark, d):
    rows = lines(spark, d).withColumn("ord", F.struct("ord", "archive_bytes")).withColumn("value", E("archive_bytes"))
    plan = rows.select("tool", "setting").distinct().crossJoin(spark.createDataFrame([("m1",), ("m5",), ("none",)], "class string"))
    return ops.planned(plan, rows).select("tool", "setting", "class", "value")


@query("set_distinct", sql("SELECT tool, setting, row_number() OVER (ORDER BY min(ord), tool, setting) - 1 AS pos FROM m GROUP BY tool, setting", base=M))
def _(spark, d):
    from granary.store import numbered

    return numbered(lines(spark, d).groupBy("tool", "setting").agg(F.min("ord").alias("ord")), "ord", "tool", "setting", column="pos").select("tool", "setting", "pos")


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(E("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "customer").select(E("c_custkey").alias("k")).join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(E("o_custkey").alias("k")), "k", "left_anti")


@query("set_equal", "SELECT tool, list_sort(list(DISTINCT class)) = (SELECT list_sort(list(DISTINCT 'm' || month(l_shipdate))) FROM lineitem) AS same FROM (SELECT l_returnflag AS tool, 'm' || month(l_shipdate) AS class FROM lineitem WHERE l_returnflag <> 'N' OR month(l_shipdate) <> 1) GROUP BY tool")
def _(spark, d):
    rows = lines(spark, d)
    every = rows.select("class").distinct()
    some = rows.where("tool <> 'N' or class <> 'm1'").select("tool", "class").distinct()
    pairs = some.select("tool").distinct().crossJoin(F.broadcast(every)).withColumn("wanted", F.lit(True))  # tools by months
    both = pairs.join(some.withColumn("there", F.lit(True)), ["tool", "class"], "full_outer")
    return both.groupBy("tool").agg(F.bool_and(E("wanted").isNotNull() & E("there").isNotNull()).alias("same"))


# ---- gates over scores

GRID = ", g AS (SELECT class, score, t AS threshold, n AS truth_name, CASE n WHEN 'flagged' THEN flagged ELSE threads > 25 END AS truth FROM m, (VALUES (0.02), (0.05), (0.07)) a(t), (VALUES ('flagged'), ('large')) b(n))"
CELLS = "count(*) FILTER (WHERE score >= threshold::DOUBLE AND truth) AS tp, count(*) FILTER (WHERE score >= threshold::DOUBLE AND NOT truth) AS fp, count(*) FILTER (WHERE score < threshold::DOUBLE AND NOT truth) AS tn, count(*) FILTER (WHERE score < threshold::DOUBLE AND truth) AS fn"


def matrix(spark, d):
    return ops.confusion(lines(spark, d).withColumn("large", E("threads") > 25), [0.02, 0.05, 0.07], ["flagged", "large"])


@query("agg_confusion", sql(f"SELECT class, threshold::DOUBLE AS threshold, truth_name, {CELLS} FROM g GROUP BY ALL", GRID, M))
def _(spark, d):
    return matrix(spark, d)


@query("agg_pooled", sql(f"SELECT threshold::DOUBLE AS threshold, truth_name, {CELLS} FROM g GROUP BY ALL", GRID, M))
def _(spark, d):
    return ops.pooled(matrix(spark, d))


@query("agg_prec_recall", sql(f"SELECT threshold, truth_name, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM (SELECT threshold::DOUBLE AS threshold, truth_name, {CELLS} FROM g GROUP BY ALL)", GRID, M))
def _(spark, d):
    return ops.precision_recall(ops.pooled(matrix(spark, d))).select("threshold", "truth_name", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


GATES = "SELECT * FROM (VALUES ('G1', 'PASS'), ('G2', 'FAIL'), ('G3', 'not evaluable'), ('G4', 'PASS')) v(gate, state)"


def gates(spark):
    rows = spark.createDataFrame([("G1", 88.0, 90.0, True), ("G2", 110.4, 50.0, True), ("G3", None, 85.0, True), ("G4", 81.0, 80.0, False)], "gate string, value double, lim double, below boolean")
    return rows.select("gate", F.when(E("below"), ops.gate(E("value"), E("lim"))).otherwise(ops.gate(E("value"), E("lim"), False)).alias("state"))


@query("agg_gates", GATES)
def _(spark, d):
    return gates(spark)


@query("dom_verdict", "SELECT 'NO-GO: failing gates: G2; open gates: G3' AS verdict")
def _(spark, d):
    return ops.verdict(gates(spark))


# ---- accounting


@query("agg_manifest", "SELECT source AS class, count(*) OVER (PARTITION BY source) AS files, (sum(n_chars) OVER (PARTITION BY source))::BIGINT AS bytes_total, doc_id AS member FROM documents")
def _(spark, d):
    """A row per member beside its class's totals."""
    docs = table(spark, d, "documents").select(E("source").alias("class"), "n_chars", E("doc_id").alias("member"))
    totals = docs.groupBy("class").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes_total"))
    return docs.join(totals, "class").select("class", "files", "bytes_total", "member")


def manifest_rows(docs, most=1000):
    """Manifests as JSON, each of ``most`` files at most and with the total of its class."""
    one = F.struct(F.sha2("text", 256).alias("digest"), E("n_chars").alias("bytes"), F.lit("none").alias("licence"), E("doc_id").cast("string").alias("path"), "source")
    files = numbered(docs.select("lang", "doc_id", one.alias("file")), "lang", "doc_id", column="i")
    totals = files.groupBy("lang").agg(F.sum("file.bytes").alias("bytes_total"))
    parts = files.groupBy("lang", F.floor(E("i") / most).alias("part")).agg(F.collect_list("file").alias("files")).join(totals, "lang")
    return parts.select(F.to_json(F.create_map("lang", F.struct("bytes_total", "files"))).alias("json"))


def manifests_read(docs):
    """The table is written as manifests per class and read as one."""
    from granary.sources.walk import manifest

    return manifest(manifest_rows(docs)).select("class", "bytes_total", "bytes", "path", "source")


@query("src_manifest", "SELECT lang AS class, sum(n_chars) OVER (PARTITION BY lang)::BIGINT AS bytes_total, n_chars AS bytes, doc_id::VARCHAR AS path, source FROM documents")
def _(spark, d):
    return manifests_read(table(spark, d, "documents"))


@query("src_results_json", "SELECT user_id::VARCHAR AS run, event_type || '.json' AS file, user_id % 5 = 0 AS aborted, event_type AS tool, sum(event_id)::BIGINT AS bytes FROM events GROUP BY user_id, event_type")
def _(spark, d):
    """Run folders are written, a file per result and a mark in each that was finished, and read as they lie there."""
    from granary.sources.sinks import write_files
    from granary.sources.walk import results
    from granary.store import fresh_path

    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("event_id").alias("bytes"))
    one = F.to_json(F.struct(F.struct(E("event_type").alias("id")).alias("tool"), F.lit("c").alias("class"), F.array(F.struct(E("bytes").alias("archive_bytes"))).alias("repeats")))
    files = rows.select(F.format_string("%d/%s.json", "user_id", "event_type").alias("path"), one.alias("content"))
    marks = rows.where("user_id % 5 <> 0").select(F.format_string("%d/run.json", "user_id"), F.lit("{}")).distinct()
    folder = fresh_path(spark, "runs")
    write_files(files.union(marks), folder)
    return results(spark, folder).select("run", "file", "aborted", E("tool.id").alias("tool"), E("repeats")[0]["archive_bytes"].alias("bytes"))


@query("src_registry", "SELECT p_partkey AS id, p_brand AS class FROM part WHERE p_size % 2 = 0")
def _(spark, d):
    from granary.sources.walk import registry_select

    sources = table(spark, d, "part").select(E("p_partkey").alias("id"), E("p_brand").alias("class"), F.when(E("p_size") % 2 == 0, F.array(F.lit("full"), F.lit("quick"))).otherwise(F.array(F.lit("full"))).alias("profiles"))
    return registry_select(sources, "quick").select("id", "class")


def two_lists(spark, d):
    """Expected and found files: of thirteen one isn't expected, one is missing and one altered."""
    docs = table(spark, d, "documents").select("source", E("doc_id").cast("string").alias("path"), E("n_chars").alias("bytes"), F.sha2("text", 256).alias("digest"), (E("doc_id") % 13).alias("k"))
    return docs.where("k <> 1"), docs.where("k <> 2").withColumn("digest", F.when(E("k") == 3, "other").otherwise(E("digest")))


@query("agg_accounting", "SELECT source, count(*) FILTER (WHERE doc_id % 13 <> 1) AS expected, count(*) FILTER (WHERE doc_id % 13 <> 2) AS found, coalesce(sum(n_chars) FILTER (WHERE doc_id % 13 <> 1), 0)::BIGINT AS expected_bytes, coalesce(sum(n_chars) FILTER (WHERE doc_id % 13 <> 2), 0)::BIGINT AS found_bytes, count(*) FILTER (WHERE doc_id % 13 = 2) AS missing, count(*) FILTER (WHERE doc_id % 13 = 3) AS altered FROM documents GROUP BY source")
def _(spark, d):
    return ops.accounting(*two_lists(spark, d))


@query("agg_accounting_faults", "SELECT source, doc_id::VARCHAR AS path, CASE doc_id % 13 WHEN 2 THEN 'missing' ELSE 'altered' END AS fault FROM documents WHERE doc_id % 13 IN (2, 3)")
def _(spark, d):
    return ops.accounting_faults(*two_lists(spark, d))


@query("agg_digest_check", "SELECT CASE WHEN doc_id % 11 = 1 THEN 'no class' WHEN doc_id % 11 = 2 THEN 'no digest' WHEN doc_id % 11 = 3 THEN 'differs' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (E("doc_id") % 11).alias("k"), E("doc_id").cast("string").alias("class"), F.sha2("text", 256).alias("digest"))
    rows = docs.select("class", F.when(E("k") == 3, "other").when(E("k") != 2, E("digest")).alias("digest"))
    return ops.digest_check(rows, docs.where("k <> 1").select("class", "digest"))


@query("agg_domain", "SELECT l.ord, l.label, count(e.event_id) AS n, coalesce(sum(e.user_id), 0)::BIGINT AS bytes FROM (VALUES (0, 'click'), (1, 'nothing'), (2, 'view'), (3, 'error')) l(ord, label) LEFT JOIN events e ON e.event_type = l.label GROUP BY ALL")
def _(spark, d):
    return ops.by_label(table(spark, d, "events").select(E("event_type").alias("label"), E("user_id").alias("bytes")), ["click", "nothing", "view", "error"])


@query("agg_two_level", "SELECT n_regionkey AS class, coalesce(count(c_custkey), 0) AS files, coalesce(sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END), 0)::BIGINT AS bytes FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey UNION ALL SELECT 99, 0, 0")
def _(spark, d):
    locks = table(spark, d, "customer").select(E("c_nationkey").alias("source"), F.when(E("c_custkey") % 3 != 0, E("c_custkey")).alias("bytes"))
    sources = table(spark, d, "nation").select(E("n_nationkey").alias("source"), E("n_regionkey").alias("class"))
    return ops.two_level(locks, sources, sources.select("class").distinct().union(spark.createDataFrame([(99,)], "class int")))


@query("agg_bucket", sql("SELECT CASE WHEN x < 1 THEN 'under_1_pct' WHEN x < 5 THEN '1_to_5_pct' WHEN x < 10 THEN '5_to_10_pct' WHEN x < 25 THEN '10_to_25_pct' WHEN x < 50 THEN '25_to_50_pct' ELSE '50_pct_or_more' END AS bucket, count(*) AS n FROM (SELECT ord % 97 * threads * 100 / archive_bytes::DOUBLE * 100 AS x FROM m) GROUP BY 1", base=M))
def _(spark, d):
    part = E("ord") % 97 * E("threads") * 100
    return lines(spark, d).groupBy(ops.bucket(part, E("archive_bytes")).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_map_sum", "SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.create_map("event_type", F.lit(1).cast("long")).alias("counts"))
    return ops.map_sum(rows, ["user_id"], "counts").select("user_id", F.explode("counts").alias("k", "v"))


FILES = "f AS (SELECT lang AS class, CASE WHEN doc_id % 4 > 0 THEN source END AS folder, n_chars AS bytes, doc_id % 3 > 0 AS ok, n_chars // 2 AS packed, CASE doc_id % 6 WHEN 0 THEN 'size' WHEN 3 THEN 'type' END AS cause FROM documents)"


def file_results(spark, d):
    return table(spark, d, "documents").select(
        E("lang").alias("class"), F.when(E("doc_id") % 4 > 0, E("source")).alias("folder"), E("n_chars").alias("bytes"), (E("doc_id") % 3 > 0).alias("ok"), F.shiftright("n_chars", 1).alias("packed"),
        F.when(E("doc_id") % 6 == 0, "size").when(E("doc_id") % 6 == 3, "type").alias("cause"),
    )


@query("agg_rollup", f"WITH {FILES}, g AS (SELECT *, coalesce(folder, '(class folder)') AS fo FROM f) SELECT coalesce(CASE WHEN grouping(class) = 1 THEN 'all' WHEN grouping(fo) = 1 THEN class ELSE class || '/' || fo END, '') AS label, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE ok) AS ok, sum(CASE WHEN ok THEN packed ELSE bytes END)::BIGINT AS after_fallback FROM g GROUP BY ROLLUP (class, fo)")
def _(spark, d):
    return ops.rollup(file_results(spark, d))


@query("agg_case_counts", f"WITH {FILES} SELECT class, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failure, count(*) FILTER (WHERE cause = 'size') AS by_size, count(*) FILTER (WHERE cause = 'type') AS by_type, coalesce(sum(bytes) FILTER (WHERE ok), 0)::BIGINT AS ok_bytes, sum(CASE WHEN ok THEN packed ELSE bytes END)::BIGINT AS after_fallback FROM f GROUP BY class")
def _(spark, d):
    return ops.case_counts(file_results(spark, d))


@query("agg_delta_gate", sql("SELECT class, min(archive_bytes) FILTER (WHERE tool = 'A') AS ours, min(archive_bytes) FILTER (WHERE tool <> 'A' AND setting <> 'O') AS theirs, arg_min(tool, archive_bytes) FILTER (WHERE tool <> 'A' AND setting <> 'O') AS rival, greatest(min(archive_bytes) FILTER (WHERE tool <> 'A' AND setting <> 'O') - min(archive_bytes) FILTER (WHERE tool = 'A'), 0) AS gain, CASE WHEN min(archive_bytes) FILTER (WHERE tool = 'A') * 100 <= min(archive_bytes) FILTER (WHERE tool <> 'A' AND setting <> 'O') * 95 THEN 'pass' ELSE 'fail' END AS decision FROM r GROUP BY class"))
def _(spark, d):
    return ops.delta_gate(combos(spark, d).withColumns({"subject": E("tool") == "A", "dedup": E("setting") == "O"}), 95)


RULES = "CASE class WHEN 'm1' THEN 'jpeg' WHEN 'm2' THEN 'deflate' WHEN 'm3' THEN 'backup' WHEN 'm4' THEN 'video' ELSE 'none' END"


@query("agg_est", sql(f"SELECT tool, setting, class, CASE class WHEN 'm1' THEN CASE WHEN setting = 'O' THEN class_bytes ELSE archive_bytes - 7 END WHEN 'm2' THEN archive_bytes + CASE WHEN setting = 'F' THEN ord ELSE 0 END WHEN 'm3' THEN least(archive_bytes // 2, class_bytes // 3) WHEN 'm4' THEN class_bytes ELSE archive_bytes END AS estimate, CASE WHEN class IN ('m1', 'm2', 'm3', 'm4') THEN {RULES} ELSE 'no gain claimed' END AS rule FROM r"))
def _(spark, d):
    rows = combos(spark, d).selectExpr(
        "concat_ws('|', tool, setting, class) AS class", f"{RULES} AS rule", "class_bytes AS bytes", "IF(setting = 'O', NULL, archive_bytes - 7) AS lepton", "archive_bytes AS packed",
        "IF(setting = 'F', ord, NULL) AS correction", "archive_bytes DIV 2 AS derived_a", "class_bytes DIV 3 AS derived_b", "archive_bytes AS best",
    )
    part = lambda i: F.split("class", r"\|")[i]
    return ops.estimates(rows).select(part(0).alias("tool"), part(1).alias("setting"), part(2).alias("class"), "estimate", "rule")


@query("agg_raw_rate", sql("SELECT class, round(median(archive_bytes / (wall + score)), 6) AS rate FROM m GROUP BY class", base=M))
def _(spark, d):
    return ops.raw_rate(lines(spark, d).select("class", E("archive_bytes").alias("bytes"), E("wall").alias("read_s"), E("score").alias("open_s"))).select("class", F.round("rate", 6).alias("rate"))


@query("agg_cover", sql("SELECT tool || setting || class AS class, (archive_bytes // 4 + class_bytes - archive_bytes)::BIGINT AS estimate, archive_bytes < class_bytes AS partial FROM r"))
def _(spark, d):
    return ops.cover(combos(spark, d).selectExpr("concat(tool, setting, class) AS class", "archive_bytes DIV 4 AS packed", "class_bytes AS bytes", "archive_bytes AS covered"))


@query("agg_corpus_totals", sql("SELECT count(*) AS classes, sum(class_bytes % 1000)::BIGINT AS files, sum(class_bytes)::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ord, tool, setting) AS n FROM r) WHERE n = 1"))
def _(spark, d):
    return ops.corpus_totals(combos(spark, d).withColumns({"class_files": E("class_bytes") % 1000, "ord": F.struct("ord", "tool", "setting")}))


TREE = """WITH RECURSIVE m AS (SELECT source AS class, row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, doc_id::VARCHAR || chr(0) || n_chars || chr(0) || sha256(text) || chr(0) AS part FROM documents),
t AS (SELECT class, i // 256 AS i, (min(n) + 255) // 256 AS n, sha256(string_agg(part, '' ORDER BY i)) AS part FROM m GROUP BY class, i // 256
  UNION ALL SELECT class, i // 256, (min(n) + 255) // 256, sha256(string_agg(part, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY class, i // 256) SELECT class, part AS digest FROM t WHERE n = 1"""


@query("agg_digest", TREE)
def _(spark, d):
    return ops.class_digest(table(spark, d, "documents").select(E("source").alias("class"), E("doc_id").cast("string").alias("path"), E("n_chars").alias("bytes"), F.sha2("text", 256).alias("hash")))


@query("agg_merkle", "WITH RECURSIVE t AS (SELECT 0 AS level, row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256(text) AS hash, count(*) OVER () AS n FROM documents UNION ALL SELECT level + 1, i // 2, CASE WHEN nxt IS NULL THEN hash ELSE sha256(hash || nxt) END, (n + 1) // 2 FROM (SELECT *, lead(hash) OVER (ORDER BY i) AS nxt FROM t) WHERE i % 2 = 0 AND n > 1) SELECT level, i, hash FROM t")
def _(spark, d):
    """The tree over all documents in order, with odd levels."""
    leaves = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return ops.merkle(numbered(leaves, "doc_id", "hash", column="i").select("i", "hash"))


# ---- lineage and shown values


@query("agg_lineage", "SELECT l_returnflag AS tool, sum(l_orderkey)::BIGINT AS value, list_sort(list(DISTINCT l_linenumber)) AS sources, '[' || CASE WHEN count(DISTINCT l_linenumber) = 7 THEN '1-7' ELSE '?' END || ']' AS shown FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.array("l_linenumber").alias("s"))
    out = rows.groupBy(E("l_returnflag").alias("tool")).agg(F.sum("l_orderkey").alias("value"), ops.sources_of(E("s")).alias("sources"))
    return out.withColumn("shown", ops.bracketed(E("sources")))


@query("agg_distinct_threads", sql("SELECT tool, list_sort(list(DISTINCT threads)) AS threads, count(DISTINCT threads) > 1 AS mixed FROM m GROUP BY tool", base=M))
def _(spark, d):
    return lines(spark, d).groupBy("tool").agg(F.array_sort(F.collect_set("threads")).alias("threads")).withColumn("mixed", F.size("threads") > 1)


@query("fn_pct", sql("SELECT tool, setting, class, printf('%.2f', size_pct) || ' %' AS pct, printf('%.1f', mbps) AS mbps FROM r UNION ALL SELECT 'none', '', '', 'n/a', 'n/a'"))
def _(spark, d):
    rows = combos(spark, d).select("tool", "setting", "class", "size_pct", "mbps").union(spark.createDataFrame([("none", "", "", None, None)], "tool string, setting string, class string, size_pct double, mbps double"))
    return rows.select("tool", "setting", "class", ops.shown_pct(E("size_pct")).alias("pct"), ops.shown_mbps(E("mbps")).alias("mbps"))


@query("fn_within", sql("SELECT tool, setting, class, archive_bytes * 100 >= class_bytes * 99 AS enough FROM r"))
def _(spark, d):
    return combos(spark, d).select("tool", "setting", "class", ops.at_least_pct(E("archive_bytes"), E("class_bytes"), 99).alias("enough"))


SHAPES = ["", "K", "M", "G", "T", " K", "k", "000000000000000000000K", "00000000000G", "x"]


@query("fn_size", f"WITH s(k, unit) AS (VALUES {', '.join(f'({i}, {chr(39)}{u}{chr(39)})' for i, u in enumerate(SHAPES))}), t AS (SELECT doc_id, CASE doc_id % 11 WHEN 10 THEN '' ELSE doc_id || unit END AS text FROM documents JOIN s ON k = doc_id % 10) SELECT doc_id, CASE WHEN regexp_matches(text, '^[0-9]{{1,18}}[KMG]?$') THEN TRY_CAST(regexp_extract(text, '^[0-9]*')::HUGEINT * CASE right(text, 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1 END AS BIGINT) END AS bytes FROM t")
def _(spark, d):
    units = F.array(*[F.lit(u) for u in SHAPES])
    text = F.when(E("doc_id") % 11 == 10, "").otherwise(F.concat(E("doc_id").cast("string"), F.element_at(units, (E("doc_id") % 10 + 1).cast("int"))))
    return table(spark, d, "documents").select("doc_id", ops.parsed_size(text).alias("bytes"))


@query("fn_civil", "SELECT o_orderkey, year(x)::INTEGER AS y, month(x)::INTEGER AS m, day(x)::INTEGER AS d FROM (SELECT o_orderkey, DATE '1970-01-01' + (o_orderkey - 5000)::INTEGER AS x FROM orders)")
def _(spark, d):
    day = F.date_from_unix_date((E("o_orderkey") - 5000).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"))


@query("fn_valid_date", "SELECT o_orderkey, TRY_CAST(text AS DATE) IS NOT NULL AND regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS ok FROM (SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'x' WHEN 1 THEN '2024/01/02' ELSE printf('%04d-%02d-%02d', 1999 + o_orderkey % 9, o_orderkey % 14, o_orderkey % 33) END AS text FROM orders)")
def _(spark, d):
    k = E("o_orderkey")
    text = F.when(k % 13 == 0, "x").when(k % 13 == 1, "2024/01/02").otherwise(F.format_string("%04d-%02d-%02d", 1999 + k % 9, k % 14, k % 33))
    return table(spark, d, "orders").select("o_orderkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull().alias("ok"))


@query("fn_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("fn_array", "SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[1] AS first FROM documents")
def _(spark, d):
    lines_of = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines_of).cast("long").alias("n"), lines_of[0].alias("first"))


@query("fn_map", "SELECT class, weight FROM (VALUES ('m1', 50), ('m2', 30), ('m3', 20)) v(class, weight)")
def _(spark, d):
    return mix(spark).agg(F.map_from_entries(F.collect_list(F.struct("class", "weight"))).alias("m")).select(F.explode("m").alias("class", "weight"))


@query("fn_json", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("fn_json_diff", "SELECT event_id, CASE WHEN (json_extract(props, '$.k'))::BIGINT = 69 THEN [] ELSE ['/k: differs'] END AS diff FROM events")
def _(spark, d):
    from granary.functions.content import json_diff

    return table(spark, d, "events").select("event_id", json_diff(E("props"), F.lit('{"k": 69}')).alias("diff"))


# ---- rules over result rows


@query("dom_unclean", "SELECT ['dirty build', 'mixed threads'] AS reasons")
def _(spark, d):
    return ops.unclean(lines(spark, d).select(F.lit(2.5).alias("settle_s"), E("flagged").alias("dirty"), "threads"))


@query("dom_semantic", sql("SELECT ord, unnest(list_filter([CASE WHEN ord % 7 = 0 THEN 'file name differs from content' END, CASE WHEN tool = 'N' THEN 'tool is not listed' END, CASE WHEN threads <> 3 AND ord % 5 = 0 THEN 'repeats differ from those asked for' END, CASE WHEN flagged THEN 'median beside a flagged repeat' END], lambda x: x IS NOT NULL)) AS rule FROM m", base=M))
def _(spark, d):
    rows = lines(spark, d).selectExpr(
        "ord", "IF(ord % 7 = 0, 'x', concat_ws('--', tool, setting, class)) AS file", "tool", "setting", "class", "tool <> 'N' AS known_tool", "IF(ord % 5 = 0, threads, 3) AS repeats",
        "3 AS wanted", "flagged", "true AS has_median", "true AS verified",
    )
    return ops.semantic_faults(rows)


REPORT = """SELECT '# Report' || chr(10) || chr(10) || '## Best by class' || chr(10) || chr(10) || '| class | tool | setting | archive_bytes |' || chr(10) || '|---|---|---|---|' || chr(10)
 || (SELECT string_agg('| ' || class || ' | ' || tool || ' | ' || setting || ' | ' || archive_bytes || ' |', chr(10) ORDER BY class) FROM ({best}))
 || chr(10) || chr(10) || '## Best on every class' || chr(10) || chr(10) || (SELECT tool || '/' || setting || ': ' || total FROM (SELECT tool, setting, sum(archive_bytes) AS total, min(ord) AS ord FROM r GROUP BY tool, setting HAVING count(DISTINCT class) = (SELECT count(DISTINCT class) FROM r) ORDER BY total, ord LIMIT 1))
 || chr(10) || chr(10) || '## Decision' || chr(10) || chr(10) || 'NO-GO: failing gates: G2; open gates: G3' || chr(10) AS report"""


@query("snk_report", sql(REPORT.replace("{best}", BEST.format(where=""))))
def _(spark, d):
    """The text follows from the rows alone: best of each class, best on all of them, and what the gates say."""
    from granary.sources.sinks import report

    rows = combos(spark, d)
    single = ops.best_single(rows, rows.select("class")).select(F.concat("tool", F.lit("/"), "setting", F.lit(": "), E("total").cast("string")))
    parts = [("Best by class", ops.best(rows).orderBy("class").select("class", "tool", "setting", "archive_bytes")), ("Best on every class", single), ("Decision", ops.verdict(gates(spark)))]
    return spark.createDataFrame([(report("Report", parts),)], "report string")
