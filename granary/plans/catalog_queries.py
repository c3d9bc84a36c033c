"""Queries over the catalogue of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import paths
from granary.operators import catalog as ops
from granary.plans.registry import ANCESTORS, ENTRIES, NAME, entries, query, table
from granary.store import numbered

E = F.col



def every(df, step):
    return df.where(F.col("id") % step == 0).select("id").union(df.sparkSession.range(10**12, 10**12 + 1))


def with_entries(select: str, more: str = "") -> str:
    return f"WITH {ENTRIES}{more} {select}"


# ---- scans and sinks


@query("src_entry_table", with_entries("SELECT * FROM entries"))
def _(spark, d):
    return entries(spark, d)


@query("src_walk", "SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 3 <> 0 OR lang <> 'en'")
def _(spark, d):
    """The documents are written as files, and their folder is walked, without what a pattern excludes."""
    from granary.sources.sinks import write_files
    from granary.sources.walk import walk
    from granary.store import fresh_path

    folder, name = fresh_path(spark, "tree"), F.when((E("doc_id") % 3 == 0) & (E("lang") == "en"), ".tmp").otherwise(".txt")
    docs = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), E("doc_id").cast("string"), name).alias("path"), "text")
    write_files(docs.withColumnRenamed("text", "content"), folder)
    return walk(spark, folder, exclude=("**/*.tmp",)).select("path", "size")


@query("src_walk_multi", "WITH r AS (SELECT 'left' AS root, lang || '/' || doc_id AS path FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT 'right', lang || '/' || doc_id FROM documents WHERE lang = 'de') SELECT root, root || '/' || path AS path FROM r")
def _(spark, d):
    from granary.sources.walk import union_roots

    docs = table(spark, d, "documents").select("lang", F.concat_ws("/", "lang", "doc_id").alias("path"))
    return union_roots({"left": docs.where("lang in ('en', 'fr')").select("path"), "right": docs.where("lang = 'de'").select("path")}).select("root", "path")


@query("src_list_file", with_entries("SELECT id, path FROM entries WHERE kind = 'File' AND id % 5 = 0"))
def _(spark, d):
    from granary.sources.walk import listed

    found = entries(spark, d)
    lines = found.where("kind = 'File' and id % 5 = 0").select(F.concat("path", F.lit(" ")).alias("value"))
    lines = lines.union(spark.createDataFrame([("# a comment",), ("",), ("   ",), ("no/such/file",)], "value string"))
    return listed(found, lines).select("id", "path")


@query("src_for_each", with_entries("SELECT id, path FROM entries ORDER BY id LIMIT 50"))
def _(spark, d):
    return entries(spark, d).orderBy("id").limit(50).select("id", "path")


@query("src_point", with_entries("SELECT * FROM entries WHERE path = 'en/src1'"))
def _(spark, d):
    return entries(spark, d).where("path = 'en/src1'")


@query("src_calibrate", with_entries("SELECT path, size, least(size, 100000 - before)::BIGINT AS take FROM r WHERE before < 100000", ", r AS (SELECT path, size, coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries WHERE kind = 'File')"))
def _(spark, d):
    return ops.capped(entries(spark, d), 100_000)


SHOWN_TIME = "CASE WHEN mtime_ns IS NULL THEN NULL ELSE strftime(make_timestamp(((mtime_ns - ((mtime_ns % 1000000000) + 1000000000) % 1000000000) // 1000)), '%Y-%m-%dT%H:%M:%SZ') END"


@query("snk_text", with_entries(f"SELECT kind || chr(9) || size || chr(9) || coalesce({SHOWN_TIME}, '-') || chr(9) || path AS line FROM entries"))
def _(spark, d):
    from granary.sources.sinks import text_lines

    return text_lines(entries(spark, d))


@query("snk_json", with_entries("SELECT '{\"path\":\"' || path || '\",\"kind\":\"' || kind || '\",\"size\":' || size || ',\"mtime_ns\":' || coalesce(mtime_ns::VARCHAR, 'null') || ',\"flags\":' || flags || '}' AS line FROM entries"))
def _(spark, d):
    from granary.sources.sinks import json_lines

    return json_lines(entries(spark, d))


@query("snk_md", with_entries("SELECT string_agg(line, chr(10) ORDER BY o) AS markdown FROM (SELECT 0 AS o, '| kind | n |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY kind), '| ' || kind || ' | ' || n || ' |' FROM (SELECT kind, count(*) AS n FROM entries GROUP BY kind))"))
def _(spark, d):
    from granary.sources.sinks import markdown

    small = entries(spark, d).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")
    return spark.createDataFrame([(markdown(small),)], "markdown string")


# ---- projections


@query("prj_name", with_entries(f"SELECT id, {NAME} AS name FROM entries"))
def _(spark, d):
    return entries(spark, d).select("id", paths.name(E("path")).alias("name"))


@query("prj_ext", with_entries(f"SELECT id, CASE WHEN strpos(substr({NAME}, 2), '.') > 0 THEN lower(split_part({NAME}, '.', -1)) ELSE '' END AS ext FROM entries"))
def _(spark, d):
    return entries(spark, d).select("id", paths.extension(E("path")).alias("ext"))


@query("prj_rel", with_entries("SELECT e.id, r.root, substr(e.path, length(r.root) + 2) AS rel FROM entries e LEFT JOIN (VALUES ('de'), ('en/src1'), ('fr/src2')) r(root) ON starts_with(e.path, r.root || '/')"))
def _(spark, d):
    from granary.operators.versions import split_root

    return split_root(entries(spark, d), spark.createDataFrame([("de",), ("en/src1",), ("fr/src2",)], "root string")).select("id", "root", "rel")


@query("prj_mtime", with_entries(f"SELECT id, {SHOWN_TIME} AS mtime FROM entries"))
def _(spark, d):
    return entries(spark, d).select("id", paths.iso_time(E("mtime_ns")).alias("mtime"))


@query("prj_flags", with_entries("SELECT id, CASE WHEN flags & 1 > 0 THEN 'x' ELSE '-' END || CASE WHEN flags & 2 > 0 THEN 'h' ELSE '-' END || CASE WHEN flags & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN flags & 8 > 0 THEN 's' ELSE '-' END AS letters, list_filter([CASE WHEN flags & 1 > 0 THEN 'executable' END, CASE WHEN flags & 2 > 0 THEN 'hidden' END, CASE WHEN flags & 4 > 0 THEN 'read_only' END, CASE WHEN flags & 8 > 0 THEN 'system' END], lambda x: x IS NOT NULL) AS names FROM entries"))
def _(spark, d):
    return entries(spark, d).select("id", paths.flag_letters(E("flags")).alias("letters"), paths.flag_names(E("flags")).alias("names"))


@query("prj_escape", r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS escaped FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.escaped(E("text")).alias("escaped"))


# ---- filters


@query("flt_contains", with_entries("SELECT id, path FROM entries WHERE regexp_matches(path, '(?i)src1.*txt') AND strpos(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.txt') > 0"))
def _(spark, d):
    return entries(spark, d).where(paths.contains_ascii(E("path"), ".TXT") & paths.contains_ascii(E("path"), "SRC1") & E("path").rlike("(?i)src1.*txt")).select("id", "path")


@query("flt_glob", with_entries(r"SELECT id FROM entries WHERE regexp_matches(path, '^e[a-n]/src[1-3]/([^/]*\.txt|v[^/]+\.md)$')"))
def _(spark, d):
    return entries(spark, d).where(ops.glob(E("path"), "e[a-n]\\src[1-3]/{*.txt,v?*.md}")).select("id")


@query("flt_glob_subtree", with_entries("SELECT id FROM entries WHERE regexp_matches(path, '^(de|fr/src1)(/|$)') OR regexp_matches(path, '\\.TXT$')"))
def _(spark, d):
    return entries(spark, d).where(ops.glob_subtree(E("path"), ["de", "fr/src1", "**/*.TXT"])).select("id")


@query("flt_nomatch", with_entries("SELECT 0 AS ord, 'en' AS pattern, bool_or(path = 'en') AS matched FROM entries UNION ALL SELECT 1, 'xx/**', bool_or(regexp_matches(path, '^xx/.+')) FROM entries UNION ALL SELECT 2, '*/src1', bool_or(regexp_matches(path, '^[^/]*/src1$')) FROM entries"))
def _(spark, d):
    return ops.pattern_matches(entries(spark, d), ["en", "xx/**", "*/src1"])


@query("flt_ids", with_entries("SELECT id, path FROM entries WHERE id % 7 = 0"))
def _(spark, d):
    found = entries(spark, d)
    return ops.by_ids(found, every(found, 7)).select("id", "path")


CLOSED = ", picked AS (SELECT * FROM entries WHERE id % 7 = 0), closed AS (SELECT * FROM entries e WHERE id % 7 = 0 OR EXISTS (SELECT 1 FROM picked p WHERE p.kind = 'Directory' AND starts_with(e.path, p.path || '/')))"


@query("flt_ids_closed", with_entries("SELECT id FROM closed", CLOSED))
def _(spark, d):
    found = entries(spark, d)
    return ops.by_ids_closed(found, every(found, 7)).select("id")


@query("flt_picks_in_view", with_entries("SELECT count(*) FILTER (WHERE starts_with(path, 'en/')) AS shown, count(*) FILTER (WHERE NOT starts_with(path, 'en/')) AS hidden FROM entries WHERE id % 7 = 0"))
def _(spark, d):
    found = entries(spark, d)
    return ops.picks_in_view(found, every(found, 7), E("path").startswith("en/"))


@query("flt_pick_range", with_entries("SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY size DESC, id) - 1 AS pos FROM entries) WHERE pos BETWEEN 10 AND 30"))
def _(spark, d):
    return ops.picked_range(ops.view(entries(spark, d), "size", True), 30, 10).select("id", "pos")


@query("flt_stale", "SELECT event_id, user_id % 4 < 3 AS stale FROM events")
def _(spark, d):
    """Requests against views of several generations, of which the third is current."""
    from granary.operators.versions import is_stale

    return table(spark, d, "events").select("event_id", is_stale(E("user_id") % 4, F.lit(3)).alias("stale"))


@query("flt_exclude", with_entries(r"SELECT id FROM entries WHERE NOT regexp_matches(path, '^(es|en/src[0-4])(/|$)') AND NOT regexp_matches(path, '\.md$')"))
def _(spark, d):
    return ops.exclude(entries(spark, d), ["es", "en/src[0-4]", "**/*.md"]).select("id")


@query("flt_scope", with_entries("SELECT id, path FROM entries WHERE regexp_matches(path, '^en/[^/]+$')"))
def _(spark, d):
    found = entries(spark, d)
    folder = found.where("path = 'en'").first()["id"]
    return ops.children(found, folder).select("id", "path")


@query("flt_fingerprint", with_entries("SELECT count(*) AS n, sum(('0x' || substr(md5(id || ':' || path || ':' || size), 1, 8))::BIGINT)::BIGINT AS digest FROM entries"))
def _(spark, d):
    return ops.fingerprint(entries(spark, d))


FAULTY = "SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '/abs' WHEN 2 THEN 'a' || chr(92) || 'b' WHEN 3 THEN 'a//b' WHEN 4 THEN 'a/../b' WHEN 5 THEN 'x/CON.txt' WHEN 6 THEN 'dir./x' WHEN 7 THEN 'a:b' ELSE 'ok/' || doc_id END AS path FROM {docs}"
#: Paths, safe and unsafe; {} is the id.
RISKY = [
    "ok/{}", "/abs/{}", "a/b\\{}", "a/../{}", "./{}", "x/con", "x/NUL .txt", "Aux.{}", "x/COM7", "com¹.x", "lpt³", "COM0", "conin$", "CONOUT$.log", "CONSOLE", "dir./{}", "sp /{}", "{}.", "c:/{}", "a/{}:s",
    "what?{}", "a<b>|*{}", "con/..", "../con", "aux:", "n" * 255 + "/{}", "n" * 256, "é" * 255, "😀" * 128, "nn/" * 11000 + "{}", " lead/{}", "LPT", "x/prn  .tar.gz/{}",
]
RISKS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(RISKY))
RISKY_SQL = f"WITH t(k, shape) AS (VALUES {RISKS}), p AS (SELECT doc_id AS id, replace(shape, '{{}}', doc_id::VARCHAR) AS path FROM documents JOIN t ON k = doc_id % {len(RISKY)})"
#: A unit more for each character that takes four bytes in UTF-8.
UNITS = "(length({0}) + len(regexp_extract_all({0}, '[\U00010000-\U0010FFFF]')))"
DEVICE = r"regexp_matches(upper({}), '^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|COM[1-9¹²³]|LPT[1-9¹²³]) *(\.|$)')"
PART = f"CASE WHEN x IN ('.', '..') THEN 'dot component' WHEN strpos(x, ':') > 0 THEN 'colon' WHEN regexp_matches(x, '[. ]$') THEN 'trailing dot or space' WHEN {DEVICE.format('x')} THEN 'reserved device name' END"
#: Links over ``documents``: where the link stands and where it points.
LINKS = [
    ("l", "plain"), ("d/l", "../up{}"), ("d/l", ".."), ("l", "."), ("l", "below/"), ("a/b/l", "../../c/./{}/"), ("a/b/l", "./../s"), ("l", "../out"), ("a/l", "../../out"), ("l", "in/../{}"), ("a/b/l", "../x/.."),
    ("l", "//host/share"), ("l", "\\\\host\\share"), ("l", "\\/host"), ("l", "C:\\dir"), ("l", "d:/dir"), ("l", "E:file"), ("l", "/etc/{}"), ("l", "\\dir"), ("l", "//?/C:/x"), ("l", "\\\\.\\pipe"), ("l", "\\??\\C:"),
    ("l", "x/file:stream"), ("l", "x./y"), ("l", "end "), ("l", "..."), ("l", "s/CON"), ("l", "nul.txt"), ("l", ""), ("l", "back\\slash"), ("d/e/l", "..\\x"), ("l", "a//b"), ("a/b/l", "../../.."),
]
LINK_ROWS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(LINKS))
LINK_SQL = rf"""WITH t(k, link, shape) AS (VALUES {LINK_ROWS}), p AS (SELECT doc_id AS id, link, replace(shape, '{{}}', doc_id::VARCHAR) AS target FROM documents JOIN t ON k = doc_id % {len(LINKS)}),
q AS (SELECT *, list_filter(string_split(target, '/'), lambda x: x NOT IN ('', '.')) AS parts, string_split(link, '/') AS own FROM p),
r AS (SELECT *, length(regexp_extract(array_to_string(parts, '/') || '/', '^((\.\./)*)', 1)) // 3 AS ups FROM q),
s AS (SELECT *, parts[ups + 1:] AS names FROM r),
w AS (SELECT id, link, target, own, ups, names, CASE WHEN target = '' THEN 'empty' WHEN regexp_matches(target, '^[/\\]([/\\][?.]|\?\?)[/\\]') THEN 'device path' WHEN regexp_matches(target, '^[/\\][/\\]') THEN 'network path'
  WHEN regexp_matches(target, '^[/\\]') THEN 'rooted' WHEN regexp_matches(target, '^[A-Za-z]:[/\\]') THEN 'absolute' WHEN regexp_matches(target, '^[A-Za-z]:') THEN 'drive-relative' WHEN strpos(target, '\') > 0 THEN 'backslash'
  ELSE coalesce(list_filter(list_transform(names, lambda x: CASE WHEN x = '..' THEN 'climbs after a name' WHEN strpos(x, ':') > 0 THEN 'colon' WHEN regexp_matches(x, '[. ]$') THEN 'trailing dot or space' WHEN {DEVICE.format('x')} THEN 'reserved device name' END), lambda x: x IS NOT NULL)[1],
    CASE WHEN ups > len(own) - 1 THEN 'leaves the tree' END) END AS fault FROM s)
SELECT id, fault, CASE WHEN fault IS NULL THEN array_to_string(list_concat(own[1:len(own) - 1 - ups], names), '/') END AS resolved FROM w"""


@query("flt_path_valid", f"WITH p AS ({FAULTY.format(docs='documents')}) " + r"SELECT id, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN strpos(path, '\') > 0 THEN 'backslash' WHEN regexp_matches(path, '(^|/)(/|$)') THEN 'empty component' WHEN regexp_matches(path, '(^|/)\.\.?(/|$)') THEN 'dot component' END AS fault FROM p")
def _(spark, d):
    return spark.sql(FAULTY, docs=table(spark, d, "documents")).select("id", paths.path_fault(E("path")).alias("fault"))


def shaped(spark, d, rows, columns):
    """(id, columns…): a row of shapes per document, with its id put in."""
    made = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "k int, " + ", ".join(f"{c} string" for c in columns))
    docs = table(spark, d, "documents").select(E("doc_id").alias("id"), (E("doc_id") % len(rows)).cast("int").alias("k")).join(F.broadcast(made), "k")
    return docs.select("id", *[F.replace(c, F.lit("{}"), E("id").cast("string")).alias(c) for c in columns])


@query("flt_unsafe", RISKY_SQL + rf""" SELECT id, CASE WHEN starts_with(path, '/') THEN 'leading slash' WHEN strpos(path, '\') > 0 THEN 'backslash' ELSE coalesce(list_filter(list_transform(string_split(path, '/'), lambda x: {PART}), lambda x: x IS NOT NULL)[1],
 CASE WHEN list_max(list_transform(string_split(path, '/'), lambda x: {UNITS.format('x')})) > 255 THEN 'name too long' WHEN {UNITS.format('path')} + 1 > 32767 THEN 'path too long' END) END AS fault FROM p""")
def _(spark, d):
    return shaped(spark, d, RISKY, ["path"]).select("id", paths.unsafe(E("path")).alias("fault"))


@query("flt_link_target", LINK_SQL)
def _(spark, d):
    to, why = paths.link_target(E("link"), E("target"))
    return shaped(spark, d, LINKS, ["link", "target"]).select("id", why.alias("fault"), to.alias("resolved"))


@query("flt_information", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def _(spark, d):
    from granary.operators.measures import without_information

    rows = table(spark, d, "events").withColumn("information", F.when(E("event_type") == "error", "excluded"))
    return without_information(rows).groupBy("event_type").agg(F.count("*").alias("n"))


# ---- joins on paths


@query("j_parent", with_entries(f"SELECT e.id, coalesce((SELECT max(p.id) FROM entries p WHERE p.kind = 'Directory' AND p.path = regexp_extract(e.path, '^(.*)/[^/]*$', 1)), -1) AS parent FROM entries e"))
def _(spark, d):
    return ops.parents(entries(spark, d))


@query("j_crumbs", with_entries(f"SELECT x.id, x.level, p.id AS folder FROM (SELECT id, unnest({ANCESTORS}) AS above, unnest(range(0, len(string_split(path, '/')) - 1))::INTEGER AS level FROM entries) x JOIN entries p ON p.path = x.above AND p.kind = 'Directory'"))
def _(spark, d):
    return ops.crumbs(entries(spark, d))


@query("j_conflict", with_entries("SELECT e.path FROM extra e WHERE EXISTS (SELECT 1 FROM extra p WHERE p.kind <> 'Directory' AND starts_with(e.path, p.path || '/'))", ", extra AS (SELECT path, kind FROM entries UNION ALL SELECT path || '/below', 'File' FROM entries WHERE kind = 'File' AND id % 50 = 0)"))
def _(spark, d):
    found = entries(spark, d).select("path", "kind")
    more = entries(spark, d).where("kind = 'File' and id % 50 = 0").select(F.concat("path", F.lit("/below")), F.lit("File"))
    both = found.union(more).withColumn("id", E("path"))
    return ops.conflicts(both).select("path")


@query("j_case", with_entries("SELECT lower(path) AS folded, count(*) AS n, min(path) AS first_path FROM (SELECT path FROM entries UNION ALL SELECT upper(path) FROM entries WHERE id % 40 = 0) GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    found = entries(spark, d)
    return ops.case_clashes(found.select("path").union(found.where("id % 40 = 0").select(F.upper("path"))))


@query("j_overlap", "WITH b AS (SELECT l_suppkey AS grp, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop FROM lineitem), o AS (SELECT *, max(stop) OVER (PARTITION BY grp ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b) SELECT grp, start, stop, reach FROM o WHERE start < reach")
def _(spark, d):
    blocks = table(spark, d, "lineitem").select(E("l_suppkey").alias("grp"), E("l_partkey").alias("start"), (E("l_partkey") + E("l_quantity").cast("long")).alias("stop"))
    return ops.overlaps(blocks)


# ---- totals

TOTALS = "count(*) AS entries, count(*) FILTER (WHERE kind = 'File') AS files, count(*) FILTER (WHERE kind = 'Directory') AS dirs, coalesce(sum(size) FILTER (WHERE kind = 'File'), 0)::DECIMAL(38,0) AS bytes"


@query("agg_totals", with_entries(f"SELECT {TOTALS}, count(*) FILTER (WHERE id % 7 = 0) AS picked, coalesce(sum(size) FILTER (WHERE kind = 'File' AND id % 7 = 0), 0)::DECIMAL(38,0) AS picked_bytes FROM entries"))
def _(spark, d):
    found = entries(spark, d)
    return ops.totals(found, every(found, 7))


@query("agg_picked_closed", with_entries("SELECT count(*) AS files, coalesce(sum(size), 0)::DECIMAL(38,0) AS bytes FROM closed WHERE kind = 'File'", CLOSED))
def _(spark, d):
    found = entries(spark, d)
    return ops.picked_closed_bytes(found, every(found, 7))


@query("agg_preflight", with_entries("SELECT count(*) AS entries, count(*) FILTER (WHERE kind = 'File') AS files, coalesce(sum(size) FILTER (WHERE kind = 'File'), 0)::DECIMAL(38,0) AS bytes, count(*) FILTER (WHERE id % 3 = 0) AS existing FROM entries WHERE regexp_matches(path, '^(de|en/src1)(/|$)')"))
def _(spark, d):
    found = entries(spark, d)
    return ops.preflight(found, ["de", "en/src1"], found.where("id % 3 = 0").select("path"))


@query("agg_measure", with_entries("SELECT count(*) AS files, coalesce(sum(size), 0)::DECIMAL(38,0) AS bytes FROM entries WHERE kind = 'File'"))
def _(spark, d):
    return ops.totals(entries(spark, d)).select("files", "bytes")


@query("agg_inventory", with_entries("SELECT count(*) AS entries, sum(octet_length(encode(path)))::BIGINT AS path_bytes, coalesce(sum(size) FILTER (WHERE kind = 'File'), 0)::DECIMAL(38,0) AS input_bytes FROM entries"))
def _(spark, d):
    return ops.inventory(entries(spark, d))


@query("agg_children", with_entries("SELECT d.id AS parent, (SELECT count(*) FROM entries e WHERE regexp_extract(e.path, '^(.*)/[^/]*$', 1) = d.path) AS children FROM entries d WHERE kind = 'Directory' UNION ALL SELECT -1, count(*) FROM entries WHERE strpos(path, '/') = 0"))
def _(spark, d):
    return ops.child_counts(entries(spark, d))


@query("agg_rate", with_entries("SELECT sum(size)::BIGINT AS bytes, round(sum(size) / sum(id % 5 * 0.5::DOUBLE), 3) AS rate FROM entries WHERE kind = 'File'"))
def _(spark, d):
    return ops.rate(entries(spark, d).where("kind = 'File'"), E("id") % 5 * F.lit(0.5))


# ---- orders


def ranked(order: str) -> str:
    return with_entries(f"SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM entries")


@query("srt_view", ranked("size DESC, id"))
def _(spark, d):
    return ops.view(entries(spark, d), "size", True).select("id", "pos")


@query("srt_path_is_id", ranked("id DESC"))
def _(spark, d):
    return numbered(entries(spark, d), E("id").desc(), column="pos").select("id", "pos")


@query("srt_kind", ranked(f"CASE kind WHEN 'Directory' THEN 0 WHEN 'File' THEN 1 ELSE 2 END DESC, {NAME} DESC, id"))
def _(spark, d):
    return ops.view(entries(spark, d), "kind", True).select("id", "pos")


#: Names whose numbers differ in length, in zeros before them, and beyond any machine's word; {} is the id.
NUMBERED = ["v{}", "v0{}", "v{}.10", "v{}.9", "part{}of{}", "{}", "v", "x{}{}{}{}{}{}{}{}{}{}", "x9999999999999999999999999{}", "v.{}", "é{}", "a b{}c"]
NUMBERED_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NUMBERED))


@query("srt_natural", f"WITH t(k, shape) AS (VALUES {NUMBERED_ROWS}), n AS (SELECT doc_id AS id, replace(shape, '{{}}', doc_id::VARCHAR) AS name FROM documents JOIN t ON k = doc_id % {len(NUMBERED)}), l AS (SELECT id, name, list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN '0' || lpad(length(ltrim(p, '0'))::VARCHAR, 10, '0') || ltrim(p, '0') ELSE p END) AS parts FROM n) SELECT id, row_number() OVER (ORDER BY parts, name, id) - 1 AS pos FROM l")
def _(spark, d):
    found = shaped(spark, d, NUMBERED, ["name"])
    return numbered(found, paths.natural_key(E("name")), E("name"), E("id"), column="pos").select("id", "pos")


@query("srt_ext", ranked(f"CASE WHEN strpos(substr({NAME}, 2), '.') > 0 THEN lower(split_part({NAME}, '.', -1)) ELSE '' END, lower({NAME}), path"))
def _(spark, d):
    return numbered(entries(spark, d), paths.extension(E("path")), F.lower(paths.name(E("path"))), E("path"), column="pos").select("id", "pos")


@query("lim_page", with_entries("SELECT id, path, size FROM entries ORDER BY size DESC, id LIMIT 20 OFFSET 40"))
def _(spark, d):
    return ops.page(entries(spark, d), "size", True, 40, 20).select("id", "path", "size")


@query("lim_first_n", with_entries("SELECT path, size FROM entries WHERE size = 0 ORDER BY path LIMIT 20"))
def _(spark, d):
    return entries(spark, d).where("size = 0").orderBy("path").limit(20).select("path", "size")


@query("win_adjacent_dup", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, d):
    return ops.adjacent_duplicates(table(spark, d, "documents"), "text")


@query("win_prefix", "SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents")
def _(spark, d):
    from granary.store import running

    return running(table(spark, d, "documents"), "n_chars", "doc_id").select("doc_id", "before")


@query("fn_rename", with_entries("SELECT path, CASE WHEN id % 2 = 0 THEN regexp_replace(path, '(\\.[^./]*)?$', ' (' || CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END || ')\\1') ELSE path END AS free FROM entries WHERE kind = 'File' AND id % 10 < 6 AND path LIKE '%.txt'"))
def _(spark, d):
    found = entries(spark, d).where("kind = 'File' and id % 10 < 6 and path like '%.txt'")
    taken = found.where("id % 2 = 0").select("path").union(found.where("id % 6 = 0").select(F.regexp_replace("path", r"\.txt$", " (1).txt")))
    return ops.free_name(found.select("path"), taken)
