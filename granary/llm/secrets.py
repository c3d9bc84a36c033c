"""Secret scan by corpus-wide ownership frequency; built-in functions only.

Candidates are found with patterns, hashed, and counted by the distinct repositories and owners that hold
them.  A value that many owners hold is a copied example; one that few hold looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import stored
from granary.llm.components import SHARE

#: The base kinds in order: name, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: What the method adds: long runs that hold a digit, a capital and a small letter.
LOOSE = ("live", r"[A-Za-z0-9+/_-]{20,}")

#: Least length of each kind's group, the added one last.
LEAST = [*[n for *_, n in BASE], 20]

HIT = "array<struct<rank:int,i:int,step:long,bytes:long,length:long,value:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,value:string,value_at:long,bytes_end:long,at:long>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, rank: int, pattern: str, group: int) -> Column:
    """The leftmost non-overlapping matches: number, characters and bytes from the end of the one before to its own
    end, its length, and its group.  Running sums over these tell where each stands (:func:`placed`)."""

    def located(x: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            # What lies between the matches and the matches themselves give every start; a match is ASCII.
            return F.struct(
                F.lit(rank).alias("rank"),
                i.alias("i"),
                (F.length(F.get(x["gaps"], i)) + F.length(h)).cast("long").alias("step"),
                (F.octet_length(F.get(x["gaps"], i)) + F.length(h)).cast("long").alias("bytes"),
                F.length(h).cast("long").alias("length"),
                F.regexp_extract(h, pattern, group).alias("value"),
            )

        return F.transform(x["hits"], one)

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    return F.when(text.rlike(pattern), let(found, located)).otherwise(F.array().cast(HIT))


def none_if_null(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(SPAN))


def printed(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: rid, id, owner, repo, matches of every kind as they follow each other, and whether any.

    ``rid`` tells repeated rows apart; it is stable because the table is stored.
    """
    clean = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repo_cols)])).alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    patterns = [(p, g) for _, p, g, _ in BASE] + [(LOOSE[1], 0)]
    hits = F.concat(*[matches(F.col("text"), r, p, g) for r, (p, g) in enumerate(patterns)])
    found = clean.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", hits.alias("hits"), *[f"kept_{c}" for c in keep])
    return found.withColumn("any", F.size("hits") > 0)


def placed(table: DataFrame) -> DataFrame:
    """The spans of :func:`scan`'s rows that count, a row each: rid, owner, repo, rank, start, end, value, and in bytes
    value_at and bytes_end.

    One sort per document and kind places the matches, one per document drops loose ones that touch a base span:
    of the base spans that start before a loose one ends, none may end after it starts.  Both are linear in the
    document's matches after the sorts, and need one shuffle, of the matches alone.
    """
    each = table.where("any").select("rid", "owner", "repo", F.inline("hits")).repartition("rid")
    so_far = W.partitionBy("rid", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ended = each.withColumns({"end": F.sum("step").over(so_far), "bytes_end": F.sum("bytes").over(so_far)})
    is_base, value = F.col("rank") < len(BASE), F.col("value")
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    enough = F.length("value") >= F.element_at(F.array(*[F.lit(n) for n in LEAST]), F.col("rank") + 1)
    long = ended.where(enough & (is_base | mixed)).withColumns(
        {"start": F.col("end") - F.col("length"), "value_at": F.col("bytes_end") - F.length("value"), "line": F.when(is_base, F.col("end") - F.col("length")).otherwise(F.col("end"))}
    )
    # A base span that starts where a loose one ends comes after it on this line.
    before = W.partitionBy("rid").orderBy("line", is_base).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(is_base, F.col("end"))).over(before)
    apart = long.withColumn("reach", reach).where(is_base | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    return apart.select("rid", "owner", "repo", "rank", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value", "value_at", "bytes_end")


def ownership(spans: DataFrame) -> DataFrame:
    """Of each value's hash the number of distinct owners and repositories.

    Rows are first made distinct by (hash, owner, repo), which each task does before the shuffle, so a value
    that fills a third of the corpus reaches the reducers as a few rows.
    """
    each = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    # A null owner is an owner of its own.
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_col: str = "source",
    max_owners: int = 2,
    max_repos: int = 4,
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All secret spans of each document, and how widely their values are held.

    Returns a row per input row: doc_id, base (spans), added (spans of the method: mixed long runs that at
    most ``max_owners`` owners and ``max_repos`` repositories hold), n_live and n_example (base spans whose
    value is held narrowly or widely).  A null text counts as empty; a null owner or repository counts as one
    of its own; repeated rows each get their row; an empty table gives no rows; other columns are ignored unless
    named in ``keep``, which carries them as ``kept_<name>``.  A text may hold any number of spans: the work is
    linear in them but for sorting.  A span also tells, in bytes, where its value begins (value_at), where it
    ends (bytes_end), and where the spans before it have ended (at).
    """
    table = stored(scan(docs, text_col, repo_cols, owner_col, id_col, keep), "secret-scan")
    spans = stored(placed(table).withColumn("hash", F.sha2("value", 256)), "secret-spans", SHARE)
    # Stored, so that both sides of the join come fresh from a shuffle and a hot value can be split.
    held = stored(ownership(spans), "secret-owners", SHARE)
    is_base, live = F.col("rank") < len(BASE), (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = spans.join(held, "hash").withColumn("live", live).where(is_base | live).drop("hash", "owner", "repo")
    earlier = W.partitionBy("rid").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)
    judged = judged.withColumn("at", F.coalesce(F.max("bytes_end").over(earlier), F.lit(0)))
    span = F.struct("start", "rank", "end", "value", "value_at", "bytes_end", "at")
    per_doc = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~is_base, span))).alias("added"),
        F.count_if(is_base & F.col("live")).alias("n_live"),
        F.count_if(is_base & ~F.col("live")).alias("n_example"),
    )
    kept = [f"kept_{c}" for c in keep]
    # Only rows with matches, and none of the others' texts, are shuffled to meet their spans.
    some = table.where("any").select("rid", "doc_id", *kept).join(per_doc, "rid", "left")
    none = table.where("not any").select("rid", "doc_id", *kept, *[F.lit(None).cast(SPAN).alias(c) for c in ("base", "added")], *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return some.unionByName(none).select("doc_id", none_if_null(F.col("base")).alias("base"), none_if_null(F.col("added")).alias("added"), zero("n_live"), zero("n_example"), *kept)


def digest(found: DataFrame) -> DataFrame:
    """The report columns of :func:`find_secrets`' rows."""
    names = [k for k, *_ in BASE]
    of = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id",
        *[of(r).alias(f"n_{n}") for r, n in enumerate(names)],
        F.sha2(printed(F.col("base"), names), 256).alias("base_sha256"),
        printed(F.array_sort(F.concat("base", "added")), [*names, LOOSE[0]]).alias("spans"),
        "n_live",
        "n_example",
    )


def hidden(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the value of each span, given in order, replaced by ``mark``; a value under an earlier span goes
    with that.  The text is cut as bytes, where a place is found at once."""

    def cut(raw: Column) -> Column:
        piece = lambda s: F.when(s["value_at"] >= s["at"], F.concat(F.substring(raw, s["at"].cast("int") + 1, (s["value_at"] - s["at"]).cast("int")).cast("string"), F.lit(mark))).otherwise("")
        end = F.array_max(F.transform(spans, lambda s: s["bytes_end"])).cast("int")
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(raw, end + 1, F.octet_length(raw)).cast("string"))

    return let(F.encode(text, "utf-8"), cut)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """All documents with the values of their base and added secrets replaced; the columns stay as they were.

    A null text stays null, and texts without secrets, empty ones among them, stay as they are, whatever their
    length; values that many owners hold are hidden where a base pattern names them; repeated rows all stay;
    an empty table gives no rows; columns of any name are carried along.
    """
    columns = docs.columns
    found = find_secrets(docs, text_col, keep=tuple(columns), **how)
    spans = F.array_sort(F.concat("base", "added"))
    kept = lambda c: F.col(f"kept_{c}")
    new = F.when(F.size(spans) > 0, let(spans, lambda s: hidden(kept(text_col), s, mark))).otherwise(kept(text_col))
    return found.select(*[(new if c == text_col else kept(c)).alias(c) for c in columns])


#: The report in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(source, '<null>') || '|' || coalesce(lang, '<null>') AS repo,
                  coalesce(text, '') AS text FROM documents),
k(rank, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]{14,}', 0, 18),
  (2, 'hex', '[0-9a-f]{16,}', 0, 16),
  (3, 'live', '[A-Za-z0-9+/_-]{20,}', 0, 20)),
m0 AS (
  SELECT rid, owner, repo, 0 AS rank, 'assign' AS kind, 12 AS least, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
         string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
  UNION ALL SELECT rid, owner, repo, 1, 'access', 18, regexp_extract_all(text, 'AKIA[A-Z0-9]{14,}'), string_split_regex(text, 'AKIA[A-Z0-9]{14,}') FROM d
  UNION ALL SELECT rid, owner, repo, 2, 'hex', 16, regexp_extract_all(text, '[0-9a-f]{16,}'), string_split_regex(text, '[0-9a-f]{16,}') FROM d
  UNION ALL SELECT rid, owner, repo, 3, 'live', 20, regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_-]{20,}') FROM d),
m1 AS (SELECT rid, owner, repo, rank, kind, least, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM m0 WHERE len(hits) > 0),
m2 AS (SELECT rid, owner, repo, rank, kind, least, hit,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS s FROM m1),
m3 AS (SELECT *, s + length(hit) AS e,
         CASE WHEN rank = 0 THEN regexp_extract(hit, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE hit END AS value FROM m2),
m4 AS (SELECT * FROM m3 WHERE length(value) >= least),
sp AS (SELECT * FROM m4 a WHERE rank < 3
   OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
       AND NOT EXISTS (SELECT 1 FROM m4 b WHERE b.rid = a.rid AND b.rank < 3 AND b.s < a.e AND a.s < b.e))),
own AS (SELECT value, count(DISTINCT coalesce(owner, '<null>')) AS owners, count(DISTINCT repo) AS repos FROM sp GROUP BY value),
j AS (SELECT sp.*, owners <= 2 AND repos <= 4 AS live FROM sp JOIN own USING (value)),
g AS (SELECT rid,
   count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
   coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '') AS base,
   coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3 OR live), '') AS spans,
   count(*) FILTER (WHERE rank < 3 AND live) AS n_live, count(*) FILTER (WHERE rank < 3 AND NOT live) AS n_example
   FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
