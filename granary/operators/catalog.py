"""Operators over an entry table: selection, scopes, orders, pages, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import paths
from granary.functions.globs import to_regex
from granary.store import numbered, running

#: The largest value of an unsigned 64-bit number, at which totals stop.
MOST = "18446744073709551615"


class Unmatched(ValueError):
    """A pattern that matches nothing."""


# ---- selection


def glob(path: Column, pattern: str) -> Column:
    return path.rlike(to_regex(pattern))


def glob_subtree(path: Column, patterns: list[str]) -> Column:
    """The path or an entry above it matches one of the patterns."""
    regexes = [to_regex(p) for p in patterns]
    every = F.concat(paths.ancestors(path), F.array(path))
    return F.exists(every, lambda a: reduce(lambda x, y: x | y, [a.rlike(r) for r in regexes], F.lit(False)))


def pattern_matches(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """(ord, pattern, matched) in one pass over the entries."""
    found = entries.agg(*[F.coalesce(F.bool_or(glob_subtree(F.col("path"), [p])), F.lit(False)).alias(f"m{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"), F.col(f"m{i}").alias("matched")) for i, p in enumerate(patterns)])
    return found.select(F.inline(rows))


def select(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Entries under any pattern; a pattern that matches nothing is an error, raised before any row is made."""
    missed = pattern_matches(entries, patterns).where("not matched").orderBy("ord").first()
    if missed:
        raise Unmatched(missed["pattern"])
    return entries.where(glob_subtree(F.col("path"), patterns))


def exclude(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Entries that no pattern matches, themselves or above."""
    return entries.where(~glob_subtree(F.col("path"), patterns))


def by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries whose id is listed; ids of no entry are ignored."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def with_ancestors(entries: DataFrame) -> DataFrame:
    """(id, path, above, depth) for every proper ancestor path."""
    return entries.select("id", "path", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "above"))


def by_ids_closed(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed entries and all below listed directories, whatever the table's order."""
    picked = by_ids(entries, ids)
    folders = picked.where("kind = 'Directory'").select(F.col("path").alias("above"))
    below = with_ancestors(entries).join(folders, "above", "left_semi").select("id")
    return by_ids(entries, picked.select("id").union(below))


def parents(entries: DataFrame) -> DataFrame:
    """(id, parent): the id of the nearest directory above that exists; -1 is the root."""
    folders = entries.where("kind = 'Directory'").select(F.col("path").alias("above"), F.col("id").alias("folder"))
    nearest = with_ancestors(entries).join(folders, "above").groupBy("id").agg(F.max_by("folder", "depth").alias("parent"))
    return entries.select("id").join(nearest, "id", "left").select("id", F.coalesce("parent", F.lit(-1)).alias("parent"))


def crumbs(entries: DataFrame) -> DataFrame:
    """(id, level, folder): the existing directories above each entry, from the root down."""
    folders = entries.where("kind = 'Directory'").select(F.col("path").alias("above"), F.col("id").alias("folder"))
    return with_ancestors(entries).join(folders, "above").select("id", F.col("depth").alias("level"), "folder")


def children(entries: DataFrame, folder: int) -> DataFrame:
    """Entries whose parent is ``folder`` (-1: the root)."""
    return entries.join(parents(entries).where(F.col("parent") == folder), "id", "left_semi")


def child_counts(entries: DataFrame) -> DataFrame:
    """(parent, children) for the root and every directory, childless ones too."""
    counted = parents(entries).groupBy("parent").agg(F.count("*").alias("children"))
    every = entries.where("kind = 'Directory'").select(F.col("id").alias("parent")).union(entries.sparkSession.range(1).select((F.col("id") - 1).alias("parent")))
    return every.join(counted, "parent", "left").select("parent", F.coalesce("children", F.lit(0)).alias("children"))


def conflicts(entries: DataFrame) -> DataFrame:
    """Entries that lie below something that is no directory."""
    solid = entries.where("kind <> 'Directory'").select(F.col("path").alias("above"))
    return entries.join(with_ancestors(entries).join(solid, "above", "left_semi").select("id").distinct(), "id", "left_semi")


def case_clashes(entries: DataFrame) -> DataFrame:
    """(folded, n, first_path): lower-cased paths that several entries share."""
    return entries.groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def fingerprint(entries: DataFrame) -> DataFrame:
    """Count and digest of (id, path, size).  The digest is a sum over rows, so no task needs them in order;
    the id in each row makes the order count all the same."""
    row = F.md5(F.concat_ws(":", "id", "path", "size"))
    return entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")), F.lit(0)).alias("digest"))


# ---- orders and pages

def kind_rank() -> Column:
    return F.when(F.col("kind") == "Directory", 0).when(F.col("kind") == "File", 1).otherwise(2)


def order_of(key: str, down: bool = False) -> list[Column]:
    """Columns to sort by; ties go by id, ascending in either direction.  ``path`` is the table's own order."""
    keys = {
        "path": [F.col("id")],
        "name": [paths.name(F.col("path"))],
        "size": [F.col("size")],
        "modified": [F.col("mtime_ns")],
        "kind": [kind_rank(), paths.name(F.col("path"))],
    }[key]
    return [*[k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys], F.col("id").asc()]


def view(entries: DataFrame, key: str = "path", down: bool = False) -> DataFrame:
    """Entries with their place ``pos`` in the view."""
    return numbered(entries, *order_of(key, down), column="pos")


def page(entries: DataFrame, key: str, down: bool, first: int, n: int) -> DataFrame:
    """Rows ``first`` to ``first + n`` of a view, fewer at its end; a top-k, not a full sort, for early pages."""
    return entries.orderBy(*order_of(key, down)).offset(first).limit(n)


def picked_range(viewed: DataFrame, anchor: int, row: int) -> DataFrame:
    """Rows of a view between two places, both included, in whichever order they are given."""
    return viewed.where(F.col("pos").between(min(anchor, row), max(anchor, row)))


def picks_in_view(entries: DataFrame, ids: DataFrame, in_view: Column) -> DataFrame:
    """How many picked entries the view shows and how many it hides."""
    return by_ids(entries, ids).agg(F.count_if(in_view).alias("shown"), F.count_if(~in_view).alias("hidden"))


# ---- totals


def saturating(total: Column) -> Column:
    """A sum that stops at the largest unsigned 64-bit number; of nothing, 0."""
    return F.least(F.coalesce(F.sum(total.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))


def totals(entries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """entries, files, dirs, bytes, picked, picked_bytes; only files have bytes, symlinks are entries only."""
    marked = entries.withColumn("is_picked", F.lit(False))
    if ids is not None:
        marked = entries.join(ids.select("id").distinct().withColumn("is_picked", F.lit(True)), "id", "left").withColumn("is_picked", F.coalesce("is_picked", F.lit(False)))
    is_file = F.col("kind") == "File"
    return marked.agg(
        F.count("*").alias("entries"),
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("kind") == "Directory").alias("dirs"),
        saturating(F.when(is_file, F.col("size"))).alias("bytes"),
        F.count_if("is_picked").alias("picked"),
        saturating(F.when(is_file & F.col("is_picked"), F.col("size"))).alias("picked_bytes"),
    )


def picked_closed_bytes(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Bytes of all files under the picked rows, each file once."""
    return by_ids_closed(entries, ids).where("kind = 'File'").agg(F.count("*").alias("files"), saturating(F.col("size")).alias("bytes"))


def preflight(entries: DataFrame, patterns: list[str], there: DataFrame) -> DataFrame:
    """Of a selection: entries, files, bytes, and how many of its paths exist at the target (``there``: path)."""
    chosen = entries.where(glob_subtree(F.col("path"), patterns)).join(there.select("path").distinct().withColumn("old", F.lit(True)), "path", "left")
    is_file = F.col("kind") == "File"
    return chosen.agg(F.count("*").alias("entries"), F.count_if(is_file).alias("files"), saturating(F.when(is_file, F.col("size"))).alias("bytes"), F.count("old").alias("existing"))


def inventory(entries: DataFrame) -> DataFrame:
    """entries, bytes of their paths, bytes of files."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("path_bytes"), saturating(F.when(F.col("kind") == "File", F.col("size"))).alias("input_bytes"))


def capped(entries: DataFrame, most: int) -> DataFrame:
    """Files, in path order, until ``most`` bytes are reached; the last is read in part (``take`` bytes)."""
    return running(entries.where("kind = 'File'"), "size", "path").where(F.col("before") < most).select("path", "size", F.least(F.col("size"), most - F.col("before")).alias("take"))


def rate(files: DataFrame, seconds: Column) -> DataFrame:
    """Bytes a second over all files, 0 where nothing was timed."""
    return files.agg(F.sum("size").alias("bytes"), F.sum(seconds).alias("s")).select("bytes", F.when(F.col("s") > 0, F.round(F.col("bytes") / F.col("s"), 3)).otherwise(F.lit(0.0)).alias("rate"))


def adjacent_duplicates(entries: DataFrame, key: str = "path") -> DataFrame:
    """Keys that more than one row has; neighbours in sorted order, found without sorting."""
    return entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def free_name(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, free): the path itself, or ``stem (k).ext`` with the smallest k from 1 on that no taken path has.

    The numbers taken of a shape are ranked; the first that isn't its own rank leaves its rank free.  The extension is
    what follows the last dot of the name, if that isn't its first sign.
    """
    shape = r"^(.*?[^/.][^/]*?|.*?/?\.[^/.]*)(\.[^./]*)?$"
    stem, ext = F.regexp_extract("path", shape, 1), F.regexp_extract("path", shape, 2)
    shaped = wanted.select("path", stem.alias("stem"), ext.alias("ext"))
    number = r"^(.*) \(([1-9][0-9]{0,17})\)(\.[^./]*)?$"
    used = taken.select(*[F.regexp_extract("path", number, i).alias(c) for i, c in ((1, "stem"), (3, "ext"))], F.regexp_extract("path", number, 2).try_cast("long").alias("k"))
    ranked = used.where("k is not null").distinct().withColumn("rank", F.row_number().over(W.partitionBy("stem", "ext").orderBy("k")))
    gaps = ranked.groupBy("stem", "ext").agg(F.coalesce(F.min(F.when(F.col("k") != F.col("rank"), F.col("rank"))), F.max("rank") + 1).alias("gap"))
    clash = taken.select("path").distinct().withColumn("clash", F.lit(True))
    found = shaped.join(gaps, ["stem", "ext"], "left").join(clash, "path", "left")
    other = F.concat("stem", F.lit(" ("), F.coalesce("gap", F.lit(1)).cast("string"), F.lit(")"), "ext")
    return found.select("path", F.when(F.col("clash"), other).otherwise(F.col("path")).alias("free"))


def overlaps(blocks: DataFrame) -> DataFrame:
    """Ranges (grp, start, stop) that begin before the one before them, by start, has ended."""
    order = W.partitionBy("grp").orderBy("start", "stop")
    furthest = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("reach", furthest).where(F.col("start") < F.col("reach"))
