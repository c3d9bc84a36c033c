"""Measurement analytics: medians, rates, blends, best results, comparisons, gates and lineage.

Rows are (tool, setting, class, ...) with ``ord``, the order in which they were measured, wherever ties need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.store import numbered, stored

INF = float("inf")


# ---- medians


def median_double(x: Column) -> Column:
    """The mean of the two middle values for an even number; 0 for none."""
    return F.coalesce(F.median(x), F.lit(0.0))


def medians_whole(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of whole numbers the same, a column each, in whole numbers: the mean rounded down, without leaving 64 bits; 0 for
    none, nulls not counting.

    Equal values are counted first, before the shuffle; running counts over them then tell the middle ones, so no
    group is gathered in memory.
    """
    each = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).cast("long").alias("value")) for i, c in enumerate(columns)])))
    counted = each.groupBy(*by, "which", "value").agg(F.count("value").alias("n"))
    group = W.partitionBy(*by, "which")
    so_far, total = F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), F.sum("n").over(group)
    ranked = counted.withColumns({"so_far": so_far, "total": total})
    reached = lambda place: F.min(F.when((F.col("n") > 0) & (F.col("so_far") >= F.floor(place)), F.col("value")))
    middle = ranked.groupBy(*by, "which").agg(reached((F.col("total") + 1) / 2).alias("low"), reached(F.col("total") / 2 + 1).alias("high"))
    # Half of either, and the half that both leave over.
    mean = F.shiftright("low", 1) + F.shiftright("high", 1) + F.col("low").bitwiseAND(1).bitwiseAND(F.col("high"))
    return middle.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("which") == i, mean)), F.lit(0)).cast("long").alias(c) for i, c in enumerate(columns)])


def median_if_all(x: Column) -> Column:
    """The median where every row has a value, else null."""
    return F.when(F.count(x) == F.count("*"), F.median(x))


def median_struct(rows: DataFrame, by: list[str], doubles: list[str], wholes: list[str], flags: list[str]) -> DataFrame:
    """Field by field over repeats; a flag is set if any repeat sets it."""
    simple = rows.groupBy(*by).agg(*[median_double(F.col(c)).alias(c) for c in doubles], *[F.bool_or(c).alias(c) for c in flags])
    if not wholes:
        return simple
    whole = medians_whole(rows, by, wholes)
    if not by:
        return simple.crossJoin(whole)  # a row each
    same = [simple[c].eqNullSafe(whole[c]) for c in by]
    return simple.join(whole, same).select(*[simple[c] for c in [*by, *doubles]], *[whole[c] for c in wholes], *[simple[c] for c in flags])


# ---- rates and blends


def rates(rows: DataFrame) -> DataFrame:
    """size_pct, mbps and mib of measured rows (archive_bytes, class_bytes, wall, compress_peak, extract_peak).

    A row without usable time or without bytes has failed and has no rates.
    """
    usable = F.coalesce((F.col("wall") > 0) & (F.col("wall") < INF) & (F.col("class_bytes") > 0), F.lit(False))
    return rows.withColumns(
        {
            "failed": ~usable,
            "size_pct": F.when(usable, F.col("archive_bytes") * 100.0 / F.col("class_bytes")),
            "mbps": F.when(usable, F.col("class_bytes") / 1e6 / F.col("wall")),
            "mib": F.when(usable, F.greatest("compress_peak", "extract_peak") / F.lit(1048576.0)),
        }
    )


def blend(rows: DataFrame, mix: DataFrame, by: list[str]) -> DataFrame:
    """Size and speed over a mix (class, weight): weighted mean of sizes, weighted harmonic mean of speeds.

    Only where every class of the mix is measured; a part of it never stands for the whole.
    """
    n = mix.agg(F.count("*").alias("wanted"))
    joined = rows.join(mix, "class").crossJoin(F.broadcast(n))  # a row
    return (
        joined.groupBy(*by, "wanted")
        .agg(
            F.count("size_pct").alias("measured"),
            (F.sum(F.col("weight") * F.col("size_pct")) / F.sum("weight")).alias("size_pct"),
            (F.sum("weight") / F.sum(F.col("weight") / F.col("mbps"))).alias("mbps"),
        )
        .where("measured = wanted")
        .select(*by, "size_pct", "mbps")
    )


def mix_ratio(rows: DataFrame, mix: DataFrame, by: list[str]) -> DataFrame:
    """Weighted archive share in percent."""
    return rows.join(mix, "class").groupBy(*by).agg((F.sum(F.col("weight") * F.col("archive_bytes") / F.col("class_bytes")) / F.sum("weight") * 100).alias("ratio_pct"))


def best(rows: DataFrame, by: str = "class", keep: Column | None = None) -> DataFrame:
    """The smallest archive of each class; the row measured first wins ties."""
    chosen = rows if keep is None else rows.where(keep)
    return chosen.groupBy(by).agg(F.min(F.struct("archive_bytes", "ord", "tool", "setting")).alias("b")).select(by, "b.tool", "b.setting", "b.archive_bytes")


def on_every_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(tool, setting) measured on all of the classes."""
    wanted = classes.select("class").distinct()
    n = wanted.agg(F.count("*").alias("wanted"))
    found = rows.join(wanted, "class", "left_semi").groupBy("tool", "setting").agg(F.countDistinct("class").alias("n"))
    return found.crossJoin(F.broadcast(n)).where("n = wanted").select("tool", "setting")


def best_single(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The setting of the smallest sum among those measured on every class; the first measured wins ties."""
    sums = rows.join(classes.select("class").distinct(), "class", "left_semi").join(on_every_class(rows, classes), ["tool", "setting"], "left_semi")
    totals = sums.groupBy("tool", "setting").agg(F.sum("archive_bytes").alias("total"), F.min("ord").alias("ord"))
    return totals.orderBy("total", "ord").limit(1).select("tool", "setting", "total")


def best_mix(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """The same by the weighted ratio over a mix."""
    whole = rows.join(on_every_class(rows, mix), ["tool", "setting"], "left_semi")
    ratios = mix_ratio(whole, mix, ["tool", "setting"]).join(whole.groupBy("tool", "setting").agg(F.min("ord").alias("ord")), ["tool", "setting"])
    return ratios.orderBy(F.round("ratio_pct", 9), "ord").limit(1).select("tool", "setting", "ratio_pct")


# ---- comparisons


def growth_pct(old: Column, new: Column) -> Column:
    """Signed growth in percent: of nothing to nothing 0, of nothing to something infinite."""
    return F.when((old == 0) & (new == 0), F.lit(0.0)).when(old == 0, F.lit(INF)).otherwise((new - old) * 100.0 / F.nullif(old, F.lit(0)))


def compare(a: DataFrame, b: DataFrame, limit: float = 3.0) -> DataFrame:
    """Two runs by (tool, setting), sums of per-class values (NULL: failed): state, pct and within."""
    total = lambda df, s: df.groupBy("tool", "setting").agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias(s), F.lit(True).alias(f"in_{s}"))
    both = total(a, "a").join(total(b, "b"), ["tool", "setting"], "full_outer")
    state = (
        F.when(F.col("in_b").isNull(), "only a")
        .when(F.col("in_a").isNull(), "only b")
        .when(F.col("a").isNull() & F.col("b").isNull(), "failed in both")
        .when(F.col("a").isNull(), "failed in a")
        .when(F.col("b").isNull(), "failed in b")
        .otherwise("both")
    )
    pct = F.abs(growth_pct(F.col("a"), F.col("b")))
    return both.select("tool", "setting", state.alias("state"), pct.alias("pct"), (pct <= limit).alias("within"))


def size_gate(golden: DataFrame, new: DataFrame, limit: float = 1.0) -> DataFrame:
    """Golden and new sizes by (tool, setting, class): growth and verdict."""
    key = ["tool", "setting", "class"]
    both = golden.select(*key, F.col("bytes").alias("old")).join(new.select(*key, F.col("bytes").alias("new")), key, "full_outer")
    pct = growth_pct(F.col("old"), F.col("new"))
    verdict = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(pct > limit, "larger").otherwise("ok")
    return both.select(*key, pct.alias("pct"), verdict.alias("verdict"))


def tree_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences of trees (path, size, hash; a null hash is unreadable), in order: place, kind, path."""
    both = expected.select("path", F.col("size").alias("es"), F.col("hash").alias("eh"), F.lit(True).alias("e")).join(
        actual.select("path", F.col("size").alias("s"), F.col("hash").alias("h"), F.lit(True).alias("a")), "path", "full_outer"
    )
    kind = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("e").isNull(), "extra")
        .when(F.col("h").isNull(), "unreadable")
        .when(F.col("es") != F.col("s"), "size")
        .when(F.col("eh") != F.col("h"), "content")
    )
    place = F.when(F.col("kind") == "missing", 0).when(F.col("kind") == "extra", 2).otherwise(1)
    return both.select("path", kind.alias("kind")).where("kind is not null").select(place.alias("place"), "kind", "path")


def superseded(rows: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Rows without those that a later list names, and then the later ones."""
    return rows.join(later.select(*key).distinct(), key, "left_anti").unionByName(later)


def pooled_faults(rows: DataFrame) -> DataFrame:
    """Why runs can't be pooled: repeated keys, several hosts or profiles, classes of several manifests."""
    twice = rows.groupBy("tool", "setting", "class").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("/", "tool", "setting", "class").alias("what"), F.lit("repeated").alias("fault"))
    parts = [twice]
    for column in ("host", "profile"):
        parts.append(rows.agg(F.countDistinct(column).alias("n")).where("n > 1").select(F.lit(column).alias("what"), F.lit("differs").alias("fault")))
    parts.append(several_manifests(rows).select(F.col("class").alias("what"), F.lit("several manifests").alias("fault")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def several_manifests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.countDistinct("manifest").alias("n")).where("n > 1")


def planned(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Planned combinations with the first result row of each."""
    key = ["tool", "setting", "class"]
    first = rows.groupBy(*key).agg(F.min_by("value", "ord").alias("value"))
    return plan.join(first, key)


def without_information(rows: DataFrame) -> DataFrame:
    """Rows that count; those given for information are shown apart."""
    return rows.where(F.col("information").isNull())


# ---- classification of gates


def confusion(rows: DataFrame, thresholds: list[float], truths: list[str]) -> DataFrame:
    """tp, fp, tn, fn for each threshold of ``score`` and each column of truth, by class; one pass."""
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(c).alias("truth_name"), F.col(c).alias("truth")) for t in thresholds for c in truths])
    each = rows.select("class", "score", F.inline(grid)).withColumn("says", F.col("score") >= F.col("threshold"))
    n = lambda says, truth: F.count_if((F.col("says") == says) & (F.col("truth") == truth))
    return each.groupBy("class", "threshold", "truth_name").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, False).alias("tn"), n(False, True).alias("fn"))


def pooled(matrix: DataFrame) -> DataFrame:
    """The counts over all classes that are there."""
    return matrix.groupBy("threshold", "truth_name").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def precision_recall(matrix: DataFrame) -> DataFrame:
    """precision and recall; null where there is nothing to divide by."""
    return matrix.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def at_least_pct(part: Column, whole: Column, pct: int) -> Column:
    """part / whole >= pct %, by products."""
    return part.cast("decimal(38,0)") * 100 >= whole.cast("decimal(38,0)") * pct


def gate(value: Column, limit: Column | float, below: bool = True) -> Column:
    """PASS or FAIL; without a value, not evaluable and never PASS."""
    ok = value <= limit if below else value >= limit
    return F.when(value.isNull(), "not evaluable").when(ok, "PASS").otherwise("FAIL")


def verdict(gates: DataFrame) -> DataFrame:
    """One line: GO, or NO-GO with the failing and the open gates (gate, state)."""
    named = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("gate")))), ", ")
    parts = gates.agg(named("FAIL").alias("failing"), named("not evaluable").alias("open"))
    text = F.concat_ws("; ", F.when(F.col("failing") != "", F.concat(F.lit("failing gates: "), "failing")), F.when(F.col("open") != "", F.concat(F.lit("open gates: "), "open")))
    return parts.select(F.when(text == "", F.lit("GO")).otherwise(F.concat(F.lit("NO-GO: "), text)).alias("verdict"))


# ---- accounting


def accounted(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Both lists (source, path, bytes, digest) by path: eb and fb, their bytes, and fault: missing, altered or null."""
    both = expected.select("source", "path", F.col("bytes").alias("eb"), F.col("digest").alias("ed")).join(
        found.select("source", "path", F.col("bytes").alias("fb"), F.col("digest").alias("fd")), ["source", "path"], "full_outer"
    )
    fault = F.when(F.col("fb").isNull(), "missing").when(F.col("fd") != F.col("ed"), "altered")
    return both.select("source", "path", "eb", "fb", fault.alias("fault"))


def accounting(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: expected and found files and bytes, and how many paths are missing or altered."""
    return accounted(expected, found).groupBy("source").agg(
        F.count("eb").alias("expected"),
        F.count("fb").alias("found"),
        F.coalesce(F.sum("eb"), F.lit(0)).alias("expected_bytes"),
        F.coalesce(F.sum("fb"), F.lit(0)).alias("found_bytes"),
        F.count_if(F.col("fault") == "missing").alias("missing"),
        F.count_if(F.col("fault") == "altered").alias("altered"),
    )


def accounting_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The paths behind those counts, a row each: source, path, fault."""
    return accounted(expected, found).where(F.col("fault").isNotNull()).select("source", "path", "fault")


def digest_check(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(reason, n): ok, differs, no digest, no class, over rows (class, digest) and a manifest."""
    joined = rows.join(manifest.select("class", F.col("digest").alias("md"), F.lit(True).alias("there")), "class", "left")
    reason = F.when(F.col("there").isNull(), "no class").when(F.col("digest").isNull(), "no digest").when(F.col("digest") == F.col("md"), "ok").otherwise("differs")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def by_label(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Count and bytes for a fixed list of labels, in its order, with zeros for absent ones."""
    domain = rows.sparkSession.createDataFrame(list(enumerate(labels)), "ord int, label string")
    counted = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return F.broadcast(domain).join(counted, "label", "left").select("ord", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bytes")])


class UnknownSource(ValueError):
    """A lock entry of a source that isn't registered."""


def two_level(locks: DataFrame, sources: DataFrame, classes: DataFrame) -> DataFrame:
    """Files and bytes per class, by way of sources; classes without entries show 0; missing bytes add 0."""
    lost = locks.join(sources, "source", "left_anti").first()
    if lost:
        raise UnknownSource(lost["source"])
    per_source = locks.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    per_class = per_source.join(sources, "source").groupBy("class").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return classes.join(per_class, "class", "left").select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes")])


#: Upper limits in percent and names of the shares' buckets.
SHARES = [(1, "under_1_pct"), (5, "1_to_5_pct"), (10, "5_to_10_pct"), (25, "10_to_25_pct"), (50, "25_to_50_pct"), (None, "50_pct_or_more")]


def bucket(part: Column, whole: Column) -> Column:
    """The share's bucket, in whole numbers; a whole of 0 counts as 1."""
    big = lambda c: c.cast("decimal(38,0)")
    out = F.lit(SHARES[-1][1])
    for pct, name in reversed(SHARES[:-1]):
        out = F.when(big(part) * 100 < big(F.greatest(whole, F.lit(1))) * pct, name).otherwise(out)
    return out


def map_sum(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Maps merged by key, their values added."""
    each = rows.select(*by, F.explode(column).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def rollup(rows: DataFrame) -> DataFrame:
    """files, bytes, ok and after_fallback for all, each class, and each class / folder.

    A file outside a folder counts under ``(class folder)``.  after_fallback: packed bytes where it worked, else
    the original's.
    """
    labelled = rows.withColumn("folder", F.coalesce("folder", F.lit("(class folder)")))
    level = F.grouping_id()
    return (
        labelled.rollup("class", "folder")
        .agg(
            F.when(level == 3, "all").when(level == 1, F.col("class")).otherwise(F.concat_ws("/", "class", "folder")).alias("label"),
            F.count("*").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.count_if("ok").alias("ok"),
            F.sum(F.when(F.col("ok"), F.col("packed")).otherwise(F.col("bytes"))).alias("after_fallback"),
        )
        .select("label", "files", "bytes", "ok", "after_fallback")
    )


def case_counts(rows: DataFrame) -> DataFrame:
    """Successes and failures, by cause, with bytes; recompressed successes and original failures added up."""
    return rows.groupBy("class").agg(
        F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("failure"),
        F.count_if(F.col("cause") == "size").alias("by_size"),
        F.count_if(F.col("cause") == "type").alias("by_type"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("ok_bytes"),
        F.sum(F.when(F.col("ok"), F.col("packed")).otherwise(F.col("bytes"))).alias("after_fallback"),
    )


def delta_gate(rows: DataFrame, limit_pct: int = 50) -> DataFrame:
    """Per class: the subject's best, the best of those without dedup, the estimated gain and a decision."""
    subject, other = F.col("subject"), ~F.col("subject") & ~F.col("dedup")
    b = F.col("archive_bytes")
    agg = rows.groupBy("class").agg(
        F.min(F.when(subject, b)).alias("ours"), F.min(F.when(other, b)).alias("theirs"), F.min_by(F.when(other, F.col("tool")), F.when(other, F.struct(b, F.col("ord")))).alias("rival")
    )
    decision = F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "open").when(F.col("ours") * 100 <= F.col("theirs") * limit_pct, "pass").otherwise("fail")
    return agg.select("class", "ours", "theirs", "rival", F.greatest(F.col("theirs") - F.col("ours"), F.lit(0)).alias("gain"), decision.alias("decision"))


def estimates(rows: DataFrame) -> DataFrame:
    """An estimate for each class by the class's own rule: (class, estimate, rule).

    rows: class, rule, bytes, lepton, packed, correction, derived_a, derived_b, best.
    """
    estimate = (
        F.when(F.col("rule") == "jpeg", F.coalesce("lepton", "bytes"))
        .when(F.col("rule") == "deflate", F.col("packed") + F.coalesce("correction", F.lit(0)))
        .when(F.col("rule") == "backup", F.least("derived_a", "derived_b"))
        .when(F.col("rule").isin("video", "random"), F.col("bytes"))
        .otherwise(F.col("best"))
    )
    note = F.when(F.col("rule").isin("jpeg", "deflate", "backup", "video", "random"), F.col("rule")).otherwise("no gain claimed")
    return rows.select("class", estimate.alias("estimate"), note.alias("rule"))


def raw_rate(rows: DataFrame) -> DataFrame:
    """The median over passes of bytes per second of reading and opening."""
    return rows.groupBy("class").agg(F.median(F.col("bytes") / F.nullif(F.col("read_s") + F.col("open_s"), F.lit(0.0))).alias("rate"))


def cover(rows: DataFrame) -> DataFrame:
    """Covered bytes at their packed size, the others as stored; whether the cover is partial."""
    return rows.select("class", (F.col("packed") + F.col("bytes") - F.col("covered")).alias("estimate"), (F.col("covered") < F.col("bytes")).alias("partial"))


def corpus_totals(rows: DataFrame) -> DataFrame:
    """Files and bytes over distinct classes; the first row of a class counts."""
    first = rows.groupBy("class").agg(F.min_by(F.struct("class_files", "class_bytes"), "ord").alias("f"))
    return first.agg(F.count("*").alias("classes"), F.sum("f.class_files").alias("files"), F.sum("f.class_bytes").alias("bytes"))


def class_digest(rows: DataFrame, fan: int = 256) -> DataFrame:
    """A digest per class over its members in path order: a tree whose leaves are (path, bytes, hash, each ended by NUL)
    and whose nodes are the digests of up to ``fan`` nodes below, joined.  No task holds more of a class than that."""
    line = F.concat(F.col("path"), F.lit("\x00"), F.col("bytes").cast("string"), F.lit("\x00"), F.col("hash"), F.lit("\x00"))
    members = numbered(rows.select("class", "path", line.alias("part")), "class", "path", "part", column="at")
    first = stored(members.groupBy(F.col("class").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n")), "class-starts")
    level = members.join(first, F.col("class").eqNullSafe(F.col("of"))).select("class", (F.col("at") - F.col("first")).alias("i"), "part")
    left = first.agg(F.max("n")).first()[0] or 1
    while True:
        listed = F.array_sort(F.collect_list(F.struct("i", "part")))  # at most fan of them
        node = F.sha2(F.array_join(F.transform(listed, lambda x: x["part"]), ""), 256)
        level = stored(level.groupBy("class", F.floor(F.col("i") / fan).alias("i")).agg(node.alias("part")), "class-digest")
        left = -(-left // fan)
        if left <= 1:
            return level.select("class", F.col("part").alias("digest"))


def merkle(rows: DataFrame) -> DataFrame:
    """(level, i, hash) of the tree over rows (i from 0, hash), level by level; an odd last node moves up as it is.

    Each level is half the one below, made of it by one aggregation and stored; the driver only counts levels.
    """
    level = rows.select(F.lit(0).alias("level"), F.col("i").cast("long").alias("i"), "hash")
    out, n, at = level, rows.count(), 0
    while n > 1:
        at += 1
        pair = level.groupBy(F.shiftright("i", 1).alias("i")).agg(F.min_by("hash", "i").alias("a"), F.max_by("hash", "i").alias("b"), F.count("*").alias("c"))
        level = pair.select(F.lit(at).alias("level"), "i", F.when(F.col("c") == 2, F.sha2(F.concat("a", "b"), 256)).otherwise(F.col("a")).alias("hash"))
        level = stored(level, f"merkle-{at}")
        out, n = out.union(level), (n + 1) // 2
    return out


def proof(tree: DataFrame, i: int) -> DataFrame:
    """(level, hash, left) of the neighbours on the way from leaf ``i`` to the root."""
    place = F.expr(f"shiftright({int(i)}L, level)")
    beside = place.bitwiseXOR(F.lit(1).cast("long"))
    return tree.where(F.col("i") == beside).select("level", "hash", (beside < place).alias("left"))


# ---- lineage


def traced(value: Column, sources: Column) -> Column:
    return F.struct(value.alias("value"), F.array_sort(F.array_distinct(sources)).alias("sources"))


def combined(a: Column, b: Column, value: Column) -> Column:
    """A value made of two traced ones: it comes from the sources of both."""
    return traced(value, F.array_union(a["sources"], b["sources"]))


def sources_of(sources: Column) -> Column:
    """The sources of an aggregate over traced values; equal lists are kept once, from the first task on."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources))))


def bracketed(sources: Column) -> Column:
    """Sorted sources as ``[1,3-5,9]``: three or more in a row, or two, as a range."""
    begins = F.filter(sources, lambda x: ~F.array_contains(sources, x - 1))
    ends = F.filter(sources, lambda x: ~F.array_contains(sources, x + 1))
    shown = F.zip_with(begins, ends, lambda a, b: F.when(a == b, a.cast("string")).when(b == a + 1, F.concat_ws(",", a, b)).otherwise(F.concat_ws("-", a, b)))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))


# ---- shown values


def shown_pct(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF), "n/a").otherwise(F.concat(F.format_string("%.2f", x), F.lit(" %")))


def shown_mbps(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF), "n/a").otherwise(F.format_string("%.1f", x))


def parsed_size(text: Column) -> Column:
    """``512M``, ``2G``, ``64K`` or plain bytes; null for anything else, or beyond 64 bits."""
    digits, unit = F.regexp_extract(text, r"^(\d{1,18})([KMG]?)$", 1), F.regexp_extract(text, r"^(\d{1,18})([KMG]?)$", 2)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    product = digits.try_cast("decimal(20,0)") * factor.cast("decimal(18,0)")
    return F.when(text.rlike(r"^\d{1,18}[KMG]?$"), product.try_cast("long"))


def unclean(rows: DataFrame) -> DataFrame:
    """Reasons why an input set isn't clean: no settle pause, a dirty build, several thread counts."""
    one = rows.agg(F.bool_or(F.coalesce(F.col("settle_s"), F.lit(0.0)) <= 0).alias("rushed"), F.bool_or("dirty").alias("dirty"), F.countDistinct("threads").alias("threads"))
    reasons = F.array_compact(F.array(F.when(F.col("rushed"), "no settle pause"), F.when(F.col("dirty"), "dirty build"), F.when(F.col("threads") > 1, "mixed threads")))
    return one.select(reasons.alias("reasons"))


def semantic_faults(rows: DataFrame) -> DataFrame:
    """Rules that result rows break: (ord, rule).

    rows: ord, file, tool, setting, class, known_tool, repeats, wanted, flagged, has_median, verified.
    """
    rules = {
        "file name differs from content": "file <> concat_ws('--', tool, setting, class)",
        "tool is not listed": "not known_tool",
        "repeats differ from those asked for": "repeats <> wanted",
        "median beside a flagged repeat": "flagged and has_median",
        "not verified": "not verified",
    }
    return rows.select("ord", F.explode(F.array_compact(F.array(*[F.when(F.expr(t), F.lit(n)) for n, t in rules.items()]))).alias("rule"))
