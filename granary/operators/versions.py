"""Version roots, siblings, as-of pairs, snapshots and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import paths
from granary.operators.blocks import compared
from granary.session import modest_batches
from granary.store import numbered, stored


def split_root(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with the first (shortest) root above them, and their path below it; null without one."""
    above = entries.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "root")).join(roots.select("root").distinct(), "root")
    first = above.groupBy("path").agg(F.min_by("root", "level").alias("root"))
    return entries.join(first, "path", "left").withColumn("rel", F.expr("substring(path, length(root) + 2)"))


#: Paths of a root that one array holds.
GATHERED = 50_000
#: Roots of a block, whose pairs with another block's one task counts at once, and paths of a block that one array holds.
SIDE, HELD = 4096, 500_000
#: Pairs by shared paths that aren't worth blocks, and what a pair of roots costs in a block, as a part of such a pair.
PAIRED, CELL = 1 << 18, 1 / 32


def copies(rows: DataFrame) -> DataFrame:
    """Distinct (root, rel) as (root, first, n, held): the least root that has exactly the same paths, the number of
    these paths, and the number of roots that have them.

    Sets are equal where their sizes and eight sums are, of numbers of 32 bits made of their paths' SHA-256, so no set is gathered.
    """
    digest = F.sha2(F.col("rel").cast("string"), 256)
    hashed = rows.where("root is not null and rel is not null").select("root", *[F.xxhash64(F.lit(i), digest).alias(f"h{i}") for i in range(4)])
    halves = [half for i in range(4) for half in (F.shiftright(f"h{i}", 32), F.col(f"h{i}").bitwiseAND((1 << 32) - 1))]
    key = ["n", *[f"sum{i}" for i in range(len(halves))]]
    marked = stored(hashed.groupBy("root").agg(F.count("*").alias("n"), *[F.sum(half).alias(f"sum{i}") for i, half in enumerate(halves)]), "root-marks")
    same = marked.groupBy(*key).agg(F.min("root").alias("first"), F.count("*").alias("held"))
    return stored(marked.join(same, key).select("root", "first", "n", "held"), "root-copies")


def siblings(files: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """Pairs of roots that share at least num/den of the smaller one's paths (a half, unless told otherwise): a, b,
    common, least.  ``files``: root, rel.

    Roots with the same paths are looked at once, and their pairs are made from the result.
    """
    rows = stored(files.select("root", "rel").distinct(), "root-paths")
    same = copies(rows)
    pairs = siblings_of_firsts(rows, same, num, den)
    many = same.where((F.col("held") > 1) & (F.col("n") * den >= F.col("n") * num))
    if same.where("held > 1").isEmpty():
        return pairs
    pairs = stored(pairs, "root-siblings")
    xs, ys = same.select(F.col("first").alias("a"), F.col("root").alias("x")), same.select(F.col("first").alias("b"), F.col("root").alias("y"))
    across = pairs.join(xs, "a").join(ys, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "least")
    left, right = many.select("first", F.col("root").alias("a"), F.col("n").alias("common"), F.col("n").alias("least")), many.select("first", F.col("root").alias("b"))
    return across.union(left.join(right, "first").where("a < b").select("a", "b", "common", "least"))


def siblings_of_firsts(rows: DataFrame, same: DataFrame, num: int, den: int, linked: bool = False) -> DataFrame:
    """The pairs among the first roots of :func:`copies`; if ``linked``, links (a, b) that connect the same roots.

    Paths are numbered, those of the fewest roots first.  Of n paths a smaller root must share ``need``, so one
    of its n - need + 1 rarest: only these look for partners, among roots at least as large, which makes paths that all
    roots have the last to be looked at.  Where that would still look at more pairs than there are, as with few
    paths that a large share of the roots have, the roots that these paths bring together are compared by blocks.
    """
    rows = rows.join(same.where("root = first").select("root", "n"), "root")
    held = rows.groupBy("rel").agg(F.count("*").alias("held"))
    coded = rows.join(numbered(held, "held", "rel", column="word"), "rel")
    need = F.ceil(F.col("n") * num / den)
    rank = F.row_number().over(W.partitionBy("root").orderBy("word"))
    # Stored, so that both sides of a join come fresh from a shuffle and a path that many roots have can be split.
    ranked = coded.withColumn("rank", rank).where("held > 1").withColumn("rare", F.col("rank") <= F.col("n") - need + 1)
    words = stored(ranked.select("root", "word", "n", "held", "rare"), "root-words")
    weight = F.sum(F.col("rare").cast("double")) * F.first("held")
    weights = words.groupBy("word").agg(weight.alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    limit = None
    if total > PAIRED:
        weights = stored(weights, "word-weights", 4)
        marks = stored(words.join(weights, "word").groupBy("root", "n").agg(F.max("weight").alias("met"), F.max(F.when(F.col("rare"), F.col("weight"))).alias("asked")), "root-weights")
        limit, rest, asking = cheapest(weights, marks, total)
    if limit is None:
        return paired(words, words.where("rare"), num, den, linked)
    order = ~F.coalesce(F.col("asked") > limit, F.lit(False))
    seats = stored(numbered(marks.where(F.col("met") > limit).select("root", "n", order.alias("late")), "late", "root", column="seat").select("root", "n", "seat"), "root-seats")
    whole = -(-asking // SIDE)  # blocks that hold roots which ask
    found = in_blocks(words, seats, whole, num, den, linked)
    if not rest:
        return found
    rare = words.where("rare").join(weights.where(F.col("weight") <= limit).select("word"), "word")
    return found.unionByName(paired(words, rare, num, den, linked, seats.select("root", "seat"), whole * SIDE))


def cheapest(weights: DataFrame, marks: DataFrame, total: float) -> tuple[float | None, float, int]:
    """The weight above which words are left to blocks, what the other words cost, and the roots that ask for partners by
    words above it; no weight if blocks would cost more than they save.

    A word weighs as many pairs as it brings together; the cell of a block costs a part (CELL) of that of a pair.
    """
    limits = [0.0, *(float(1 << k) for k in range(12, 43, 6))]
    left = weights.agg(*[F.sum(F.when(F.col("weight") <= x, F.col("weight")).otherwise(0.0)) for x in limits]).first()
    sizes = marks.agg(*[F.count_if(F.col(c) > x) for x in limits for c in ("asked", "met")]).first()
    costs = [(left[k] + sizes[2 * k] * sizes[2 * k + 1] * CELL, k) for k in range(len(limits)) if sizes[2 * k]]
    cost, k = min(costs, default=(total, None))
    return (limits[k], left[k], sizes[2 * k]) if cost < total else (None, total, 0)


def in_blocks(words: DataFrame, seats: DataFrame, whole: int, num: int, den: int, linked: bool) -> DataFrame:
    """Siblings among roots with a seat, of which at least one sits in the first ``whole`` blocks of SIDE seats.

    A task takes two blocks with all their words, in parts of bounded size, and counts what any two roots share.
    """
    spark = seats.sparkSession
    modest_batches(spark)
    placed = seats.withColumns({"block": F.floor(F.col("seat") / SIDE), "place": F.col("seat") % SIDE})
    heads = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "root"))).alias("head"), F.sum("n").alias("words"))
    heads = stored(heads, "block-heads", 4)
    blocks, most = heads.agg(F.count("*"), F.max("words")).first()
    parts = -(-most // HELD)
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")
    code = F.col("word") * SIDE + F.col("place")
    if words.agg(F.max("word")).first()[0] < (1 << 31) // SIDE - 1:
        code = code.cast("int")
    cells = words.join(placed.drop("n"), "root").groupBy("block", part).agg(F.collect_list(code).alias("codes"))
    cells = stored(cells.join(heads.drop("words"), "block").select("block", "part", "codes", F.col("head.n").alias("n"), F.col("head.root").alias("root")), "block-words")
    one, other = (cells.select(F.col("block").alias(b), "part", F.col("codes").alias(s), F.col("n").alias(f"{s}_n"), F.col("root").alias(f"{s}_root")) for b, s in (("i", "left"), ("j", "right")))
    both = spark.range(whole * blocks).select(F.floor(F.col("id") / blocks).alias("i"), (F.col("id") % blocks).alias("j")).where("i <= j")
    tasks = max(1, min(whole * blocks, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = both.join(one, "i").join(other, ["j", "part"]).repartition(tasks, "i", "j")
    if parts > 1:
        met = met.sortWithinPartitions("i", "j")
    kind = seats.schema["root"].dataType.simpleString()
    schema = f"x {kind}, y {kind}" + ("" if linked else ", common long, least long")
    found = met.mapInArrow(compared(num, den, SIDE, linked), schema)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *([] if linked else ["common", "least"]))


def paired(words: DataFrame, rare: DataFrame, num: int, den: int, linked: bool, seats: DataFrame | None = None, before: int = 0) -> DataFrame:
    """Siblings that the ``rare`` words bring together, without the pairs that :func:`in_blocks` finds among ``seats``, of which
    one is below ``before``.  The candidates' whole sets are intersected, in parts of bounded size where a root is large.
    """
    asks = rare.select(F.col("root").alias("x"), "word", F.col("n").alias("nx"))
    every = words.select(F.col("root").alias("y"), "word", F.col("n").alias("ny"))
    larger = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = asks.join(every, "word").where(larger).select("x", "y", "nx").distinct()
    if seats is not None:
        pairs = pairs.join(seats.toDF("x", "sx"), "x", "left").join(seats.toDF("y", "sy"), "y", "left")
        pairs = pairs.where(F.col("sx").isNull() | F.col("sy").isNull() | (F.least("sx", "sy") >= before)).select("x", "y", "nx")
    pairs = stored(pairs, "root-pairs")
    parts = -(-(words.agg(F.max("n")).first()[0] or 1) // GATHERED)
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")
    sets = words.groupBy("root", part).agg(F.collect_list("word").alias("words"))
    xs, ys = sets.select(F.col("root").alias("x"), "part", F.col("words").alias("wx")), sets.select(F.col("root").alias("y"), "part", F.col("words").alias("wy"))
    common = F.size(F.array_intersect("wx", "wy")).cast("long")
    both = pairs.join(xs, "x").join(ys, ["y", "part"]).select("x", "y", "nx", common.alias("common"))
    if parts > 1:
        both = both.groupBy("x", "y", "nx").agg(F.sum("common").alias("common"))
    found = both.where(F.col("common") * den >= F.col("nx") * num).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", F.col("nx").alias("least"))
    return found.select("a", "b") if linked else found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of nodes with an edge; the label is the least node that edges lead to.

    Labels go to neighbours and then to their labels' labels, so the rounds grow with the logarithm of a
    chain's length; every round is stored, which cuts the plan where an executor's loss can't undo it.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    both = stored(edges.select(F.inline(ways)).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("heard"))
        near = stored(labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("new")), "labels-near")
        hop = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        jumped = stored(near.join(hop, "new", "left").select("node", F.col("label").alias("old"), F.least("new", "beyond").alias("label")), "labels")
        if jumped.where("old <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def related(files: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """(node, label) of roots that have siblings; the label is the least root that siblings lead to.

    Only the first of roots with the same paths is linked; the others have its label.
    """
    rows = stored(files.select("root", "rel").distinct(), "root-paths")
    same = copies(rows)
    found = components(siblings_of_firsts(rows, same, num, den, linked=True)).withColumnRenamed("node", "first")
    alike = (F.col("held") > 1) & (F.col("n") * den >= F.col("n") * num)
    return same.join(found, "first", "left").where(F.col("label").isNotNull() | alike).select(F.col("root").alias("node"), F.coalesce("label", "first").alias("label"))


def groups(files: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """(root, grp, rank): groups of siblings and each root's rank in natural order of its name, from 0."""
    return ranked(related(files, num, den).select(F.col("node").alias("root"), F.col("label").alias("grp")))


def ranked(grouped: DataFrame) -> DataFrame:
    text = F.col("root").cast("string")
    order = W.partitionBy("grp").orderBy(paths.natural_key(text), text)
    return grouped.withColumn("rank", F.row_number().over(order) - 1)


def base(files: DataFrame) -> DataFrame:
    """Files (grp, rank, rel, root) with the root of the nearest lower rank that has the path, and the first
    of all if that isn't their own."""
    order = W.partitionBy("grp", "rel").orderBy("rank")
    first = F.first("root").over(order.rowsBetween(W.unboundedPreceding, 0))
    return files.withColumns({"base": F.lag("root").over(order), "first": F.when(first != F.col("root"), first)})


def base_of(asked: DataFrame, files: DataFrame) -> DataFrame:
    """The same for paths that needn't exist at their rank: asked (grp, rank, rel) with base.

    Both are laid on one line by rank, and each asked row takes the last file before it; no pairs are made.
    """
    line = asked.select("grp", "rel", "rank", F.lit(None).cast(files.schema["root"].dataType).alias("root"), F.lit(True).alias("ask")).union(files.select("grp", "rel", "rank", "root", F.lit(False)))
    before = W.partitionBy("grp", "rel").orderBy("rank").rangeBetween(W.unboundedPreceding, -1)
    return line.withColumn("base", F.last("root", ignorenulls=True).over(before)).where("ask").select("grp", "rank", "rel", "base")


# ---- snapshots


def merge(old: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Old entries (path, value) with the new ones over them and the deleted ones gone, unless new again."""
    o, n = old.select("path", F.col("value").alias("old")), new.select("path", F.col("value").alias("new"), F.lit(True).alias("is_new"))
    gone = deleted.select("path").distinct().withColumn("gone", F.lit(True))
    both = o.join(n, "path", "full_outer").join(gone, "path", "left")
    return both.where(F.col("is_new") | F.col("gone").isNull()).select("path", F.when(F.col("is_new"), F.col("new")).otherwise(F.col("old")).alias("value"))


def missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old paths that the new tree lacks: what an append of a snapshot deletes."""
    return old.select("path").join(new.select("path"), "path", "left_anti")


class BadAppend(ValueError):
    """A delete outside an append, or of a path that isn't there."""


def snapshot(changes: DataFrame, generation: Column | int) -> DataFrame:
    """The tree at a generation, from rows (path, generation, op, value): the last change of each path up to
    it, unless that deletes it."""
    last = changes.where(F.col("generation") <= generation).groupBy("path").agg(F.max_by(F.struct("op", "value"), "generation").alias("c"))
    return last.where("c.op <> 'delete'").select("path", "c.value")


def history(generations: DataFrame) -> DataFrame:
    """Generations, the newest first (pos), with whether each number follows the one before."""
    order = W.orderBy("generation")
    checked = generations.withColumn("follows", F.coalesce(F.col("generation") == F.lag("generation").over(order) + 1, F.lit(True)))
    return checked.withColumn("pos", F.row_number().over(W.orderBy(F.col("generation").desc())) - 1)


def last_committed(generations: DataFrame) -> DataFrame:
    """The last complete generation; later incomplete ones don't count."""
    return generations.where("complete").agg(F.max("generation").alias("generation"))


def rollback(changes: DataFrame, generation: int) -> DataFrame:
    """Changes up to a generation; one above the latest is an error.  Nothing is overwritten."""
    latest = changes.agg(F.max("generation")).first()[0]
    if latest is None or generation > latest:
        raise BadAppend(f"generation {generation} is above the latest, {latest}")
    return changes.where(F.col("generation") <= generation)


def delete(changes: DataFrame, generation: int | None, gone: list[str]) -> DataFrame:
    """Changes with deletions added to an append that is open (its generation); outside one it is an error."""
    if generation is None:
        raise BadAppend("a path is deleted in an append only")
    rows = changes.sparkSession.createDataFrame([(p, generation, "delete", None) for p in gone], changes.select("path", "generation", "op", "value").schema)
    return changes.select("path", "generation", "op", "value").unionByName(rows)


def chunk_status(files: DataFrame) -> DataFrame:
    """Files (grp, rank, rel, hash) against their base: unchanged, changed or new."""
    order = W.partitionBy("grp", "rel").orderBy("rank")
    before = F.lag("hash").over(order)
    return files.withColumn("status", F.when(before.isNull(), "new").when(before == F.col("hash"), "unchanged").otherwise("changed"))


def is_stale(asked: Column, current: Column) -> Column:
    """Whether a request was made against an older view."""
    return asked < current
