"""The catalogue's worked examples."""

import random
import re
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from granary.functions import globs, paths
from granary.operators import catalog as ops
from granary.sources import sinks, walk

ROWS = [(0, "a", "Directory", 0), (1, "a-b.txt", "File", 5), (2, "a/x.txt", "File", 3), (3, "a/y", "Directory", 0), (4, "a/y/z.bin", "File", 9), (5, "q/orphan.txt", "File", 1)]


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(ROWS, "id long, path string, kind string, size long").withColumns({"mtime_ns": F.col("size"), "flags": F.lit(0)})


def ids(df):
    return [r["id"] for r in df.collect()]


def test_parents_and_children(spark, listing):
    assert {r["id"]: r["parent"] for r in ops.parents(listing).collect()} == {0: -1, 1: -1, 2: 0, 3: 0, 4: 3, 5: -1}
    assert sorted(ids(ops.children(listing, 0))) == [2, 3] and ids(ops.children(listing, 3)) == [4]
    assert {r["parent"]: r["children"] for r in ops.child_counts(listing).collect()} == {-1: 3, 0: 2, 3: 1}
    loose = spark.createDataFrame([(0, "d/f", "File"), (1, "d", "Directory"), (2, "e", "File")], "id long, path string, kind string")
    assert {r["id"]: r["parent"] for r in ops.parents(loose).collect()} == {0: 1, 1: -1, 2: -1}
    assert sorted((r["id"], r["level"], r["folder"]) for r in ops.crumbs(listing).collect()) == [(2, 0, 0), (3, 0, 0), (4, 0, 0), (4, 1, 3)]


def test_views(listing):
    assert [r["id"] for r in ops.view(listing, "size", True).orderBy("pos").collect()] == [4, 1, 2, 5, 0, 3]
    assert ids(ops.page(listing, "size", True, 1, 2)) == [1, 2] and ids(ops.page(listing, "size", True, 5, 9)) == [3]
    assert ids(listing.where(paths.contains_ascii(F.col("path"), "TXT"))) == [1, 2, 5]
    assert [r["id"] for r in ops.view(listing, "kind", True).orderBy("pos").collect()] == [4, 2, 5, 1, 3, 0]
    assert sorted(ids(ops.picked_range(ops.view(listing), 3, 1))) == [1, 2, 3]


def test_totals(spark, listing):
    picks = spark.createDataFrame([(2,), (4,), (99,)], "id long")
    assert tuple(map(int, ops.totals(listing, picks).first())) == (6, 4, 2, 18, 2, 12)
    huge = spark.createDataFrame([(0, "x", "File", "18446744073709551615"), (1, "y", "File", "7")], "id long, path string, kind string, s string").withColumn("size", F.col("s").cast("decimal(20,0)"))
    assert str(ops.totals(huge).first()["bytes"]) == ops.MOST
    assert tuple(map(int, ops.totals(listing.limit(0)).first())) == (0,) * 6
    assert int(ops.picked_closed_bytes(listing, spark.createDataFrame([(0,), (2,)], "id long")).first()["bytes"]) == 12


FARM = ["barn", "barn/hay.csv", "barn/loft", "barn/loft/owl.dat", "field/oats.csv", "rye.csv", "Barn", "50%?.csv", "field/oats.csv.old"]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("barn", FARM[:4]),  # an entry takes along what is below it
        ("barn/loft", FARM[2:4]),
        ("barn\\loft", FARM[2:4]),  # either separator
        ("barn/*", FARM[1:4]),  # what is in the folder, not the folder
        ("barn/**", FARM[1:4]),
        ("*.csv", ["rye.csv", "50%?.csv"]),  # a star stays within a name
        ("**/*.csv", ["barn/hay.csv", "field/oats.csv", "rye.csv", "50%?.csv"]),
        ("fi?ld/*", ["field/oats.csv", "field/oats.csv.old"]),
        ("BARN", []),  # case counts
        ("50%[?].csv", ["50%?.csv"]),  # in brackets a sign stands for itself
        ("{rye,field/oats}.csv", ["field/oats.csv", "rye.csv"]),
    ],
)
def test_globs(spark, pattern, want):
    frame = spark.createDataFrame([(p,) for p in FARM], "path string")
    assert [r["path"] for r in frame.where(ops.glob_subtree(F.col("path"), [pattern])).collect()] == want


@pytest.mark.parametrize("pattern", ["", "/barn", "\\barn", "barn[a-", "{rye,oats"])
def test_refused_globs(pattern):
    with pytest.raises(globs.GlobError):
        globs.to_regex(pattern)


def test_a_pattern_without_entries_is_an_error_that_names_it(spark):
    frame = spark.createDataFrame(list(enumerate(FARM)), "id long, path string")
    with pytest.raises(ops.Unmatched, match="wheat"):
        ops.select(frame, ["rye.csv", "wheat*", "barn"])
    assert sorted(ids(ops.select(frame, ["rye.csv", "barn/l*"]))) == [2, 3, 5]


def by_numbers(a, b):
    """Runs in pairs: two numbers by value, others by their bytes; then the fewer runs, then the text."""
    x, y = re.findall(r"[0-9]+|[^0-9]+", a), re.findall(r"[0-9]+|[^0-9]+", b)
    for p, q in zip(x, y):
        left, right = (int(p), int(q)) if p[0].isdigit() and q[0].isdigit() else (p.encode(), q.encode())
        if left != right:
            return -1 if left < right else 1
    return len(x) - len(y) or (a > b) - (a < b)


def test_natural_order(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("ab.é /0019") for _ in range(rng.randrange(9))) for _ in range(400)} | {"r" + "9" * 25, "r5", "r1" + "0" * 25, "r1" + "0" * 24 + "1"})
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in frame.orderBy(paths.natural_key(F.col("n")), "n").collect()] == sorted(names, key=cmp_to_key(by_numbers))


def test_unsafe_paths(spark):
    rows = [("x" * 255, None), ("x" * 256, "name too long"), ("d/" * 16382 + "xx", None), ("d/" * 16383 + "x", "path too long"), ("dd/" * 10923, "path too long"), ("a/ COM5", None), ("a/COM5 .x", "reserved device name"), ("..a", None), ("a<|>", None), ("t ", "trailing dot or space")]
    frame = spark.createDataFrame(rows, "p string, want string").withColumn("got", paths.unsafe(F.col("p")))
    assert [(r["p"][:9], r["got"]) for r in frame.collect()] == [(p[:9], w) for p, w in rows]
    assert frame.select(paths.unsafe(F.col("p"), 32_600).alias("f")).collect()[0]["f"] == "path too long"


def test_link_targets(spark):
    rows = [
        ("a/b", "c", "a/c", None), ("a/b", "../c/./d//", "c/d", None), ("a/b", "..", "", None), ("a/b", "../..", None, "leaves the tree"), ("a", None, None, "empty"),
        ("a/b/c", "../x/../y", None, "climbs after a name"), ("a", "n\x00", None, "nul"), ("a", "~/x", "~/x", None), ("a/b", "é/ü", "a/é/ü", None),
    ]
    frame = spark.createDataFrame(rows, "l string, t string, want string, why string")
    to, why = paths.link_target(F.col("l"), F.col("t"))
    assert [tuple(r) for r in frame.select("l", "t", to, why).collect()] == rows


def test_projections(spark):
    one = lambda e, t, v: spark.createDataFrame([(v,)], f"v {t}").select(e(F.col("v"))).first()[0]
    assert [one(paths.iso_time, "long", v) for v in (-1, 4102444800 * 10**9, None, 0)] == ["1969-12-31T23:59:59Z", "2100-01-01T00:00:00Z", None, "1970-01-01T00:00:00Z"]
    assert [one(paths.flag_letters, "int", v) for v in (0, 9, 15)] == ["----", "x--s", "xhrs"]
    assert [one(paths.extension, "string", v) for v in ("a/b.TXT", ".hidden", "README", "a.tar.gz", "x.d/y")] == ["txt", "", "", "gz", ""]
    assert one(paths.escaped, "string", "a\\b\t\n\x01é") == "a\\\\b\\t\\n\\x01é"
    assert [one(paths.path_fault, "string", v) for v in ("", "/a", "a//b", "a/..", "ok")] == ["empty", "absolute", "empty component", "dot component", None]


def test_extension_order(spark):
    names = ["z/b.TXT", "b/a.txt", "m/README", "a/a.c", "a/b.txt", ".hidden"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    p = F.col("path")
    assert [r["path"] for r in frame.orderBy(paths.extension(p), F.lower(paths.name(p)), p).collect()] == [".hidden", "m/README", "a/a.c", "b/a.txt", "a/b.txt", "z/b.TXT"]


def test_free_names(spark):
    taken = spark.createDataFrame([("a.txt",), ("a (1).txt",), ("a (3).txt",), ("b",)], "path string")
    wanted = spark.createDataFrame([("a.txt",), ("b",), ("c.md",)], "path string")
    assert {r["path"]: r["free"] for r in ops.free_name(wanted, taken).collect()} == {"a.txt": "a (2).txt", "b": "b (1)", "c.md": "c.md"}


def test_fingerprint_sees_order(spark, listing):
    swapped = listing.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")))
    assert ops.fingerprint(listing).first() == ops.fingerprint(listing.repartition(3)).first() != ops.fingerprint(swapped).first()


def test_walk_lists_and_sinks(spark, tmp_path, listing):
    for name in ("a/x.txt", "b.md", "a/.git/y"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted((r["path"], r["size"]) for r in walk.walk(spark, str(tmp_path), ("**/.git/**",)).collect()) == [("a/x.txt", 7), ("b.md", 4)]
    with pytest.raises(walk.Duplicate, match="a-b"):
        walk.checked(listing.union(listing.where("id = 1")))
    lines = [r["line"] for r in sinks.json_lines(listing.where("id = 1")).collect()]
    assert lines == ['{"path":"a-b.txt","kind":"File","size":5,"mtime_ns":5,"flags":0}']
    assert sinks.markdown(spark.createDataFrame([("a|b", 1)], "k string, n int")) == "| k | n |\n|---|---|\n| a\\|b | 1 |"


def test_same_answer_for_any_number_of_partitions(spark, listing):
    results = [[tuple(r) for r in ops.view(listing.repartition(n), "name").orderBy("pos").collect()] for n in (1, 2, 7)]
    assert results[0] == results[1] == results[2]
