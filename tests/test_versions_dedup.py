"""Versions, generations and deduplication: worked examples, and a model of generations."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import dedup, versions
from granary.plans import catalogue
from granary.sources import sinks


def tree(spark, **roots):
    return spark.createDataFrame([(r, str(f)) for r, fs in roots.items() for f in fs], "root string, rel string")


def test_siblings(spark):
    files = tree(spark, a="1234", b="12xy", c="1pqr")
    assert [(r["a"], r["b"]) for r in versions.siblings(files).collect()] == [("a", "b")]
    chain = versions.groups(tree(spark, a="12", b="23", c="34"))
    assert sorted((r["root"], r["grp"], r["rank"]) for r in chain.collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


@pytest.mark.parametrize(("gathered", "num", "den"), [(50_000, 1, 2), (7, 1, 2), (3, 4, 5), (50_000, 1, 10)])
def test_siblings_are_all_pairs_that_share_enough(spark, monkeypatch, gathered, num, den):
    """Roots of many sizes, with paths that all of them have and paths that few do, against all pairs."""
    monkeypatch.setattr(versions, "GATHERED", gathered)
    rng = random.Random(gathered + num)
    kinds = [rng.sample(range(60), 25) for _ in range(6)]
    roots = {f"r{i}": {0, 1, *rng.sample(rng.choice(kinds), rng.randrange(0, 25)), *(1000 + rng.randrange(300) for _ in range(rng.randrange(4)))} for i in range(60)}
    files = spark.createDataFrame([(r, str(f)) for r, fs in roots.items() for f in fs] * 2, "root string, rel string")
    want = set()
    for a in roots:
        for b in roots:
            common, least = len(roots[a] & roots[b]), min(len(roots[a]), len(roots[b]))
            if a < b and common * den >= least * num:
                want.add((a, b, common, least))
    assert {tuple(r) for r in versions.siblings(files, num, den).collect()} == want and len(want) > 20
    assert versions.siblings(files.limit(0)).count() == 0


def test_roots_with_the_same_paths(spark):
    """All pairs of copies and of their siblings; their groups without making these pairs."""
    sets = {"a": "1234", "b": "12xy", "c": "1pqr", "d": "mn", "e": "z"}
    roots = {f"{name}{i}": set(paths) for name, paths in sets.items() for i in range(1 if name == "e" else 3)}
    files = tree(spark, **roots)
    want = set()
    for a in roots:
        for b in roots:
            common, least = len(roots[a] & roots[b]), min(len(roots[a]), len(roots[b]))
            if a < b and common * 2 >= least:
                want.add((a, b, common, least))
    assert {tuple(r) for r in versions.siblings(files).collect()} == want and len(want) == 12 + 9
    label = lambda r: {"b": "a"}.get(r[0], r[0]) + "0"
    assert {tuple(r) for r in versions.related(files).collect()} == {(r, label(r)) for r in roots if r != "e0"}
    many = spark.range(30_000).select(F.concat(F.lit("r"), "id").alias("root"), F.explode(F.array(*[F.lit(str(i)) for i in range(20)])).alias("rel"))
    assert versions.groups(many).agg(F.count("*"), F.min("grp"), F.max("grp"), F.max("rank")).first()[:] == (30_000, "r0", "r0", 29_999)


def shared(roots, num, den):
    """All pairs that share enough, one by one."""
    names = sorted(roots)
    pairs = ((a, b, len(roots[a] & roots[b]), min(len(roots[a]), len(roots[b]))) for i, a in enumerate(names) for b in names[i + 1 :])
    return {p for p in pairs if p[2] and p[2] * den >= p[3] * num}


@pytest.mark.parametrize(("held", "num", "den", "limit"), [(500_000, 1, 2, 0.0), (40, 11, 20, 100.0)])
def test_siblings_by_blocks(spark, monkeypatch, held, num, den, limit):
    """Blocks of few roots, and of parts of their paths, find the same: for all paths, or for those that bring together more
    than 100 pairs, beside roots that share rare paths alone."""
    rng = random.Random(held + num)
    roots = {f"d{i:02}": set(rng.sample(range(40), rng.randrange(8, 22))) for i in range(40)}
    roots |= {f"e{i:02}": {100 + i // 3, *rng.sample(range(200, 230), rng.randrange(1, 4))} for i in range(30)}
    roots |= {"f0": {0, *range(300, 330)}, "f1": {300}, "f2": set(range(300, 320))}
    files = spark.createDataFrame([(r, str(f)) for r, fs in roots.items() for f in fs], "root string, rel string")
    want, left = shared(roots, num, den), []

    def split(weights, marks, total):
        left.append(weights.where(F.col("weight") <= limit).agg(F.sum("weight")).first()[0] or 0.0)
        return limit, left[-1], marks.where(F.col("asked") > limit).count()

    for name, value in {"SIDE": 16, "HELD": held, "PAIRED": 0, "cheapest": split}.items():
        monkeypatch.setattr(versions, name, value)
    assert {tuple(r) for r in versions.siblings(files, num, den).collect()} == want and len(want) > 20
    label = {r: r for p in want for r in p[:2]}
    while any(label[a] != label[b] for a, b, *_ in want):
        for a, b, *_ in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r) for r in versions.related(files, num, den).collect()} == set(label.items())
    assert all(x > 0 for x in left) == (limit > 0)


def test_many_roots_that_share_few_paths(spark):
    """6,000 different roots of 60 paths each out of 155 have 10^8 pairs by their rarest paths: they are counted by blocks."""
    rng = np.random.default_rng(5)
    has = rng.random((6000, 155)) < 60 / 155
    files = spark.createDataFrame(pd.DataFrame(dict(zip(("root", "rel"), (x.astype("int64") for x in np.nonzero(has)), strict=True))))
    n, common = has.sum(1), has.astype("float32") @ has.T.astype("float32")
    a, b = np.nonzero(np.triu(common * 2 >= np.minimum(n[:, None], n[None, :]), 1))
    found = versions.siblings(files).agg(F.count("*"), *[F.sum(x) for x in ("a", "b", "common", "least")], F.sum(F.col("a") * F.col("common"))).first()
    c, least = common[a, b].astype("int64"), np.minimum(n[a], n[b])
    assert found[:] == (len(a), a.sum(), b.sum(), c.sum(), least.sum(), (a * c).sum()) and len(a) > 100_000


def test_groups_of_many_roots_make_no_pairs(spark, monkeypatch):
    """1,000 different roots that share few paths are grouped without pairs by path."""
    monkeypatch.setattr(versions, "paired", None)
    has = np.random.default_rng(6).random((1000, 155)) < 60 / 155
    files = spark.createDataFrame(pd.DataFrame(dict(zip(("root", "rel"), (x.astype("int64") for x in np.nonzero(has)), strict=True))))
    n, common, label = has.sum(1), has.astype("float32") @ has.T.astype("float32"), np.arange(1000)
    near = common * 20 >= np.minimum(n[:, None], n[None, :]) * 11
    for _ in range(1000):
        label = np.where(near, label[None, :], 1000).min(1)
    grouped = near.sum(1) > 1
    want = {(int(r), int(label[r]), int((grouped & (label == label[r]))[:r].sum())) for r in np.flatnonzero(grouped)}
    assert {tuple(r) for r in versions.groups(files, 11, 20).collect()} == want and len(want) > 500


def test_links_are_made_once(spark, tmp_path):
    """What makes the edges runs once for both directions."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long").mapInArrow(count, "a long, b long")
    assert {tuple(r) for r in versions.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)} and made.value == 3


def test_base_and_first(spark):
    rows = [(0, r, root, rel) for r, (root, rels) in enumerate([("a", "12"), ("b", "13"), ("c", "12")]) for rel in rels]
    files = spark.createDataFrame(rows, "grp int, rank int, root string, rel string")
    got = {(r["root"], r["rel"]): (r["base"], r["first"]) for r in versions.base(files).collect()}
    assert got["c", "2"][0] == "a" and got["c", "1"] == ("b", "a") and got["a", "1"] == (None, None)
    asked = spark.createDataFrame([(0, 1, "2"), (0, 0, "2")], "grp int, rank int, rel string")
    assert {r["rank"]: r["base"] for r in versions.base_of(asked, files).collect()} == {1: "a", 0: None}


def test_generations_against_a_model(spark):
    rng = random.Random(7)
    rows, model, states = [], {}, []
    for g in range(6):
        for name in rng.sample("abcde", 3):
            if name in model and rng.random() < 0.4:
                del model[name]
                rows.append((name, g, "delete", None))
            else:
                model[name] = rng.randrange(100)
                rows.append((name, g, "put", model[name]))
        states.append(dict(model))
    changes = spark.createDataFrame(rows, "path string, generation int, op string, value long")
    for g, want in enumerate(states):
        assert {r["path"]: r["value"] for r in versions.snapshot(changes, g).collect()} == want
        back = versions.rollback(changes, g)
        assert {r["path"]: r["value"] for r in versions.snapshot(back, 99).collect()} == want
    with pytest.raises(versions.BadAppend):
        versions.rollback(changes, 6)
    with pytest.raises(versions.BadAppend):
        versions.delete(changes, None, ["a"])
    assert "a" not in {r["path"] for r in versions.snapshot(versions.delete(changes, 6, ["a"]), 6).collect()}


def test_merge_keeps_a_deleted_path_that_is_new(spark):
    frame = lambda **v: spark.createDataFrame(list(v.items()), "path string, value long")
    got = versions.merge(frame(a=1, b=2, c=3), frame(b=20, c=30), frame(a=0, c=0))
    assert {r["path"]: r["value"] for r in got.collect()} == {"b": 20, "c": 30}


def test_history_and_commits(spark):
    found = versions.history(spark.createDataFrame([(1,), (2,), (4,)], "generation int")).orderBy("pos").collect()
    assert [(r["generation"], r["follows"]) for r in found] == [(4, False), (2, True), (1, True)]
    torn = spark.createDataFrame([(1, True), (2, True), (3, False)], "generation int, complete boolean")
    assert versions.last_committed(torn).first()[0] == 2


def corpus(spark):
    a, other = "a" * 3000, "b" * 2000
    return spark.createDataFrame([("one", "1", a), ("one", "2", a), ("one", "3", "x" + a), ("two", "1", a), ("two", "2", other), ("two", "3", "")], "class string, path string, content string")


def test_savings(spark):
    files = corpus(spark)
    chunks = dedup.fixed_chunks(files, 1024, ("class", "path"))
    rows = files.select("class", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))
    got = {r["class"]: r for r in dedup.savings(rows, chunks).collect()}
    assert (got["one"]["files"], got["one"]["dup_files"], got["two"]["dup_files"], got["(corpus)"]["dup_files"]) == (3, 1, 0, 2)
    assert got["(corpus)"]["unique_chunks"] < got["one"]["unique_chunks"] + got["two"]["unique_chunks"]
    assert dedup.consistency(dedup.savings(rows, chunks)).count() == 0


def test_growth_adds_up(spark):
    versions_ = [(0, "v1"), (1, "v1 tail"), (2, "v1 tail more")]
    rows = [(r, "".join(f"{w:<1024}" for w in t.split())) for r, t in versions_]
    chunks = dedup.fixed_chunks(spark.createDataFrame(rows, "rank int, content string"), 1024, ("rank",))
    got = dedup.growth(chunks).orderBy("rank").collect()
    assert [r["new_chunks"] for r in got] == [1, 1, 1] and got[-1]["bytes"] == 3 * 1024


def test_blocks_close_before_they_overflow(spark):
    sizes = [5, 5, 1, 9, 20, 3]
    chunks = spark.createDataFrame([("c", i, n) for i, n in enumerate(sizes)], "cluster string, chunk long, len long")
    got = sorted(tuple(r) for r in dedup.pack_blocks(chunks, 10).collect())
    assert got == [("c", 0, 0, 2, 10), ("c", 1, 2, 2, 10), ("c", 2, 4, 1, 20), ("c", 3, 5, 1, 3)]


def test_container_keeps_generations(spark, tmp_path):
    path = str(tmp_path / "c")
    for g, texts in enumerate([{"a": "xx", "b": "yy"}, {"a": "xx", "c": "zz"}], 1):
        rows = spark.createDataFrame(list(texts.items()), "path string, content string")
        chunks = dedup.fixed_chunks(rows, 1, ("path",))
        sinks.write_container(path, g, rows.select("path"), chunks.select("path", "pos", "hash"), chunks.select("hash", "content").dropDuplicates(["hash"]))
    for g, want in ((1, {"a": "xx", "b": "yy"}), (None, {"a": "xx", "c": "zz"})):
        _, members, blobs = sinks.read_container(spark, path, g)
        assert {r["path"]: r["content"] for r in sinks.extract(members, blobs.dropDuplicates(["hash"])).collect()} == want
    with pytest.raises(ValueError, match="no generation 9"):
        sinks.read_container(spark, path, 9)


def test_every_query_has_its_columns(spark, small):
    names = set(catalogue.queries())
    assert set(catalogue.oracle_sql()) <= names and len(names) > 150
    assert catalogue.flagship(spark, small).count() == 50
