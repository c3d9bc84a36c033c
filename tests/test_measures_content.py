"""Measurements and byte-level functions: worked examples."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import content
from granary.operators import measures as ops
from granary.plans.catalogue import queries


def one(spark, values, kind, agg):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}").agg(agg(F.col("x"))).first()[0]


def test_medians(spark):
    big = 2**53 + 1
    groups = {"a": [1, 2], "b": [big, big], "c": [None], "d": [3, 1, 2, None], "e": [2**63 - 1, 2**63 - 1], "f": [-3, -2], None: [5, 5, 5, 7, 9]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x long")
    assert {r["g"]: r["x"] for r in ops.medians_whole(frame, ["g"], ["x"]).collect()} == {"a": 1, "b": big, "c": 0, "d": 2, "e": 2**63 - 1, "f": -3, None: 5}
    assert [one(spark, v, "double", ops.median_double) for v in ([1.0, 2.0], [], [5.0])] == [1.5, 0.0, 5.0]
    assert [one(spark, v, "long", ops.median_if_all) for v in ([1, None], [1, 3])] == [None, 2.0]


def rows(spark, values):
    return spark.createDataFrame(values, "tool string, setting string, class string, value double")


def test_compare(spark):
    a = rows(spark, [("t", "s", "c", 100.0), ("t", "s", "d", 100.0)])
    for factor, pct, ok in ((1.0, 0.0, True), (1.02, 2.0, True), (1.05, 5.0, False)):
        r = ops.compare(a, a.withColumn("value", F.col("value") * factor)).first()
        assert r["state"] == "both" and r["pct"] == pytest.approx(pct) and r["within"] == ok
    zero = rows(spark, [("t", "s", "c", 0.0)])
    assert ops.compare(zero, zero).first()["pct"] == 0 and ops.compare(zero, a).first()["pct"] == float("inf")
    assert ops.compare(a, a.limit(0)).first()["state"] == "only a"


def test_blend_is_never_partial(spark):
    measured = spark.createDataFrame([("x", "a", 50.0, 10.0), ("x", "b", 100.0, 30.0), ("y", "a", 10.0, 10.0)], "tool string, class string, size_pct double, mbps double")
    mix = spark.createDataFrame([("a", 50), ("b", 50)], "class string, weight int")
    (r,) = ops.blend(measured, mix, ["tool"]).collect()
    assert r["tool"] == "x" and r["size_pct"] == 75 and r["mbps"] == pytest.approx(15.0)


def test_first_row_wins_ties(spark):
    frame = spark.createDataFrame([("c", "t1", "s", 5, 2), ("c", "t2", "s", 5, 1), ("c", "t3", "s", 9, 0)], "class string, tool string, setting string, archive_bytes long, ord long")
    assert ops.best(frame).first()["tool"] == "t2"


def test_gates(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 9.0)], "gate string, v double")
    gates = frame.select("gate", ops.gate(F.col("v"), 5.0).alias("state"))
    assert [r["state"] for r in gates.collect()] == ["PASS", "not evaluable", "FAIL"]
    assert ops.verdict(gates).first()[0] == "NO-GO: failing gates: c; open gates: b"
    assert ops.verdict(gates.where("state = 'PASS'")).first()[0] == "GO"


def test_lineage(spark):
    frame = spark.range(1).select(ops.traced(F.lit(6.0), F.array(F.lit(2))).alias("a"), ops.traced(F.lit(3.0), F.array(F.lit(7))).alias("b"))
    r = frame.select(ops.combined(F.col("a"), F.col("b"), F.col("a.value") / F.col("b.value") + 6).alias("c")).first()["c"]
    assert (r["value"], r["sources"]) == (8.0, [2, 7])
    shown = lambda xs: spark.createDataFrame([(xs,)], "s array<int>").select(ops.bracketed(F.col("s"))).first()[0]
    assert [shown(x) for x in ([1, 3, 4, 5, 9], [1, 2], [4])] == ["[1,3-5,9]", "[1,2]", "[4]"]


def test_merkle_proofs(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [h(str(i)) for i in range(5)]
    tree = ops.merkle(spark.createDataFrame(list(enumerate(leaves)), "i long, hash string"))
    root = tree.orderBy(F.col("level").desc()).first()["hash"]
    for i, leaf in enumerate(leaves):
        at = leaf
        for r in ops.proof(tree, i).orderBy("level").collect():
            at = h(r["hash"] + at if r["left"] else at + r["hash"])
        assert at == root


def test_unknown_source_is_an_error(spark):
    locks = spark.createDataFrame([("s", 1), ("z", 2)], "source string, bytes long")
    sources = spark.createDataFrame([("s", "c")], "source string, class string")
    with pytest.raises(ops.UnknownSource, match="z"):
        ops.two_level(locks, sources, sources.select("class"))


def test_entropy_gate():
    noise = random.Random(1).randbytes(1 << 20)
    hollow = b"".join(b"\0" * 4096 + noise[i + 4096 : i + 65536] for i in range(0, 1 << 20, 65536))
    assert [content.is_incompressible(x) for x in (b"\0" * (1 << 20), noise, b"", hollow)] == [False, True, False, False]
    assert content.entropy_of(bytes(range(256))) == 8 and content.entropy_of(b"aaaa") == 0


def test_chunks_cover_and_follow_content():
    data = random.Random(3).randbytes(200_000)
    sizes = (512, 4096, 16384)
    cuts = content.cut_points(data, *sizes)
    lengths = [b - a for a, b in zip([0, *cuts], cuts)]
    assert cuts[-1] == len(data) and max(lengths) <= 16384 and min(lengths[:-1]) >= 512
    moved = content.cut_points(b"some bytes before" + data, *sizes)
    assert len({c - 17 for c in moved} & set(cuts)) > 0.8 * len(cuts)
    assert content.cut_points(b"") == [] and content.cut_points(b"abc") == [3]


def test_base64_runs():
    raw = random.Random(4).randbytes(300)
    wrapped = base64.b64encode(raw)
    lines = b"\n".join(wrapped[i : i + 76] for i in range(0, len(wrapped), 76))
    assert content.base64_runs(b"head: " + lines + b" tail") == [(6, len(lines), 300)]
    assert content.base64_runs(b"head: " + wrapped[:100] + b"\n" + wrapped[100:] + b"!") == []
    assert content.base64_runs(b"x" * 255) == [] and content.base64_runs(b"") == []


def test_patches_apply():
    rng = random.Random(5)
    old = rng.randbytes(5000)
    new = old[:1000] + b"inserted" + old[1000:3000] + old[3500:]
    patch = content.delta_encode(old, new)
    assert content.delta_apply(old, patch) == new and len(patch) < 300
    assert content.delta_apply(b"", content.delta_encode(b"", b"abc")) == b"abc"
    with pytest.raises(ValueError):
        content.delta_apply(b"", b"C" + (0).to_bytes(8, "big") + (5).to_bytes(4, "big"))


def test_udfs_take_nulls(spark):
    frame = spark.createDataFrame([(None,), (bytearray(b"abc"),)], "content binary")
    got = frame.select(content.classify("content").alias("c"), content.entropy("content").alias("e"), content.container_format("content").alias("f"), content.trial("content").alias("t")).collect()
    assert [r["c"] for r in got] == ["other", "text"] and got[0]["e"] is None


def test_streams_end_with_the_tables_answer(spark, small):
    from granary.plans import stream_queries  # noqa: F401
    from granary.plans.registry import QUERIES, table

    docs = table(spark, small, "documents")
    assert QUERIES["str_new_chunks"](spark, small).count() == docs.select("text").distinct().count()


def test_growth_keeps_the_sign_of_zero(spark, tmp_path):
    """Negative keys make a negative zero in SQL: 0 * 100.0 / -3."""
    spark.createDataFrame([(-3, -3), (3, 3), (0, 0), (7, 5), (None, 1), (-3, 8)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = queries()["agg_growth_pct"](spark, str(tmp_path)).collect()
    assert sorted((str(r["id"]), str(r["pct"])) for r in rows) == [("-3", "-0.0"), ("-3", "-366.666666667"), ("0", "0.0"), ("3", "0.0"), ("7", "inf"), ("None", "None")]
