"""Recovery shards: any loss that can be made good is, and nothing else is passed off as whole."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import recovery
from granary.plans.catalogue import queries


def test_the_field():
    product, inverse = recovery.tables()
    rng = random.Random(1)
    for _ in range(300):
        a, b, c = (rng.randrange(256) for _ in range(3))
        x, r = a, 0
        for i in range(8):  # product by shifts
            r ^= x if b >> i & 1 else 0
            x = x << 1 ^ (0x11D if x & 0x80 else 0)
        assert product[a, b] == r and product[a, b ^ c] == product[a, b] ^ product[a, c]
        assert a == 0 or product[a, inverse[a]] == 1


@pytest.mark.parametrize(("data", "made"), [(1, 1), (5, 2), (20, 4), (200, 40)])
def test_any_loss_up_to_the_recovery_shards_is_rebuilt(data, made):
    rng = np.random.default_rng(data)
    shards = rng.integers(0, 256, (data, 96), np.uint8)
    extra = recovery.encode(shards, made)
    for _ in range(10):
        lost = sorted(rng.choice(data, min(data, rng.integers(1, made + 1)), replace=False).tolist())
        left = rng.choice(made, len(lost), replace=False).tolist()  # the other recovery shards are lost too
        damaged = shards.copy()
        damaged[lost] = 0
        assert (recovery.rebuild(damaged, lost, {i: extra[i] for i in left}, made) == shards[lost]).all()
    with pytest.raises(ValueError):
        recovery.rebuild(shards, [0], {}, made)


def test_files_are_mended(spark):
    rng = random.Random(3)
    files = [("a", rng.randbytes(1000)), ("b", rng.randbytes(64)), ("c", b"x"), ("none", b""), ("null", None), ("frame", rng.randbytes(300)), ("gone", rng.randbytes(640))]
    frame = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], "path string, content binary")
    shards = recovery.shards_of(frame, 64, 8)
    frames = recovery.protect(shards, 20).withColumn("hash", F.when(F.col("path") == "frame", "x").otherwise(F.col("hash")))
    lost = shards.where("not (path = 'a' and shard in (1, 6)) and not (path = 'c') and not (path = 'gone' and grp = 0 and shard < 3)")
    lost = lost.withColumn("data", F.when((F.col("path") == "b") & (F.col("shard") == 0), F.lit(b"other")).otherwise(F.col("data")))
    seen = {(r["path"], r["grp"]): (r["usable"], r["shards"], r["damaged"]) for r in recovery.scan(frames, lost).collect()}
    assert seen == {("a", 0): (True, 8, 2), ("a", 1): (True, 8, 2), ("b", 0): (True, 1, 1), ("c", 0): (True, 1, 1), ("frame", 0): (False, 5, 0), ("gone", 0): (True, 8, 3), ("gone", 1): (True, 2, 0)}
    rows = recovery.repair(frames, lost).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["grp"], r["shard"])):
        whole.setdefault(r["path"], []).append((r["state"], r["data"]))
    for path, content in files:
        if path in ("a", "b", "c"):
            assert b"".join(bytes(d) for _, d in whole[path]) == content and {s for s, _ in whole[path]} <= {"whole", "rebuilt"}
    assert {s for s, _ in whole["frame"]} == {"unknown"} and [s for s, _ in whole["gone"]].count("lost") == 3 and "none" not in whole
    with pytest.raises(ValueError):
        recovery.protect(shards, 21)


def test_groups_are_encoded_together_as_one_by_one():
    rng = random.Random(5)
    groups = [[rng.randbytes(rng.choice((1, 33, 64))) for _ in range(rng.choice((1, 7, 20)))] for _ in range(60)]
    for group, made in zip(groups, recovery.encoded(groups, 10)):
        want = recovery.encode(recovery.padded(group, max(map(len, group))), max(1, -(-len(group) // 10)))
        assert made == [r.tobytes() for r in want]


def test_a_long_text_is_mended_whole(spark, tmp_path):
    """Putting its 131,072 shards together must not copy what is there for each of them."""
    text = "".join(random.Random(6).choices("abcdefgh", k=1 << 23))
    spark.createDataFrame([(1, text), (2, ""), (3, None), (10, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["path"]: r[1:] for r in queries()["dom_recovery"](spark, str(tmp_path)).collect()}
    assert got == {1: (1 << 17, 1 << 13, 0, 0, hashlib.sha256(text.encode()).hexdigest()), 10: (1, 0, 0, 1, None)}
