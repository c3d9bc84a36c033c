"""Queries over whole tables against plain Python."""

import hashlib
import json
from collections import Counter

from granary.functions import content
from granary.plans import measure_queries
from granary.plans.catalogue import queries


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_merkle_of_all_documents(spark, small):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level, want, at = [h(r["text"]) for r in documents(spark, small).orderBy("doc_id").collect()], [], 0
    while True:
        want += [(at, i, x) for i, x in enumerate(level)]
        if len(level) == 1:
            break
        level = [h(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        at += 1
    assert sorted(map(tuple, queries()["agg_merkle"](spark, small).collect())) == want


def test_delta_of_all_neighbours(spark, small):
    texts = {r["doc_id"]: r["text"].encode() for r in documents(spark, small).collect()}
    want = {i: len(content.delta_encode(texts[i - 1], t)) for i, t in texts.items() if i - 1 in texts}
    got = queries()["dom_delta"](spark, small).collect()
    assert len(got) == len(want) > 100 and {r["doc_id"]: r["patch_bytes"] for r in got} == want and all(r["exact"] for r in got)


def test_manifests_of_all_documents(spark, small):
    docs = documents(spark, small).collect()
    total = Counter()
    for r in docs:
        total[r["lang"]] += r["n_chars"]
    want = sorted((r["lang"], total[r["lang"]], r["n_chars"], str(r["doc_id"]), r["source"]) for r in docs)
    assert sorted(map(tuple, queries()["src_manifest"](spark, small).collect())) == want
    sizes = [len(c["files"]) for r in measure_queries.manifest_rows(documents(spark, small), 7).collect() for c in json.loads(r["json"]).values()]
    assert max(sizes) <= 7 and sum(sizes) == len(docs)


def test_formats_far_into_the_content(spark):
    rows = [(1, bytearray(b"x" * 32769 + b"CD001" + b"x" * 9)), (2, bytearray(b"x" * 40000)), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, content binary").select("doc_id", content.container_format("content").alias("format"))
    assert {r["doc_id"]: r["format"] for r in frame.collect()} == {1: "iso", 2: None, 3: None}
