"""The pipeline's stages on the small table, each against what it was given."""

from collections import Counter

import corpus_pipeline
from granary.llm.common import stored
from tests.llm.test_neardup_repeats import brute
from tests.llm.test_tokens import check_pieces, direct  # noqa: F401


def test_stages(spark, small, direct):  # noqa: F811
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, small), f"test-{name}")
        seen[name] = given.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    given, left = seen["quality"]
    assert 0.5 * len(given) < len(left) < len(given)
    given, left = seen["near_duplicates"]
    ids, _ = brute([(r["doc_id"], r["text"]) for r in given], 5)
    assert sorted(r["doc_id"] for r in left) == sorted(set(ids))
    given, left = seen["secrets"]
    assert len(given) == len(left)
    changed = [r for r, s in zip(sorted(given), sorted(left)) if r["text"] != s["text"]]
    assert 0 < len(changed) < 0.2 * len(given) and all("[SECRET]" in r["text"] for r in left if r["doc_id"] in {c["doc_id"] for c in changed})
    given, left = seen["mixture"]
    assert max(Counter(r["doc_id"] for r in left).values()) <= 3 and {r["doc_id"] for r in left} <= {r["doc_id"] for r in given}
    given, pieces = seen["packing"]
    assert check_pieces(pieces, given, direct) == 0


def test_run_agrees_with_itself(spark, small):
    a, b = (sorted(corpus_pipeline.run(spark, small).select("doc_id", "start", "length", "ids_crc32").collect()) for _ in range(2))
    assert a == b


def test_stages_on_edges_and_nothing(spark, small, edges, nothing):
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, edges, small)
        assert kept.count() > 0, name
        assert stage(spark, nothing, small).count() == 0, name
        if name != "packing":
            assert kept.columns == edges.columns, name
    docs = edges
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), f"edges-{name}")
    assert docs.agg({"length": "sum"}).first()[0] > 0
