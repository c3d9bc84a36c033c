"""Every operator on a text of many MB (``LONG_TEXT_MB``), its near copy, and ordinary rows beside them."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import matroska, mixture, neardup, packing, quality, repeats, secrets, sstable, urls
from granary.llm.common import stored

SIZE = int(os.environ.get("LONG_TEXT_MB", "10")) * 1_000_000


@pytest.fixture(scope="module")
def text():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i * 7919 % 99991}{'.' if i % 11 == 0 else ''}" for i in range(5000)])
    return " ".join(words[rng.integers(0, 5000, SIZE // 6)].tolist())[:SIZE]


@pytest.fixture(scope="module")
def docs(spark, text):
    rows = [(1, text, "en", "a"), (2, "before all else. " + text + " password=abcdefgh12345678", "en", "b"), (3, "a short one", "en", "a"), (4, None, "en", "b")]
    return stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4, "doc_id"), "long-texts")


def test_near_copies(docs):
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert [rows[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and rows[1]["n_shingles"] > SIZE // 10


def test_repeats(docs, text):
    (r,) = repeats.digest(repeats.find_repeats(docs, whole=True)).collect()
    assert r["doc_id"] == 2 and r["first_ids"] == [1] and r["start"] < 200 and r["stop"] > len(text) - 500


def test_quality(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = {r["doc_id"]: r["score"] for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    assert len(rows) == 4 and all(0 <= s <= 1 for s in rows.values())


def test_secrets(docs, text):
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    at = len("before all else. ") + len(text) + 1
    assert rows[2]["spans"] == f"assign:{at}:{at + 25}" and rows[1]["spans"] == ""
    hidden = secrets.redact(docs).select("doc_id", F.length("text").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in hidden} == {1: len(text), 2: at + len("password=[SECRET]"), 3: 11, 4: None}


def test_mixture(docs, text):
    rows = {r["doc_id"]: r for r in mixture.mix(docs).collect()}
    assert rows[1]["size"] == len(text.split()) and rows[2]["size"] == rows[1]["size"] + 4 and sum(r["taken"] for r in rows.values()) >= rows[1]["size"]


def test_packing_and_shards(docs):
    pieces = packing.digest(packing.pack(docs)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.count("*").alias("pieces")).collect()
    assert len(pieces) == 4 and all(r["n"] == r["all"] for r in pieces)
    manifest = sstable.write_shards(docs)
    rows = {r["doc_id"]: r["n_tokens"] for r in sstable.digest(sstable.read_shards(manifest)).collect()}
    assert rows == {r["doc_id"]: r["n"] for r in pieces}
    assert len(sstable.lookup(manifest, 1)[0]) == rows[1]


def test_media(docs, text):
    rows = {r["doc_id"]: r for r in matroska.read_back(matroska.store_media(docs)).collect()}
    payload = text.encode().ljust(-(-len(text) // 64) * 64, b"\0")
    assert (rows[1]["payload_sha256"], rows[1]["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_urls(spark, text):
    url = "http://x.org/" + text.replace(" ", "/")
    pages = spark.createDataFrame([(1, url), (2, url + "/casino"), (3, "http://" + "a." * 1_000_000 + "com/")], "page_id long, url string")
    rows = {r["page_id"]: (r["verdict"], r["rule"], len(r["path"])) for r in urls.judge_urls(pages).collect()}
    assert rows == {1: ("allow", None, len(url) - 12), 2: ("block", None, len(url) - 5), 3: ("allow", "com/", 1)}
