"""Matroska round trips, URL rules and exact top-k against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import matroska, topk, urls


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 65536, 65600, 200_000 // 64 * 64])
def test_files_give_back_their_payload(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.mux(payload)
    media = matroska.parse(data)
    assert matroska.described(data)[0] == payload and media.complete
    assert [p[1] for p in media.packets] == [i * 64_000_000 for i in range(len(media.packets))]
    starts = {p for *_, p in media.cues}
    assert starts == set(media.clusters) and all(data[p : p + 4] == b"\x1f\x43\xb6\x75" for p in starts)


def test_parser_reads_groups_unknown_sizes_voids_and_damage():
    m = matroska
    entry = m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 2) + m.number(m.KIND, 1) + m.element(m.CODEC, b"V_VP9")))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82" + struct.pack(">hB", -3, 0) + b"abc") + m.number(m.BLOCK_DURATION, 5) + m.element(m.REFERENCE, b"\xff"))
    fixed = m.element(m.SIMPLE_BLOCK, b"\x82" + struct.pack(">hB", 4, 0x84) + b"\x01" + b"xxyy")
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIMESTAMP, 100) + m.element(m.VOID, b"123") + group + fixed
    body = entry + cluster + cluster + m.element(m.CUES, b"")
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    media = m.parse(data)
    assert media.complete and len(media.clusters) == 2
    assert [(p[0], p[1], p[3], p[4], p[5]) for p in media.packets[:3]] == [(2, 97_000_000, 3, False, "none"), (2, 104_000_000, 2, True, "fixed"), (2, 104_000_000, 2, True, "fixed")]
    assert not m.parse(data[:-20] + b"\x00" * 9).complete and not m.parse(b"").complete
    for cut in range(0, len(data), 7):
        m.parse(data[:cut])


def test_media_of_edges(edges, nothing):
    rows = matroska.read_back(matroska.store_media(edges)).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in edges.collect()}
    assert len(rows) == 10
    seen = set()
    for ident, text in texts:
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = next(r for r in rows if r["doc_id"] == ident and r["n_bytes"] == len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        seen.add((text, r["media_sha256"], r["feature"]))
    assert len(seen) == len({t for _, t in texts})
    assert matroska.read_back(matroska.store_media(nothing)).count() == 0


def test_packet_table(spark, edges):
    media = matroska.store_media(edges.where("doc_id = 3"))
    found = matroska.packets(media)
    assert found.agg(F.sum("length")).first()[0] % 64 == 0 and found.where("not cued").count() == 0
    broken = spark.createDataFrame([(1, 5, None), (2, 0, b""), (3, 0, b"junk")], "doc_id long, n_bytes long, media binary")
    assert matroska.packets(broken).count() == 0
    assert [(r["doc_id"], r["payload_bytes"]) for r in matroska.read_back(broken).collect()] == [(1, 0), (2, 0), (3, 0)]


URLS = [
    ("http://a.com/en/1", "a.com", "/en/1", "com/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("https://WWW.Example.COM/en/x?casino", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
    ("https://x.y.www.example.com/en/", "x.y.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://q.net/es/a#b", "q.net", "/es/a", "net/es/", "block"),
    ("http://q.net?/es/a", "q.net", "", None, "allow"),
    ("http://q.net/ES/", "q.net", "/ES/", None, "allow"),
    ("http://spam-farm.org/", "spam-farm.org", "/", None, "block"),
    ("http://spam-farmer.org/", "spam-farmer.org", "/", None, "allow"),
    ("http://x.org/free-bonus", "x.org", "/free-bonus", None, "block"),
    ("http://x.org/free-free", "x.org", "/free-free", None, "allow"),
    ("http://x.org/vip-deal", "x.org", "/vip-deal", None, "allow"),
    ("http://x.org/vip/deal/seo", "x.org", "/vip/deal/seo", None, "block"),
    ("http://x.org/vip/bonus", "x.org", "/vip/bonus", None, "allow"),
    ("a.com/en", "", "", None, "allow"),
    ("viagra", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_vocabularies(spark, tmp_path):
    table = spark.createDataFrame([("Moss", 1000), ("fern", 600), ("fern", 400), ("ivy", 500), (None, 9), ("none", None), ("zero", 0)], "term string, weight long")
    terms = urls.table_terms(table)
    assert terms == (("fern", 600), ("ivy", 500), ("moss", 1000))
    (tmp_path / "terms.tsv").write_text("term\tweight\nMoss\t1000\nfern\t600\n\nivy\t500\n")
    assert urls.read_terms(tmp_path / "terms.tsv") == terms and len(urls.read_terms(urls.TERMS)) > 100
    assert urls.hits("http://moss.x/Fern-ivy/ferns?fern", terms) == (1, 2, 2100)
    pages = spark.createDataFrame([(1, "http://a.x/fern"), (2, "http://a.x/fern/ivy"), (3, "http://a.x/casino")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, terms=terms).collect()} == {1: "allow", 2: "block", 3: "allow"}
    assert urls.judge_urls(pages, terms=()).where("verdict = 'block'").count() == 0


def brute(rows, k=5, every=50):
    good = [(i, [int(np.floor(256.0 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every:
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, big=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, big])).astype(np.float32).tolist()) for i in range(n)]
    return [*rows, *[(n + i, rows[i % 3][1]) for i in range(n // 3)]]


@pytest.mark.parametrize(("seed", "big"), [(1, 1.0), (2, 30.0), (3, 1e20)])
def test_top_products(spark, monkeypatch, seed, big):
    for name, value in {"CELL": 100, "QUERIES": 3, "BUCKET": 16, "NEAR": 20}.items():
        monkeypatch.setattr(topk, name, value)
    inf, nan = float("inf"), float("nan")
    rows = [*vectors(seed, 300, big), (1000, None), (1050, [inf] * 8), (1100, [nan] * 8), (1150, [None] * 8), (None, [1.0] * 8), (1200, []), (1250, [0.5, 0.5]), (-50, [0.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id int, score int")
    got = sorted(map(tuple, topk.top_products(frame).collect()))
    assert got == brute(rows)
    assert topk.top_products(frame.limit(0)).count() == 0


def clustered(n, lengths):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 16))
    v = middle[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v * np.exp(rng.normal(size=(n, 1))) if lengths else v


@pytest.mark.parametrize("lengths", [False, True])
def test_pruning_saves_products_and_no_result(spark, monkeypatch, lengths):
    for name, value in {"CELL": 1000, "BUCKET": 100, "NEAR": 100}.items():
        monkeypatch.setattr(topk, name, value)
    rows = [(i, v) for i, v in enumerate(clustered(3000, lengths).astype(np.float32).tolist())]
    rows += [(3000 + i, rows[50 * (i % 7)][1]) for i in range(300)]  # ties with queries' own vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, topk.top_products(frame).collect())) == brute(rows)
    made = topk.work(frame).first()
    assert made["pairs"] == 3300 * 66 and made["products"] < 0.25 * made["pairs"]


@pytest.mark.parametrize("seed", range(6))
def test_coordinate_ranges_lose_no_candidate(seed):
    rng = np.random.default_rng(seed)
    c = np.floor(256 * clustered(400, seed % 2 == 1)) if seed < 4 else np.floor(rng.normal(size=(400, 5)) * 50)
    q = c[rng.integers(0, 400, 20)] + np.floor(rng.normal(size=(20, c.shape[1])) * 20)
    bucket = topk.Bucket(np.arange(400), c, np.array([topk.length_of(v) for v in c]))
    for v in q:
        score, length = bucket.c @ v, topk.length_of(v)
        for theta in np.quantile(score, [0.5, 0.9, 0.99, 1.0]):
            if theta > 0:
                found = bucket.by_coordinates(v / length, theta / length / bucket.length[0], theta / length)
                assert set(np.flatnonzero(score >= theta).tolist()) <= set(found.tolist())
                assert (bucket.box(v[None])[0] >= score.max()) and bucket.by_length(np.array([theta / length * (1 - 1e-9)]))[0] >= np.flatnonzero(score >= theta).max() + 1
