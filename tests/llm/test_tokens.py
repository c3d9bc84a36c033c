"""Packing and shards against whole texts encoded directly."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import packing, sstable, tokens


@pytest.fixture(scope="module")
def direct():
    encoder = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text, end: np.array([*encoder.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check_pieces(rows, docs, direct):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"], bytes()].append(r)
    wanted = defaultdict(int)
    for d in docs:
        ids = direct(d["text"], 2)
        wanted[d["doc_id"], len(ids)] += 1
    for (ident, n, _), found in pieces.items():
        times = wanted.pop((ident, n))
        text = next(d["text"] for d in docs if d["doc_id"] == ident and len(direct(d["text"], 2)) == n)
        ids = direct(text, 2)
        covered = np.zeros(n, int)
        for r in found:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == times).all()
    assert not wanted
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_packing_of_the_small_table(spark, small, direct):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.digest(packing.pack(docs)).collect()
    assert check_pieces(rows, docs.collect(), direct) == 0


def test_packing_of_edges(edges, nothing, direct):
    rows = packing.digest(packing.pack(edges)).collect()
    check_pieces(rows, edges.select("doc_id", "text").collect(), direct)
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("hist", [{3000: 1000}, {4095: 7, 1: 3}, {2048: 5}, {1365: 3, 1366: 4, 1: 1}, {n: n % 7 for n in range(1, 4096)}, {}])
def test_plans_place_every_rank_once(hist):
    counts = np.zeros(packing.WINDOW + 1, np.int64)
    for n, c in hist.items():
        counts[n] = c
    plan = packing.make_plan(counts, 10)
    sequences, cuts = defaultdict(list), 0
    for n, c in hist.items():
        for rank in range(c):
            pieces = plan.place(n, rank)
            cuts += len(pieces) - 1
            assert sum(p[2] for p in pieces) == n
            for s, o, length in pieces:
                assert s >= 10
                sequences[s].append((o, length))
    for parts in sequences.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    assert cuts <= plan.full + len(plan.cuts)  # only the stream's documents, one at each end of a sequence


def test_solver_recovers_repeats():
    counts = np.zeros(packing.WINDOW + 1, np.int64)
    counts[1000], counts[3096], counts[500], counts[596], counts[3000] = 70, 40, 30, 30, 30
    rows = packing.combinations(counts, packing.WINDOW)
    x = packing.solve(rows, counts)
    assert {(0, 1000, 3096), (500, 596, 3000)} <= {tuple(r) for r in rows}
    assert abs(x[[tuple(r) for r in rows].index((0, 1000, 3096))] - 40) < 15


def read(spark, docs, **how):
    manifest = sstable.write_shards(docs, **how)
    return manifest, sstable.digest(sstable.read_shards(manifest)).collect()


def test_shards_of_the_small_table(spark, small, direct):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    manifest, rows = read(spark, docs, shards=5)
    found, start = {r["doc_id"]: r for r in rows}, 0
    for d in sorted(docs.collect(), key=lambda d: d["doc_id"]):
        ids, r = direct(d["text"], 1), found.pop(d["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found and manifest.count() > 1
    some = docs.where("doc_id = 17").first()
    assert [x.tolist() for x in sstable.lookup(manifest, 17)] == [direct(some["text"], 1).tolist()]
    assert sstable.lookup(manifest, 10**12) == []


def test_shards_of_edges(spark, edges, nothing, direct):
    manifest, rows = read(spark, edges)
    want = sorted((-(10**9) if d["doc_id"] is None else d["doc_id"], zlib.crc32(direct(d["text"], 1).tobytes())) for d in edges.collect())
    assert sorted((-(10**9) if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]).tolist()
    ids = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert len(sstable.lookup(manifest, 4)) == 2 and len(sstable.lookup(manifest, None)) == 1
    assert read(spark, nothing)[1] == []


def test_damage_is_noticed(spark, edges):
    from pyarrow import fs

    path = sstable.write_shards(edges, shards=1).first()["path"]
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as file:
        raw = bytearray(file.read())
    raw[5] ^= 255
    with system.open_output_stream(at) as file:
        file.write(bytes(raw))
    with pytest.raises(Exception), sstable.opened(path) as file:  # noqa: B017
        list(sstable.Table(file).scan())


def test_words_remembered_or_not_give_the_same_ids(direct):
    texts = ["a b  c\n\nd's we'll", "x" * 500 + " y", " a　b", "", None, "É é İ ΣΑΣ 12 3.4", "a b c " * 30, "e\u0301 E\u0301. x| | a|b | |c ÿ× Ÿ ŉ o'Neil! don't. (a) \u212b ß.", "\x1c \x85a\u2028b"]
    for room in (10, 10**6):
        encode = tokens.Encoder(tokens.vocabulary_path(), room=room)
        for some in (texts, texts[::-1], texts * 3):
            assert [x.tolist() for x in encode.each(pa.array([t or "" for t in some]), 7)] == [direct(t, 7).tolist() for t in some]
        assert (len(encode.hashes) > 0) == (room > 10) and all(len(p) <= 64 for p in encode.cores)
    assert list(encode.each(pa.array([], pa.string()), 7)) == []
