"""Near duplicates and repeated sentence spans against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import components, neardup, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(AZ))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size, threshold=80):
    """component_id by row number; all pairs that share a shingle are compared."""
    sets = [shingles(t, size) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for q in s for j in where[q]} if s else ()
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= threshold * (len(s) + len(sets[j]) - common):
                of[find(i)] = find(j)
        for q in s:
            where[q].append(i)
    low = {}
    for i, (ident, _) in enumerate(rows):
        r = find(i)
        if ident is not None:
            low[r] = min(low.get(r, ident), ident)
    return [low.get(find(i)) if s else rows[i][0] for i, s in enumerate(sets)], [len(s) for s in sets]


def compare(docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ids, sizes = brute(rows, size)
    want = sorted(map(str, zip([r[0] for r in rows], sizes, ids, [a[0] == b for a, b in zip(rows, ids)])))
    got = neardup.near_duplicates(docs, shingle=size).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == want
    assert len({r["keeper"] for r in got}) == len({(r["keeper"], r["component_id"]) for r in got})
    return got


@pytest.mark.parametrize("size", [2, 5])
def test_small_table(spark, small, size):
    compare(spark.read.parquet(f"{small}/documents.parquet"), size)


def test_edges(edges, nothing):
    compare(edges, 2)
    compare(edges, 5)
    assert neardup.near_duplicates(nothing).count() == 0
    left = neardup.deduplicated(edges)
    assert left.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["-50", "1", "2", "3", "4", "6", "7", "None"]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """One group over many chunks and runs, with copies that link to the original alone."""
    monkeypatch.setattr(neardup, "RUN", 16)
    monkeypatch.setattr(neardup, "CLUSTER", 24)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        words = list(base)
        # Up to a tenth of the words: such copies are near the original and far from one another.
        for at in rng.sample(range(200), rng.choice([2, 5, 9, 10, 11])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:120] + [f"y{rng.randrange(10**6)}" for _ in range(80)])) for i in range(100)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2)


def test_pages_that_share_most_of_their_words(spark, monkeypatch):
    """Boilerplate below the threshold in regions and clusters of many runs: only planted copies are paired."""
    made = []
    pairs_of = neardup.rare_pairs
    monkeypatch.setattr(neardup, "rare_pairs", lambda *a: made.append(pairs_of(*a)) or made[-1])
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**7)}"
    common, rows = [word() for _ in range(173)], []
    for i in range(900):
        own = [word() for _ in range(37)]
        rows.append((2 * i, " ".join(own + common)))
        if i % 20 == 0:  # 18 of the 37 words anew: 0.83 alike
            rows.append((2 * i + 1, " ".join(own[:19] + [word() for _ in range(18)] + common)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(docs, shingle=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i - i % 2) for i, _ in rows}
    assert sum(p.count() for p in made) <= 3 * 45


def test_regions_beyond_a_run_lose_no_pair(spark, monkeypatch):
    """At the constants in use: half of every text is shared, so regions hold several hundred nodes."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**7)}"
    common, rows = [word() for _ in range(90)], []
    for i in range(3000):
        own = [word() for _ in range(60)]
        rows.append((2 * i, " ".join(common + own)))
        if i % 15 == 0:
            rows.append((2 * i + 1, " ".join(common + own[:44] + [word() for _ in range(14)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = neardup.profiles(docs, 2, "text", "doc_id")
    assert neardup.regions(nodes.where("set_id is not null")).where(F.col("n") > neardup.RUN).count() > 0
    compare(docs, 2)


def test_names_of_input_columns_are_left_alone(spark):
    rows = [(1, "a b c d e f g", "x", 1), (2, "a b c d e f g", "y", 2), (None, "", None, 3), (3, None, "z", 4), (3, None, "z", 5), (4, "k l m", "w", 6), (4, "k l m", "w", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, granary_hash string, granary_id long")
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(str((r["doc_id"], r["granary_hash"])) for r in left.collect()) == sorted(["(1, 'x')", "(None, None)", "(3, 'z')", "(3, 'z')", "(4, 'w')"])


@pytest.mark.parametrize("most", [1 << 12, 1 << 25])
def test_filters_let_all_that_they_hold_through(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "FILTER_BITS", most)
    rows = spark.range(3000).withColumn("h", F.xxhash64("id"))
    bits = neardup.bits_of(rows.where("id % 3 = 0"), "h")
    through = {r["id"] for r in rows.where(neardup.may_hold(bits, F.col("h"))).collect()}
    assert {i for i in range(3000) if i % 3 == 0} <= through and (len(through) < 1100) == (most > 1 << 12)
    assert rows.where(neardup.may_hold(neardup.bits_of(rows.limit(0), "h"), F.col("h"))).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rng.randrange(1, 99)) for _ in range(80)] + [(5000 - i, 5001 - i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(4951, 5002)} == {4951}
    assert all(got[b] == 1000 for a, b in edges if a == 1000)


def spans_of(text, least_sentences, least_words):
    out, sentence, line = [], [], 0
    found = list(WORD.finditer(text or ""))
    for i, m in enumerate(found):
        sentence.append(m)
        follows = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        bare = re.sub("[\"')\\]}»”’›」』）]{1,3}$", "", m[0])
        if bare and bare[-1] in repeats.STOPS or "\n" in follows:
            out.append(sentence)
            sentence = []
    spans = []
    for a in range(len(out)):
        for b in range(a + least_sentences - 1, len(out)):
            words = [m for s in out[a : b + 1] for m in s]
            if len(words) >= least_words:
                spans.append((a, b, words[0].start(), words[-1].end(), tuple(m[0].translate(AZ) for m in words)))
                break
    return spans


def brute_repeats(rows, least_sentences=2, least_words=24):
    every = []
    for ident, text, key in {(i, t or "", k) for i, t, k in rows}:
        every += [((ident is None, ident or 0, key, a), ident, key, a, b, s, e, w) for a, b, s, e, w in spans_of(text, least_sentences, least_words)]
    first = {}
    for order, ident, *_, w in sorted(every, key=lambda x: x[0]):
        first.setdefault(w, (order, ident))
    later = defaultdict(list)
    for order, ident, key, a, b, s, e, w in every:
        if first[w][0] != order:
            later[ident, key].append((a, b, s, e, first[w][1]))
    out = []
    for (ident, _), some in later.items():
        run = None
        for a, b, s, e, source in sorted(some, key=lambda x: x[:4]):
            if run and a <= run[1] + 1:
                run[1], run[3], run[4] = max(b, run[1]), max(e, run[3]), run[4] | {source}
            else:
                run = [a, b, s, e, {source}]
                out.append((ident, run))
    return sorted(str((i, r[2], r[3], r[1] - r[0] + 1, sorted(x for x in r[4] if x is not None))) for i, r in out)


def check_repeats(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = repeats.find_repeats(docs).collect()
    assert sorted(str((r["doc_id"], r["start"], r["stop"], r["sentences"], r["first_ids"])) for r in got) == brute_repeats(rows)
    return got


def test_repeats_of_the_small_table(spark, small):
    assert check_repeats(spark.read.parquet(f"{small}/documents.parquet"))


def test_repeats_of_edges(spark, edges, nothing):
    check_repeats(edges)
    assert repeats.find_repeats(nothing).count() == 0
    passage = "Éins zwei drei vier fünf. Sechs sieben acht, neun zehn elf! Zwölf dreizehn vierzehn; fünfzehn sechzehn siebzehn? Und noch mehr Wörter bis hin zu über zwanzig."
    rows = [(1, f"Ein Anfang. {passage} Ein Ende."), (2, f"😀 Anders: {passage.upper()}\n{passage}"), (3, "Nichts davon. Gar nichts."), (None, passage), (4, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = check_repeats(docs)
    assert {r["doc_id"] for r in got} == {2, None}
    left = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and left[None] == "" and left[4] is None
    assert "sieben acht" not in left[2] and left[2].startswith("😀 Anders:")


@pytest.mark.parametrize("sign", ["。", "！", '."', ".”)", "…", "؟", ".'»", "、"])
def test_stops_of_other_scripts_and_quotes_end_sentences(spark, sign):
    rng = random.Random(2)
    sentence = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(9)) + sign
    passage = " ".join(sentence() for _ in range(5))
    rows = [(1, f"{sentence()} {passage} {sentence()}"), (2, f"{sentence()} {sentence()} {passage} {sentence()}")]
    (r,) = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (r["doc_id"], rows[1][1][r["start"] : r["stop"]], r["sentences"]) == (2, passage, 5)


def test_a_word_said_over_and_over_is_not_cut(spark):
    rng = random.Random(12)
    passage = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    rows = [(1, "so " * 500), (2, "so " * 300 + passage), (3, "one " * 90 + passage + " two" * 90), (4, "so " * 400)]
    got = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    assert [r["doc_id"] for r in got] == [3]
    (r,) = got
    assert r["start"] >= 4 * 88 and len(rows[2][1][r["start"] : r["stop"]].split()) >= 34


def test_repeats_without_stops(spark):
    """Fifty copied words are found wherever they stand in texts that no sign parts, and a copied text as a whole."""
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, where = [], {}
    for i in range(60):
        passage, before = new(50), new(rng.randrange(40))
        rows.append((i, " ".join(new(rng.randrange(40)) + passage + new(rng.randrange(40)))))
        rows.append((1000 + i, " ".join(before + passage + new(rng.randrange(40)))))
        where[1000 + i] = len(" ".join([*before, ""])), len(" ".join(before + passage))
    text = " ".join(new(101))
    rows += [(5000, text), (5001, text), (6000, " ".join(new(300))), (6001, "few words " + text[: text.index(" ")])]
    got = {r["doc_id"]: r for r in repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), whole=True).collect()}
    assert set(got) == {*where, 5001} and (got[5001]["start"], got[5001]["stop"]) == (0, len(text))
    for ident, (start, stop) in where.items():
        found = got[ident]
        assert start <= found["start"] and found["stop"] <= stop and found["sentences"] >= 2 and found["first_ids"] == [ident - 1000]
        assert len(rows[2 * (ident - 1000) + 1][1][found["start"] : found["stop"]].split()) >= 24


def all_runs(rows, least_sentences=2, least_words=24):
    """(doc_id, start, stop) of the stretches under any repeated run of sentences, of whatever length."""
    first, every, out = {}, [], []
    for ident, text in sorted(rows):
        ends = [m.end() for m in WORD.finditer(text) if m[0][-1] in ".!?,;:"]
        starts = [0, *[e + 1 for e in ends[:-1]]]
        for a in range(len(ends)):
            for b in range(a + least_sentences - 1, len(ends)):
                words = tuple(text[starts[a] : ends[b]].translate(AZ).split())
                if len(words) >= least_words:
                    every.append((ident, a, b, starts[a], ends[b], first.setdefault(words, (ident, a)) != (ident, a)))
    for ident, a, b, start, stop, later in sorted(every):
        if later and out and out[-1][0] == ident and a <= out[-1][3] + 1:
            out[-1] = (ident, out[-1][1], max(stop, out[-1][2]), max(b, out[-1][3]))
        elif later:
            out.append((ident, start, stop, b))
    return [r[:3] for r in out]


def test_repeats_cover_what_all_runs_cover(spark):
    """Spans of 13, 12, 6 and 5 words leave the last 11 out unless one ends there; clauses are short enough not to be parted."""
    rng = random.Random(4)
    clause = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) + ","
    alone = lambda: [clause(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 6))]
    passages = [[clause(n) for n in (13, 12, 6, 5)]] + [[clause(rng.randrange(1, 14)) for _ in range(rng.randrange(2, 9))] for _ in range(30)]
    rows = [(i, " ".join(alone() + passages[i % 31] + alone() + passages[rng.randrange(31)] + alone())) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda **how: sorted((r["doc_id"], r["start"], r["stop"]) for r in repeats.find_repeats(docs, **how).collect())
    assert found(whole=True) == all_runs(rows) != found()
