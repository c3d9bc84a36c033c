"""Substring deduplication by sliding sentence spans.

A sentence ends with a word that ends in a stop (``STOPS``; closing quotes and brackets may follow it), or at a line end,
or with the text: commas part too, since a copied passage seldom begins and ends with whole sentences.  From every sentence starts a span: the fewest
consecutive sentences, ``least_sentences`` at least, that hold ``least_words`` words.  Spans are hashed
and joined over the whole corpus, and the sentences under any span but a first one go.

``whole`` also parts a sentence where of ``WINDOW`` words in a row none ends it: after the word whose hash, with
the word before it, is least, if none of them equals it.  Such cuts depend on the words around them alone, so copies have them in common:
of 50 words that stand elsewhere too, at least 24 in two pieces or more lie between cuts that all copies share.
With it a span also ends with every sentence: the fewest that reach back ``least_words`` words.  All that lies between
the first and last cut that copies share is then under a repeated span, as if every run of sentences were hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import modest_batches, spread, stored
from granary.llm.hashing import FACTOR, mixed, random_words, slices, words_of
from granary.llm.neardup import runs

SENTENCES, WORDS = 2, 24
#: With hashes of two words, the first and last common cut of 50 words leave 50 + 2 - 2 * WINDOW - 2 = 24 between them.
WINDOW = 13

#: What ends a sentence, and what may stand between that and the word's end; no character here is part of another.
STOPS, CLOSERS = ".!?,;:…。！？，、；：؟؛،।॥", "\"')]}»”’›」』）"


def ends_with(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, signs: str) -> np.ndarray:
    """Of the bytes from ``starts`` to ``stops`` the length of the sign that ends them, 0 where none of the signs does."""
    out = np.zeros(len(stops), np.int64)
    coded = [c.encode() for c in signs]
    for size in sorted({len(c) for c in coded}):
        value = np.zeros(len(stops), np.int64)
        for back in range(size, 0, -1):
            value = value << 8 | data[np.maximum(stops - back, 0)]
        known = np.isin(value, [int.from_bytes(c, "big") for c in coded if len(c) == size])
        out[known & (stops - size >= starts)] = size
    return out


def stopped(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether a word ends a sentence, be there closing quotes and brackets after its stop, three at most."""
    end = stops.copy()
    for _ in range(3):
        end -= ends_with(data, starts, end, CLOSERS)
    return ends_with(data, starts, end, STOPS) > 0


_BASES = random_words(2, 11) | np.uint64(1)


def content_cuts(hashes: np.ndarray, text: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Words after which a sentence is parted: the least of each ``WINDOW`` words of a text that none ends, if it is alone."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    ended = np.append(0, np.cumsum(closed))
    at = np.flatnonzero((ended[WINDOW:] == ended[:-WINDOW]) & (text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1]))
    values = mixed(np.append(hashes[:1], hashes[:-1]) * FACTOR + hashes)
    values[np.append(True, text[1:] != text[:-1])] = np.uint64((1 << 64) - 1)  # no word before
    least, best, alone = at, values[at], np.ones(len(at), bool)
    for k in range(1, WINDOW):
        here = values[at + k]
        lower = here < best
        alone = np.where(lower, True, alone & (here != best))
        least, best = np.where(lower, at + k, least), np.where(lower, here, best)
    least = least[alone]  # of words said over and over none is the least, and content tells no place to cut
    return np.unique(least)


def span_table(data: np.ndarray, ends: np.ndarray, least_sentences: int, least_words: int, whole: bool = False) -> dict[str, np.ndarray]:
    """Spans of texts laid end to end: text number, first and last sentence, their bounds, words, and two hashes."""
    hashes, starts, lengths, text = words_of(data, ends)
    if not len(hashes):
        return {}
    lines = np.flatnonzero(data == 10)
    stops = starts + lengths
    last = np.append(text[1:] != text[:-1], True)
    broken = np.append(np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, stops[:-1]), True)
    closed = last | broken | stopped(data, starts, stops)
    if whole:
        closed[content_cuts(hashes, text, closed)] = True
    closing = np.flatnonzero(closed)
    opening = np.append(0, closing[:-1] + 1)
    owner = text[closing]
    first_of = np.searchsorted(owner, owner)  # each sentence's text's first sentence
    # The last sentence of the span that starts with each.
    n = np.arange(len(closing))
    final = np.maximum(n + least_sentences - 1, np.searchsorted(closing + 1, opening + least_words))
    inside = final < len(closing)
    inside[inside] = owner[final[inside]] == owner[inside]
    n, final = n[inside], final[inside]
    if whole:
        # The first sentence of the span that ends with each.
        m = np.arange(len(closing))
        start = np.minimum(m - least_sentences + 1, np.searchsorted(opening, closing + 1 - least_words, "right") - 1)
        inside = start >= first_of
        pairs = np.unique(np.append(n, start[inside]) * len(closing) + np.append(final, m[inside]))
        n, final = np.divmod(pairs, len(closing))
    a, b = opening[n], closing[final] + 1
    out = {"text": owner[n], "first": n - first_of[n], "last": final - first_of[n], "words": b - a}
    follows = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
    points = lambda at: at - np.searchsorted(follows, at)
    base = points(np.append(0, ends[:-1])[out["text"]])
    out["start"], out["stop"] = points(starts[a]) - base, points(stops[b - 1]) - base
    for i, factor in enumerate(_BASES):
        # Prefix sums of the words times powers of an odd number, whose inverse takes the start out again.
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(hashes) - 1, factor, np.uint64)))
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(hashes) - 1, inverse, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(hashes * powers))
        out[f"h{i}"] = mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * FACTOR).view(np.int64)
    return out


def spans(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, text_col: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """A row per span: doc_id, text_hash, first and last sentence, start and stop in code points, words, h0, h1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    names = ["first", "last", "start", "stop", "words", "h0", "h1"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, ends in slices(batch.column("text")):
                found = span_table(data, ends, least_sentences, least_words, whole)
                if found:
                    owner = pa.array(found["text"] + at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(owner), batch.column("text_hash").take(owner), *[pa.array(found[c].astype(np.int64)) for c in names]],
                        names=["doc_id", "text_hash", *names],
                    )

    return rows.mapInArrow(made, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in names))


def find_repeats(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, text_col: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """The stretches to remove: doc_id, text_hash, start and stop (code points), sentences, words_most, first_ids.

    A stretch is a run of sentences under repeated spans of which each stands elsewhere first: in a row of
    smaller (doc_id, hash of the text), a null id being the greatest, or earlier in the same text.  first_ids
    lists the documents that hold those first copies.  Rows that agree in id and text are one document; null,
    empty and short texts have no spans; an empty table gives no rows; other columns are ignored.  With ``whole``,
    as the query has it, long sentences count as the pieces that they are parted in, and spans end as well as start with every one.
    """
    modest_batches(docs.sparkSession)
    every = spans(docs, least_sentences, least_words, text_col, id_col, whole)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "first")
    # A span in a third of all texts is one row from each task here.
    groups = stored(
        every.groupBy("h0", "h1").agg(F.min(order).alias("origin"), F.max(order).alias("other")).where("origin <> other").select("h0", "h1", "origin"), "repeat-groups"
    )
    later = (
        every.join(groups, ["h0", "h1"])
        .where(order != F.col("origin"))
        .select("doc_id", "text_hash", "first", "last", "start", "stop", F.col("origin.doc_id").alias("first_id"))
    )

    schema = "doc_id long, text_hash long, start long, stop long, sentences long, spans long, first_ids array<long>"

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for group in runs((f.astype({"doc_id": "Int64"}).assign(known=f["doc_id"].notna(), ident=f["doc_id"].fillna(0).astype("int64")) for f in frames), ["known", "ident", "text_hash"]):
            ident = None if not group["known"].iat[0] else int(group["ident"].iat[0])
            open_run: list | None = None
            for first, last, start, stop, source in zip(*(group[c].tolist() for c in ("first", "last", "start", "stop", "first_id"))):
                source = None if pd.isna(source) else int(source)
                if open_run and first <= open_run[1] + 1:
                    if last > open_run[1]:
                        open_run[1], open_run[3] = last, stop
                    open_run[4] += 1 if (first, last) != open_run[6] else 0
                    open_run[5].add(source)
                else:
                    if open_run:
                        rows.append((ident, int(group["text_hash"].iat[0]), open_run[2], open_run[3], open_run[1] - open_run[0] + 1, open_run[4], sorted(x for x in open_run[5] if x is not None)))
                    open_run = [first, last, start, stop, 1, {source}, None]
                open_run[6] = (first, last)
            rows.append((ident, int(group["text_hash"].iat[0]), open_run[2], open_run[3], open_run[1] - open_run[0] + 1, open_run[4], sorted(x for x in open_run[5] if x is not None)))
            if len(rows) > 5000:
                yield framed(rows)
                rows = []
        if rows:
            yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "text_hash", "start", "stop", "sentences", "spans", "first_ids"]).astype({"doc_id": "Int64"})

    key = ["doc_id", "text_hash"]
    return later.repartition(spread(docs.sparkSession), *key).sortWithinPartitions(*key, "first", "last").mapInPandas(joined, schema)


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """All documents with the repeated stretches cut out of their texts; other columns stay as they were."""
    cuts = find_repeats(docs, text_col=text_col, id_col=id_col, **{"whole": True} | how).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("granary_cuts"))
    cuts = stored(cuts.select(F.col("doc_id").alias("granary_id"), F.col("text_hash").alias("granary_hash"), "granary_cuts"), "repeat-cuts")
    hashed = docs.withColumn("granary_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = hashed.join(cuts, (F.col("granary_text") == F.col("granary_hash")) & hashed[id_col].cast("long").eqNullSafe(F.col("granary_id")), "left")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, stretches: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, stretches):
            at, parts = 0, []
            for s in some if some is not None else ():
                parts.append(text[at : s["start"]])
                at = s["stop"]
            out.append(text if not parts else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return found.withColumn(text_col, F.when(F.col("granary_cuts").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("granary_cuts")))).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "stop", "sentences", "spans", "first_ids")
