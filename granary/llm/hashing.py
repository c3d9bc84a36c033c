"""Hashes of words, straight from the bytes of Arrow's strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once, and of a piece of it that is worked on at a time.
SLICE, PIECE = 1 << 20, 1 << 20


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = random_words(256, 1) | np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of texts laid end to end: 64-bit hashes, starts, lengths, and the text number of each.

    With ``lower``, A-Z count as a-z.  A word's hash is a sum over its bytes, so the bytes are gone through in pieces, which
    bounds the memory that a very long text needs beside its words; a word cut by a piece's end goes on in the next.
    """
    raws, begins, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        letter = ~_SPACE[piece]
        inner = np.flatnonzero(letter)
        if not len(inner):
            continue
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        bounds = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(piece))] - at
        begin[bounds] = letter[bounds]
        goes_on = at > 0 and letter[0] and not _SPACE[data[at - 1]] and not (len(bounds) and bounds[0] == 0)
        starts = np.flatnonzero(begin)
        # Only the words' own bytes, each times a power of its place in the word.
        first = np.searchsorted(inner, starts)
        lengths = np.diff(np.append(first, len(inner)))
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()) - 1, FACTOR, np.uint64)))
        own = piece[inner]
        values = _LETTER[_LOWER[own] if lower else own] * powers[np.arange(len(inner)) - np.repeat(first, lengths)]
        raw = np.add.reduceat(values, first)
        if goes_on:
            shifted = int(raw[0]) * pow(int(FACTOR), int(sizes[-1][-1]), 1 << 64)
            raws[-1][-1] = (int(raws[-1][-1]) + shifted) % (1 << 64)
            sizes[-1][-1] += lengths[0]
            raw, starts, lengths = raw[1:], starts[1:], lengths[1:]
        if len(raw):
            raws.append(raw)
            begins.append(starts + at)
            sizes.append(lengths)
    starts = np.concatenate(begins)
    return mixed(np.concatenate(raws)), starts, np.concatenate(sizes), np.searchsorted(ends, starts, "right")


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, bytes, and ends of the texts in them, of parts of about ``size`` bytes (one text at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at]
        at = end
