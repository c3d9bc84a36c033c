"""Pairs of sets that share enough, counted for whole blocks of sets at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words that one product of matrices takes.
COLUMNS = 1024
#: Pairs of holders that are listed at once for words which few sets of a block have.
LISTED = 1 << 22
#: Rows of a block that are looked at together, so that they stay in a cache.
ROWS = 128


def _words(codes: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Of codes (word * side + place) the places in order of words; words, where each begins and how many hold it."""
    codes = np.sort(codes).astype(np.int64)
    words, starts, counts = np.unique(codes // side, return_index=True, return_counts=True)
    return codes % side, words, starts, counts


def _entries(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some words, and which of these words each belongs to."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of], of


class Common:
    """How many words each set on the left shares with each on the right; the last product is made as its rows are asked for."""

    def __init__(self, left: int, right: int, kind: type) -> None:
        self.shape, self.kind = (left, right), kind
        self.counts: np.ndarray | None = None
        self.factors: tuple[np.ndarray, np.ndarray] | None = None

    def settled(self) -> np.ndarray:
        """The counts in full, to be added to."""
        if self.counts is None:
            self.counts = np.zeros(self.shape, self.kind)
        if self.factors:
            self.counts += self.factors[0] @ self.factors[1].T
            self.factors = None
        return self.counts

    def rows(self, begin: int, end: int) -> np.ndarray:
        if self.factors is None:
            return self.settled()[begin:end]
        made = self.factors[0][begin:end] @ self.factors[1].T
        return made if self.counts is None else made + self.counts[begin:end]

    def add(self, left: np.ndarray, right: np.ndarray, side: int) -> None:
        """Count the words of codes, which no other call has had.

        Words that many sets have are multiplied as columns of 0 and 1, the others' holders are paired.
        """
        (pl, wl, sl, cl), (pr, wr, sr, cr) = _words(left, side), _words(right, side)
        _, il, ir = np.intersect1d(wl, wr, assume_unique=True, return_indices=True)
        sl, cl, sr, cr = sl[il], cl[il], sr[ir], cr[ir]
        many = cl * cr > max(16, self.shape[0] * self.shape[1] // 1600)
        at = np.flatnonzero(many)
        for k in range(0, len(at), COLUMNS):
            part = at[k : k + COLUMNS]
            if self.factors:
                self.settled()
            self.factors = tuple(self._columns(*x, part) for x in ((self.shape[0], pl, sl, cl), (self.shape[1], pr, sr, cr)))
        few = np.flatnonzero(~many)
        ends = np.cumsum(cl[few] * cr[few])
        k = 0
        while k < len(few):
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LISTED, "right")))
            part = few[k:to]
            step, of = _entries(np.zeros(len(part), np.int64), cl[part] * cr[part])
            a, b = pl[sl[part][of] + step // cr[part][of]], pr[sr[part][of] + step % cr[part][of]]
            cells, times = np.unique(a * self.shape[1] + b, return_counts=True)
            self.settled().reshape(-1)[cells] += times.astype(self.kind)
            k = to

    @staticmethod
    def _columns(size: int, places: np.ndarray, starts: np.ndarray, counts: np.ndarray, part: np.ndarray) -> np.ndarray:
        matrix = np.zeros((size, len(part)), np.float32)
        entries, column = _entries(starts[part], counts[part])
        matrix[places[entries], column] = 1
        return matrix


def enough(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a set of n must share, if it is the smaller one: num/den of it, and something."""
    return np.maximum(-(-n * num // den), 1)


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that connect what ``hit`` does, from one row of each component: (row, column) and (row, other row)."""
    fresh, unseen = hit.any(1), np.ones(hit.shape[1], bool)
    links: tuple[list, ...] = ([], [], [], [])
    for first in np.flatnonzero(fresh):
        if not fresh[first]:
            continue
        fresh[first] = False
        rows = np.array([first])
        while len(rows):
            columns = np.flatnonzero(hit[rows].any(0) & unseen)
            unseen[columns] = False
            rest = np.flatnonzero(fresh)
            rows = rest[hit[np.ix_(rest, columns)].any(1)]
            fresh[rows] = False
            for k, met in ((0, columns), (2, rows)):
                links[k].append(np.full(len(met), first))
                links[k + 1].append(met)
    return tuple(np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in links)


def compared(num: int, den: int, side: int, linked: bool):
    """For rows (i, j, left, right, left_n, right_n, left_root, right_root), those of a pair of blocks in a row: the pairs of
    roots that share enough as (x, y, common, least), or if ``linked`` only links (x, y) that connect the same roots."""

    def ended(same: bool, common: Common, ns: tuple, roots: tuple) -> Iterator[pa.RecordBatch]:
        needs = [enough(n, num, den).astype(common.kind) for n in ns]
        hits = np.zeros(common.shape, bool) if linked else None
        for k in range(0, len(ns[0]), ROWS):
            rows = common.rows(k, k + ROWS)
            hit = rows >= np.minimum(needs[0][k : k + ROWS, None], needs[1][None, :])
            if same:
                hit = np.triu(hit, k + 1)
            if linked:
                hits[k : k + ROWS] = hit
                continue
            a, b = np.nonzero(hit)
            if len(a):
                values = [roots[0].take(pa.array(a + k)), roots[1].take(pa.array(b)), pa.array(rows[a, b].astype(np.int64)), pa.array(np.minimum(ns[0][a + k], ns[1][b]))]
                yield pa.RecordBatch.from_arrays(values, names=["x", "y", "common", "least"])
        if linked and hits.any():
            a, b, c, d = forest(hits)
            left, right = roots
            yield pa.RecordBatch.from_arrays([left.take(pa.array(a)), right.take(pa.array(b))], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([left.take(pa.array(c)), left.take(pa.array(d))], names=["x", "y"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = common = ns = roots = None
        for batch in batches:
            for r in range(batch.num_rows):
                get = {name: batch.column(name)[r] for name in batch.schema.names}
                here = (get["i"].as_py(), get["j"].as_py())
                if here != key:
                    if key:
                        yield from ended(key[0] == key[1], common, ns, roots)
                    key, roots = here, (get["left_root"].values, get["right_root"].values)
                    ns = tuple(get[f"{s}_n"].values.to_numpy(zero_copy_only=False) for s in ("left", "right"))
                    # Whole numbers up to 2^24 are exact in 32 bits.
                    common = Common(*map(len, ns), np.float32 if max(x.max() for x in ns) < 1 << 24 else np.float64)
                common.add(*(get[s].values.to_numpy(zero_copy_only=False) for s in ("left", "right")), side)
        if key:
            yield from ended(key[0] == key[1], common, ns, roots)

    return compare
