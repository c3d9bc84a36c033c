"""Token ids of whole texts, with the encodings of words remembered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from granary.llm.hashing import slices, words_of


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A part that is Latin letters and then other signs of ASCII but digits and apostrophes.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Parts that show whether a tokenizer lower-cases and parts letters from signs.
PROBES = ["Thing.", "ÉTÉ!!", "a***", "Straße,", "|", "word", "Word", "x|", "(", "Überhaupt;"]
MARK = "|"
#: Bytes of the longest part, and number of cores, that are remembered.
LONGEST, CORES = 64, 200_000


class Encoder:
    """Token ids of texts, for tokenizers that never join what ASCII white space separates.

    Texts are parted at ASCII white space alone, so anything else that the tokenizer may count as such stays
    inside a part and is left to it.  Where the tokenizer lower-cases and parts letters from signs (it is
    probed for that), plain parts are put together from their letters and their signs; others, and all parts
    for other tokenizers, are encoded as they are.  Ids of up to ``room`` parts are remembered, under 64-bit
    hashes of the parts, in arrays; none over ``LONGEST`` bytes.
    """

    def __init__(self, path: str, room: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.cores, self.tails = {}, {"": b""}
        self.forget()
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        parts = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        made |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": parts}}
        self.bare, self.parted = Tokenizer.from_str(json.dumps(made)), len(self.mark) == 1
        if self.parted:
            found = self.assembled(PROBES)
            self.parted = [np.frombuffer(found[p], "<u4").tolist() for p in PROBES if p in found] == [
                self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES if p in found
            ]
            self.cores, self.tails = {}, {"": b""}

    def forget(self) -> None:
        self.hashes, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def assembled(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of the plain ones among ``parts``."""
        found = [(p, m[1].lower(), m[2]) for p, m in zip(parts, map(PLAIN.fullmatch, parts)) if m]
        cores, tails = self.cores, self.tails
        fresh = [c for c in {c for _, c, _ in found} if c not in cores]
        for at in range(0, len(fresh), 1024):
            some = fresh[at : at + 1024]
            # The mark, a sign, is in no core and parts them, so where each ends shows in the ids alone.
            ids = np.array(self.bare.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            raw, start = ids.tobytes(), 0
            for core, end in zip(some, ends):
                cores[core] = raw[4 * start : 4 * end]
                start = end + 1
        for tail in {t for _, _, t in found}.difference(tails):
            tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
        out = {p: cores[c] + tails[t] for p, c, t in found}
        for core in fresh:
            if len(core) > LONGEST:
                del cores[core]
        if len(tails) > CORES:
            self.tails = {"": b""}
        return out

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, many in one call: where each starts in the joined text tells its ids apart."""
        into = self.assembled(parts) if self.parted else {}
        parts = [p for p in parts if p not in into]
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids))[::2]
            ends = np.cumsum([len(p) + 1 for p in some])
            cuts = [0, *np.searchsorted(offsets, ends).tolist()]
            raw = ids.tobytes()
            for part, a, b in zip(some, cuts, cuts[1:]):
                into[part] = raw[4 * a : 4 * b]
        if len(self.cores) > CORES:
            self.cores = {}
        return into

    def add(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Remember parts by their hashes, which are sorted and new."""
        learned = self.learn(parts)
        raw = [learned[p] for p in parts]
        n = np.fromiter(map(len, raw), np.int32, len(raw)) // 4
        at = len(self.flat) + np.cumsum(n, dtype=np.int64) - n
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(raw), "<u4")])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")  # two sorted runs
        self.hashes, self.at, self.n = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's number, all their ids, and where each text's ids end.  Every
        text's ids are followed by ``end_id``."""
        for first, last, data, ends in slices(texts):
            hashes, starts, lengths, text = words_of(data, ends, lower=False)
            seen, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            spot = np.searchsorted(self.hashes, seen)
            new = np.ones(len(seen), bool)
            inside = spot < len(self.hashes)
            new[inside] = self.hashes[spot[inside]] != seen[inside]
            kept = None
            if new.any():
                at, size = starts[index[new]], lengths[index[new]]
                raw = data.tobytes()
                fresh, long = seen[new], size > LONGEST
                words = [raw[a : a + n].decode("utf-8", "surrogatepass") for a, n in zip(at.tolist(), size.tolist())]
                self.add(fresh[~long], [w for w, x in zip(words, long) if not x])
                if long.any():  # for these texts only
                    kept = self.hashes, self.at, self.n, self.flat
                    self.add(fresh[long], [w for w, x in zip(words, long) if x])
                spot = np.searchsorted(self.hashes, seen)
            n = self.n[spot][inverse].astype(np.int64)
            before = np.cumsum(n) - n
            ids = self.flat[np.arange(n.sum()) + np.repeat(self.at[spot][inverse] - before, n)]
            word_bounds = np.searchsorted(text, np.arange(1, last - first + 1))
            bounds = np.append(0, np.cumsum(n))[word_bounds]  # where each text's ids end
            out = np.empty(len(ids) + last - first, np.uint32)
            closing = bounds + np.arange(last - first)
            own = np.ones(len(out), bool)
            own[closing] = False
            out[own], out[closing] = ids, end_id
            yield first, out, closing + 1
            if kept is not None:
                self.hashes, self.at, self.n, self.flat = kept
            if len(self.hashes) > self.room:
                self.forget()

    def each(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of every text."""
        for _, ids, ends in self(texts, end_id):
            start = 0
            for end in ends.tolist():
                yield ids[start:end]
                start = end


@lru_cache(1)
def encoder(path: str | None = None) -> Encoder:
    """One per worker process; without a path, for the public vocabulary where that worker has it."""
    return Encoder(path or vocabulary_path())
