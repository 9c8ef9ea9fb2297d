"""Words of whole batches of texts as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken apart at once; bounds the memory that a batch of any size takes.
BLOCK = 1 << 20
#: Longer words are hashed by BLAKE2, one by one.
LONG = 1024
BREAKS = np.zeros(256, bool)
BREAKS[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(1234)


def _odd(*shape: int) -> np.ndarray:
    return _rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Factors of the two independent hashes: of a word's blocks and length, and of the words of a run.
WORD = _odd(2, 3)
FACTORS = _odd(2, 64)
#: Keeps the first n bytes of eight.
FIRST = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some documents, one after another: their hashes, and where each document begins.

    ``second`` holds hashes that do not depend on the first ones, or None.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, second: np.ndarray | None = None):
        self.hashes, self.first, self.second = hashes, first, second

    def _of(self, second: bool) -> tuple[np.ndarray, np.ndarray]:
        return (self.second, FACTORS[1]) if second else (self.hashes, FACTORS[0])

    def run(self, at: int, n: int, shift: int = 0, second: bool = False) -> np.ndarray:
        """The hash of the run of ``n`` words that starts at ``at``, alone."""
        hashes, factors = self._of(second)
        h = sum((hashes[at + j : at + j + 1] * factors[(j + shift) % len(factors)] for j in range(n)), np.zeros(1, np.uint64))
        return mix(h)

    def grams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the run of ``n`` words that starts at each word; runs over a document's end aren't valid."""
        hashes, factors = self._of(second)
        size = len(hashes)
        h = np.zeros(size, np.uint64)
        for j in range(n):
            h[: max(0, size - j)] += hashes[j:] * factors[j % len(factors)]
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(size)
        return mix(h), left >= n


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at documents' bounds where these come often enough, else at white space; a longer word stays whole."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        to = end
        if end - at > BLOCK:
            k = int(np.searchsorted(bounds, at + BLOCK, "right")) - 1
            to = int(bounds[k])
            if to <= at:
                gaps = np.flatnonzero(BREAKS[data[at : at + BLOCK]])
                to = at + int(gaps[-1]) + 1 if len(gaps) else at + BLOCK
                while to < int(bounds[k + 1]) and not BREAKS[data[to - 1]]:
                    to += 1
        yield at, to
        at = to


def _hashes(padded: np.ndarray, begin: np.ndarray, stop: np.ndarray, kinds: int) -> list[np.ndarray]:
    """``kinds`` hashes of each word: eight bytes after eight are mixed into a state, which no sum or product of letters can undo."""
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = stop - begin
    first = eights[begin] & FIRST[np.minimum(length, 8)]
    out = [mix(first * f[0] + length.astype(np.uint64) * f[2]) for f in WORD[:kinds]]
    more, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(more):
        block = eights[begin[more] + at] & FIRST[np.minimum(length[more] - at, 8)]
        for h, f in zip(out, WORD, strict=False):
            h[more] = mix((h[more] ^ block) * f[1])
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(padded[begin[i] : stop[i]].tobytes(), digest_size=16).digest()
        for n, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * n : 8 * n + 8], "little")
    return out


def split_words(texts: pa.Array, lower: bool = False, twice: bool = False) -> Words:
    """Words between ASCII white space of a string array; A-Z count as a-z if ``lower``. A null text has none.

    ``twice`` adds a second, independent hash of each word.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    kinds = 2 if twice else 1
    hashes, starts = [[] for _ in range(kinds)], []
    for at, to in _segments(data, bounds):
        part = LOWER[data[at:to]] if lower else data[at:to]
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        visible = ~BREAKS[part]
        edge = np.zeros(len(part) + 1, bool)  # a document begins here, so a word cannot go on
        lo, hi = np.searchsorted(bounds, (at, to))
        edge[bounds[lo:hi] - at] = True
        edge = edge[:-1]
        before = np.concatenate([[False], visible[:-1]])
        begin = np.flatnonzero(visible & (~before | edge))
        after = np.concatenate([visible[1:], [False]])
        stop = np.flatnonzero(visible & (~after | np.concatenate([edge[1:], [True]]))) + 1
        for held, h in zip(hashes, _hashes(padded, begin, stop, kinds), strict=True):
            held.append(h)
        starts.append(begin + at)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    found = [join(h, np.uint64) for h in hashes]
    return Words(found[0], np.searchsorted(join(starts, np.int64), bounds), found[1] if twice else None)
