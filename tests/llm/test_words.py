"""Word hashes and packed keys."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import words as words_module
from lodestone.llm.packed import by_bucket, contains, pack, unpack
from lodestone.llm.words import split_words


@pytest.mark.parametrize("block", [1 << 20, 16, 5])
def test_words_are_those_of_bytes_split(monkeypatch, block):
    monkeypatch.setattr(words_module, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(100):
        texts = [rng.choice([None, "", " ", "".join(rng.choices("abAB \t\né\x1c", k=rng.randint(0, 40)))]) for _ in range(rng.randint(1, 6))]
        for low in (False, True):
            got = split_words(pa.array(["skip", *texts], pa.string()).slice(1), low)
            want = [(t or "").encode().lower().split() if low else (t or "").encode().split() for t in texts]
            assert np.diff(got.first).tolist() == [len(w) for w in want]
            seen = {}
            for h, w in zip(got.hashes.tolist(), [x for w in want for x in w], strict=True):
                assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)


def test_runs_of_words_end_with_their_document():
    got = split_words(pa.array(["a b c", "b c", "a b c d"]))
    h, valid = got.grams(3)
    assert valid.tolist() == [True, False, False, False, False, True, True, False, False] and h[0] == h[5] != h[6]


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for top in (3, 1 << 20, 1 << 50, (1 << 64) - 1):
            keys = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (unpack(pack(keys)) == keys).all() and len(unpack(pack(keys))) == n
    keys = np.sort(rng.integers(0, 1 << 48, 1000, dtype=np.uint64))
    found = list(by_bucket(keys, 7, 48))
    assert [b for b, _ in found] == list(range(7)) and sum(s.stop - s.start for _, s in found) == 1000
    assert list(by_bucket(keys[:0], 7, 48)) == []
    assert contains(keys[::2], keys).sum() >= 500 and not contains(keys[:0], keys).any()
