"""Fingerprints by the edit embedding."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.edit_embedding import Bands, Walk, close_pairs, edited_fingerprints, fingerprints, likeness, near_duplicates


class PlainWalk:
    """The embedding step by step, from the same random numbers but none of the operator's tables of waits."""

    def __init__(self, samples=128, seed=20240):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (64, 4096), dtype=np.uint8)
        self.at: dict[int, list[int]] = {}  # step -> the samples that take what is read there
        for k in range(samples):
            step = 0
            while step < 1 << 48:
                self.at.setdefault(step, []).append(k)
                step = max(step + 1, int((step + 1) / (1 - rng.random())))
        self.salt = [int(x) | 1 for x in rng.integers(1, 1 << 32, samples, dtype=np.uint64)]

    def samples(self, text):
        out, step = [0] * len(self.salt), 0
        for c in map(ord, text):
            kind = (c * 2654435761 % (1 << 32)) >> 26
            while True:
                for k in self.at.get(step, ()):
                    out[k] = (c + 1) * self.salt[k] % (1 << 64) >> 24 & 255
                step += 1
                if (step - 1) % 64 == 0 or self.moves[kind, (step - 1) % 4096]:
                    break
        return out


def test_edits_keep_likeness_and_chance_does_not():
    rng, walk = random.Random(1), Walk()
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    near, far = [], []
    for _ in range(30):
        t = text(2000)
        at = rng.randrange(1000)
        edited = t[:at] + "edit" + t[at + 2 :]
        a, b, c = (walk.start().feed(x) for x in (t, edited, text(2000)))
        near.append(a.likeness(b))
        far.append(a.likeness(c))
        assert abs(likeness(a.fingerprint(), b.fingerprint()) - near[-1]) < 1e-12
    assert sorted(near)[3] > 0.8 and max(far) < 0.3


def test_a_walk_may_be_fed_in_parts():
    walk, text = Walk(), "häß日 " * 30_000
    whole = walk.start().feed(text).fingerprint()
    parts = walk.start()
    for at in range(0, len(text), 7777):
        parts.feed(text[at : at + 7777])
    assert parts.fingerprint() == whole and walk.start().feed("").fingerprint() == "00" * 128


def test_against_a_plain_loop(docs, rows, make):
    for given, df in ((rows, docs), ([(1, "abc")], make([(1, "abc")])), ([(2, None), (2, "zz" * 9), (1, "")], make([(2, None), (2, "zz" * 9), (1, "")]))):
        walk, want = PlainWalk(), []
        tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        ordered = sorted(given, key=lambda r: (-r[0], tie[r[1]], r[1] is not None, r[1] or ""))
        for n, (i, t) in enumerate(ordered):
            t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
            cut = len(t) // 3
            e = t[: len(t) - cut] + after[:cut]
            a, b, c = map(walk.samples, (t, e, after))
            same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), same(a, b), same(a, c)))
        assert sorted(tuple(r) for r in edited_fingerprints(df).collect()) == sorted(want)
    assert edited_fingerprints(make([])).collect() == []


def test_near_duplicates(docs, rows, make):
    got = {r.doc_id: r.component for r in near_duplicates(docs, 0.7).collect()}
    text = dict(rows)
    assert set(got) == set(text)
    first = {}
    for i in sorted(text):
        assert got[i] == got[first.setdefault(text[i] or "", i)]
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=3000))
    near = [(i, base[:-5] + str(i)) for i in range(20)] + [(50, "".join(rng.choices("abcdefgh ", k=3000)))]
    assert {r.doc_id: r.component for r in near_duplicates(make(near)).collect()} == {**{i: 0 for i in range(20)}, 50: 50}
    prints = fingerprints(make([(1, "same"), (2, "same"), (3, None)])).collect()
    assert len({r.fingerprint for r in prints if r.doc_id < 3}) == 1


def test_near_copies_behind_unrelated_smaller_ones(make):
    """Texts of two letters share bands by chance, so each band of the two near copies has a smaller unrelated member."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("ab", k=n))
    base = text(3000)
    rows = [(i, text(1000)) for i in range(300)] + [(1000, base), (1001, base[:-9] + "bababbaab")]
    walk = Walk()
    prints = [(i, walk.start().feed(t)) for i, t in rows]
    top = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if a.likeness(b) >= 0.75:
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = {k: new if v == old else v for k, v in top.items()}
    assert top[1001] == 1000
    for sizes in ({}, {"block": 40}):
        assert {r.doc_id: r.component for r in near_duplicates(make(rows), **sizes).collect()} == top


def test_recall_on_the_test_table(spark):
    """Pairs of the registered query's classes against all pairs of fingerprints that agree in 0.75 of samples or more."""
    from lodestone.llm.queries import fingerprint_classes

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = {r.doc_id: r.component for r in fingerprint_classes(spark, sf).collect()}
    prints = {r.doc_id: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for r in fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    ids = sorted(prints)
    every = np.stack([prints[i] for i in ids])
    pairs = [(i, ids[j]) for n, i in enumerate(ids) for j in np.flatnonzero((every[:n] == every[n]).mean(1) >= 0.75)]
    assert set(got) == set(ids) and len(pairs) > 100
    assert sum(got[i] == got[j] for i, j in pairs) == len(pairs)  # recall 1.0
    top = {i: i for i in ids}
    for _ in range(20):  # classes by the plain pairs
        for i, j in pairs:
            top[i] = top[j] = min(top[i], top[j])
    assert got == top


def test_bands_meet_all_near_pairs_and_few_others():
    """Most texts begin alike, so samples of early steps agree by chance: bands that hold several of them would unite most texts."""
    rng, walk = random.Random(3), Walk()
    text = lambda: rng.choice(["the ", "the ", "a "]) + "".join(rng.choices("etaoinshrdlu      ", k=rng.randint(300, 2000)))
    texts = [text() for _ in range(600)]
    texts += [t[: len(t) * i // 8] + "".join(rng.choices("xyz", k=5)) + t[len(t) * i // 8 + 5 :] for t in texts[:60] for i in (3, 5, 7)]
    every = np.stack([walk.start().feed(t).values for t in texts])
    agree = (every[:, None] == every[None]).sum(2)
    for need in (96, 90, 122, 128):
        bands = Bands(walk, need)
        assert sorted(bands.order.tolist()) == list(range(128))
        prints, own = every[:, bands.order], np.arange(len(texts))
        met, kept = np.zeros_like(agree, bool), np.zeros_like(agree, bool)
        for i, (g, at, size) in enumerate(bands.firsts()):
            first, n, edges = bands.groups[g]
            group = prints[:, first : first + n]
            assert at == first + edges[i % (bands.few + 1)] and size > 0
            for keys in bands.keys(i, group):
                met |= keys[:, None] == keys[None]
                for few, into in ((n, None), (bands.few, kept)):
                    pairs = np.concatenate([np.stack(p, 1) for p in close_pairs(keys, own, group, few, 100)] or [np.zeros((0, 2), int)])
                    if into is None:
                        assert 2 * len(pairs) == (keys[:, None] == keys[None]).sum() - len(texts)
                    else:
                        into[pairs[:, 0], pairs[:, 1]] = into[pairs[:, 1], pairs[:, 0]] = True
        near = np.triu(agree >= need, 1)
        assert need == 128 or near.sum() > 50
        assert kept[near].all() and (np.triu(kept, 1) & ~near).sum() < 400  # kept by a group's samples alone
        if need == 96:  # far pairs that are compared, beside those that 33 plain bands unite
            cuts, plain = [128 * i // 33 for i in range(34)], np.zeros_like(met)
            for x, y in zip(cuts, cuts[1:]):  # noqa: B905
                plain |= (every[:, None, x:y] == every[None, :, x:y]).all(2)
            far = np.triu(agree < 64, 1)
            assert 10 * (met & far).sum() < (plain & far).sum()


def test_pairs_of_one_class_are_not_compared():
    keys, group = np.zeros(5000, np.uint64), np.zeros((5000, 30), np.uint8)
    classes = np.zeros(5000, np.int64)
    assert list(close_pairs(keys, classes, group, 0)) == []
    classes[17] = 1
    assert sum(len(x) for x, _ in close_pairs(keys, classes, group, 0, 100)) == 4999
