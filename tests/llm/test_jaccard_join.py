"""Components of similar documents against all pairs."""

import random

import numpy as np
import pytest

from lodestone.llm import jaccard_join
from lodestone.llm.jaccard_join import Chunk, Index, least_overlap, links, similar


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        x, y = find(i), find(j)
                        top[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i in sets for s in sets[i])


def test_search_finds_what_counting_finds():
    rng = random.Random(2)
    sets = []
    for _ in range(120):
        s = set(rng.sample(range(60), 30)) if rng.random() < 0.5 or not sets else set(sets[rng.randrange(len(sets))])
        for _ in range(rng.randint(0, 8)):
            s.discard(rng.randrange(60))
            s.add(rng.randrange(200))
        sets.append(s)
    index = Index([np.sort(np.array(sorted(s))) for s in sets], np.array([len(s) for s in sets]))
    mask = np.arange(len(sets)) % 3 > 0
    for s in sets:
        for wanted in (np.ones(len(sets), bool), mask):
            got = index.search(np.array(sorted(s)), len(s), 75, wanted)
            want = {i: len(s & t) for i, t in enumerate(sets) if wanted[i] and len(s & t) >= least_overlap(len(s), len(t), 75)}
            assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [1000, 4])
def test_against_all_pairs(docs, rows, block):
    got = similar(docs, block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert any(r.component_id != r.doc_id for r in got)


def test_chains_of_near_copies(make):
    """Neighbours link and the ends do not; groups larger than a block are split."""
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[2 * n : 2 * n + 60])) for n in range(40)] + [(100 + n, " ".join(f"v{i}" if i != n else "new" for i in range(80))) for n in range(30)]
    rng = random.Random(1)
    rng.shuffle(rows)
    for block in (1000, 7):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar(make(rows), block=block).collect()) == brute(rows)


def test_odd_rows(make):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(3, a), (3, a), (1, a), (4, None), (5, None), (6, ""), (7, "one"), (8, "ONE"), (9, "one two")]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar(make(rows)).collect()) == sorted([*brute(dict(rows).items()), (3, 26, 1)])
    got = {(r.doc_id, r.component_id) for r in similar(make([(None, a), (2, a), (None, "alone"), (None, None)])).collect()}
    assert got == {(None, 2), (2, 2), (None, None)}
    assert similar(make([])).collect() == []


def test_a_task_holds_two_blocks_at_most(make, monkeypatch):
    """Documents of shared passages: one group of sets that link with none but a few."""
    rng = random.Random(4)
    passages = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(90)]
    rows = [(n, " ".join(passages[(n * k + s) % 90] for k, s in ((1, 0), (1, 1), (7, 2), (11, 5)))) for n in range(90)]
    rows += [(100 + n, rows[n][1] + f" more{n}") for n in range(0, 90, 9)]
    rng.shuffle(rows)
    given = []
    plain = jaccard_join._searched

    def searched(frame, percent, every=False):
        given.append(frame)
        return plain(frame, percent, every)

    monkeypatch.setattr(jaccard_join, "_searched", searched)
    got = similar(make(rows), block=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    keys = [c for c in given[-1].columns if c in ("grp", "block", "low", "high")]
    assert given[-1].select("node").distinct().count() > 80  # in one group of nine blocks
    assert max(r["count"] for r in given[-1].groupBy(keys).count().collect()) <= 45


def test_a_head_of_many_sets_is_dealt_over_tasks(make, monkeypatch):
    """Near copies of one text, whose rarest shared shingles lead all of them to the same head."""
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*words, f"own{n}"] if n % 2 else [*words[1:], f"own{n}"])) for n in range(120)]
    given = []
    plain = jaccard_join._searched

    def searched(frame, percent, every=False):
        given.append(frame)
        return plain(frame, percent, every)

    monkeypatch.setattr(jaccard_join, "_searched", searched)
    got = similar(make(rows), block=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.component_id for r in got} == {0}
    heads = given[1]
    assert heads.where("upper").select("node").distinct().count() > 100
    assert heads.where("low < 0").select("grp", "low").distinct().count() >= 10  # one head, many tasks
    assert max(r["count"] for r in heads.groupBy("grp", "low", "high").count().collect()) <= 45


@pytest.mark.parametrize("block", [1000, 7])
def test_every_link_between_different_sets(docs, rows, block):
    found, member = links(docs, block=block)
    node = {r.doc_id: r.node for r in member.collect()}
    sets = {i: shingles(t) for i, t in rows if shingles(t)}
    assert node == {i: min(j for j, t in sets.items() if t == s) for i, s in sets.items()}
    heads = sorted(set(node.values()))
    want = [(i, j) for i in heads for j in heads if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert sorted((r.a, r.b) for r in found.collect()) == want and want


def thue_morse(start, n):
    return "".join("ab"[(bin(i).count("1") + start) % 2] for i in range(n))


def test_words_that_sums_of_powers_confuse(make):
    a, b = thue_morse(0, 1024), thue_morse(1, 1024)
    assert {(r.doc_id, r.component_id) for r in similar(make([(1, a), (2, b), (3, a + b), (4, b + a)])).collect()} == {(n, n) for n in (1, 2, 3, 4)}


def test_a_shingle_that_more_sets_have_than_16_bits_count(spark, make):
    """The counts of shared shingles must not wrap: the documents here share one shingle with all others and six with each other."""
    common = "s0 s1 s2 s3 s4"
    rows = [(1, common + " x0 x1 x2 x3 x4 x5"), (2, common + " x0 x1 x2 x3 x4 y5")]
    many = spark.range(10, 10 + (1 << 16) - 2).selectExpr("id as doc_id", f"concat('{common} ', id) as text")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = similar(make(rows).select("doc_id", "text").union(many)).where("doc_id < 10").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 7, 1), (2, 7, 1)}


def test_hot_ids_are_dealt_over_chunks(make):
    texts = [f"own{n} " + "x y z " * n for n in range(60)]
    got = similar(make([(None, t) for t in texts] + [(7, t) for t in texts])).collect()
    assert len(got) == 120 and {r.component_id for r in got if r.doc_id == 7} == {7}


def test_names_of_equal_sets_alone_agree():
    import pyarrow as pa

    made = Chunk(pa.table({"doc_id": pa.array([1, 2, 3, 4]), "text": ["a b c d e f", "A b  c d e f", "a b c d f e", "a b"]}), 5)
    assert made.names[0] == made.names[1] != made.names[2] and made.first == [True, False, True, True]
