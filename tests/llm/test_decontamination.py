"""Benchmark words in documents against a plain search."""

import re
from collections import defaultdict

import pytest

from lodestone.llm.decontamination import contamination

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, width=10):
    held = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - width + 1)):
                held[tuple(w[k : k + width])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if q := held.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    found |= q
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(docs, bench, **more).collect()), key=repr)


ITEMS = [(1, " ".join(f"q{i}" for i in range(25))), (2, "Short ITEM three"), (10, "alone"), (3, None), (4, "..."), (None, "lost item here"), (5, "Köln ÜBER straße 日本 x"), (2, "another text of two"), (20, "alpha beta ΟΔΟΣ.ΑΘΗΝΑ gamma delta epsilon zeta eta theta iota kappa lambda"), (21, "istanbul k9"), (22, "İSTANBUL K9"), (23, "one TWO"), (24, "One two"), (6, "the the the the the the the the the the the the"), (7, "twelve words that all are in one window or two of the item")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, make, limit):
    q = [f"q{i}" for i in range(25)]
    rows = [
        (1, " ".join(q)), (2, "pre " + ", ".join(q[3:14]).upper() + " post"), (3, " ".join(q[:9])), (4, "a short item, three: and SHORT item three"), (5, "alone-alone ALONE"),
        (6, None), (7, ""), (8, "köln Über straße"), (9, "Köln ÜBER STRAße 日本 x"), (10, "the " * 30), (11, "lost item here"), (None, "alone in null"), (12, " ".join(q[:12] + ["x"] + q[12:])),
        (15, "alpha beta ΟΔΟΣ.ΑΘΗΝΑ gamma delta epsilon zeta eta theta iota kappa lambda"), (16, "alpha beta ΟΔΟΣ ΑΘΗΝΑ gamma delta epsilon zeta eta theta iota kappa lambda"), (17, "alpha beta οδος ΑΘΗΝΑ gamma delta epsilon zeta eta theta iota kappa"),
        (18, "İstanbul K9 ISTANBUL k9 and İSTANBUL K9"), (19, "two"), (20, "ONE two"), (21, "one, two"), (22, "one one two two"),
        (13, "words " * 2000 + "another text of two"), (1, " ".join(q)), (1, "other text, alone"), (14, "K alone"),
    ]
    assert run(spark, make(rows).repartition(3), ITEMS, broadcast_bytes=limit) == brute(rows, ITEMS)


def test_random_texts(spark, docs, rows):
    text = max((t for _, t in rows if t), key=len)
    items = [(n, " ".join(words(text)[n * 40 : n * 40 + 7 + n])) for n in range(20)] + [(100, rows[5][1])]
    got = run(spark, docs, items)
    assert got == brute(rows, items) and any(r[2] for r in got)


def test_empty_tables(spark, make):
    assert run(spark, make([]), ITEMS) == []
    assert run(spark, make([(1, "some words")]), []) == [(1, 2, 0, [])]


def test_no_python_on_the_main_path(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contamination(make([(1, "a b")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_items_and_one_size_of_shingle(spark, make):
    items = [(1, " ".join(f"q{i}" for i in range(40))), (2, " ".join(f"q{i}" for i in range(15, 30)))]
    rows = [(1, " ".join(f"q{i}" for i in range(12, 33))), (2, " ".join(f"q{i}" for i in range(9))), (None, None), (3, " ".join(f"q{i}" for i in [*range(10), *range(10)]))]
    for limit in (1 << 20, 0):
        assert run(spark, make(rows), items, broadcast_bytes=limit) == brute(rows, items)


def test_texts_are_taken_apart_once(spark, make):
    """No plan after the notes reads the documents again."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contamination(make([(1, "a b")]).repartition(2), bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "split" not in plan
