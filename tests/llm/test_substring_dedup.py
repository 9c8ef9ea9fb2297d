"""Repeated passages against a plain scan in order."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm.substring_dedup import removed_passages


def brute(rows, width=20, tie=None):
    """``tie``: the hash of each text, for rows that share a doc_id."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (tie or {}).get(r[1], 0), r[1] is None, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            q = tuple(w[k : k + width])
            if q in seen:
                gone[k : k + width] = [True] * width
            seen.add(q)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def hashes(spark, rows):
    return {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_against_brute_force(docs, rows):
    got = removed_passages(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(brute(rows), key=key)
    for r in got:
        assert sum(r.lengths) == r.n_removed and all(a + n < b for a, n, b in zip(r.starts, r.lengths, r.starts[1:], strict=False))
        assert all(n >= 20 for n in r.lengths)
    assert sum(r.n_removed for r in got) > 500


def test_odd_rows(spark, make):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (5, long), (5, long), (5, "x " + long), (None, None), (7, None), (8, long + " " + long)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in removed_passages(make(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, tie=hashes(spark, rows)), key=key)
    assert removed_passages(make([])).collect() == []
    with pytest.raises(ValueError, match="18"):
        removed_passages(make(rows), 18)


def test_one_text_in_many_documents(make):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 3 else f"own{i} " + text) for i in range(200)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in removed_passages(make(rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_hot_ids_are_dealt_over_chunks(spark, make):
    """Rows without an id, and rows of one id, in an order of their own."""
    long = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(long[n : n + 30])) for i in (None, 7) for n in range(30)] + [(3, " ".join(long[5:29])), (None, " ".join(long[:30]))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in removed_passages(make(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, tie=hashes(spark, rows)), key=key)


def test_words_that_sums_of_powers_confuse(make):
    a, b = ("".join("ab"[(bin(i).count("1") + start) % 2] for i in range(1024)) for start in (0, 1))
    same = " ".join(f"w{i}" for i in range(19))
    assert [r.n_removed for r in removed_passages(make([(1, f"{same} {a}"), (2, f"{same} {b}")])).collect()] == [0, 0]
