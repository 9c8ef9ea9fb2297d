"""The classifier on held-out documents, and on odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.toxicity import BITS, FACTORS, LETTERS, SIZES, fit, learnable, presence, score


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    bad = ["zorkish", "vilequx", "mudwump"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 80))
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).title() + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_documents(spark, make):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make(rows)
    model = fit(docs, learnable(table))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in learnable(table, False).collect()} == set(held)
    right = [(got[i] >= 0.5) == bool(labels[i][2]) for i in held]
    assert len(held) > 80 and np.mean(right) > 0.95 and all(0 <= s <= 1 for s in got.values())


def test_odd_rows(spark, make):
    rows, labels = corpus(200)
    labels += [(5, 0, None), (6, 0, 7), (None, 1, 1), (0, 0, 0)]
    odd = [(None, "zorkish"), (1000, None), (1001, ""), (1002, "x" * 600_000 + " Zorkish"), (1003, "Zorkish"), (1003, "Zorkish"), (1004, "日本 🙂")]
    docs = make(rows + odd)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=150)
    got = score(docs, model, keep=("doc_id", "text", "path")).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1004] < 0.5 < by[1003] and abs(by[1002] - by[1003]) < 0.5
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in score(docs, none).collect()} == {1 / (1 + np.exp(500.0))}
    every = fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in score(docs, every).collect())
    assert score(make([]), model).collect() == []
    again = score(docs.withColumn("text_", F.lit(1)), model, keep=("doc_id", "text_")).collect()
    assert sorted(r.score for r in again) == sorted(r.score for r in got) and {r.text_ for r in again} == {1}
    with pytest.raises(ValueError, match="score"):
        score(docs, model, keep=("score",))


def test_presence_against_a_plain_loop():
    texts = ["", "ab", "Äb c!d", "a" * 300_000, "the cat", "THE CAT"]
    table = np.arange(1 << BITS, dtype=np.int32)
    doc, feature = presence(texts, table)
    have = [set(feature[doc == i].tolist()) for i in range(len(texts))]
    assert have[4] == have[5] and len(have[3]) == 9 and len(have[0]) == 0
    assert len(have[1]) == 3  # " ab", "ab ", " ab "
    assert LETTERS[ord("!")] == 32 and LETTERS[ord("Ä")] == ord("ä")


def test_the_query_on_held_out_labels(spark):
    """The registered query against the labels that it may not learn from, and its scores against a plain sum of weights."""
    import os

    from lodestone.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = {r.doc_id: r for r in op9_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out}
    right = [got[i].predicted == t for i, t in truth.items()]
    caught = [got[i].predicted for i, t in truth.items() if t]
    assert len(caught) > 20 and np.mean(right) >= 0.95 and np.mean(caught) >= 0.8, (len(caught), np.mean(right), np.mean(caught))


def test_scores_against_a_plain_sum(spark, make):
    """Each n-gram of a text once, by a loop over its characters."""
    rows, labels = corpus(300, seed=4)
    model = fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in score(make(rows), model).collect()}
    for i, text in rows[:60]:
        codes, seen = [int(LETTERS[ord(c)]) for c in f" {text} "], set()
        for n in SIZES:
            for at in range(len(codes) - n + 1):
                h = sum(c * int(FACTORS[k]) for k, c in enumerate(codes[at : at + n])) + n
                seen.add(int(model.table[(h * 2654435761 % (1 << 32)) >> (32 - BITS)]))
        z = model.bias + sum(model.weights[f] for f in seen if f >= 0)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
