"""The pipeline's stages, each on its own input."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, SF).cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= set(kept) and docs.count() == len(now)
        if name in ("pii", "bpe"):
            assert now == set(kept)
        elif name == "near_copies":
            assert len(set(kept.values())) >= len(now)
            assert {t: min(i for i, x in kept.items() if x == t) for t in kept.values()}.keys() >= {kept[i] for i in now}
        else:
            assert 0.5 * len(kept) < len(now) < len(kept) or len(now) == len(kept)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() < before


def test_near_copies_leave_one_of_each(spark, make):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(3, a), (1, a), (2, a + " more"), (5, "other"), (5, "twice"), (6, None), (7, None), (None, a), (8, "other")]
    got = corpus_pipeline.drop_near_copies(spark, make(rows), SF)
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=repr) == [(0, a), (1, a), (5, "other"), (6, None), (7, None)]


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.select(F.count_distinct("doc_id")).first()[0] == got.count() > 50


def odd(make):
    clean = "a b c"
    rows = [(1, clean), (1, clean), (2, None), (3, ""), (None, clean), (None, None), (4, "mail bob@example.com"), (5, "word " * 30_000)]
    return rows, make(rows).withColumn("n_chars", F.col("doc_id"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables beside the documents: one benchmark item, and labels of which few are usable."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([("i1", " ".join(["word"] * 12)), (None, "a b c")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(df):
    return sorted((r.doc_id or 0) for r in df.select("doc_id").collect())


def test_stages_on_odd_rows(spark, make, folder):
    rows, docs = odd(make)
    every = sorted(i or 0 for i, _ in rows)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near_copies", "decontamination", "pii"):
        assert stages[name](spark, docs, folder).columns == corpus_pipeline.COLUMNS
    assert set(ids(stages["toxicity"](spark, docs, folder))) <= set(every)
    assert ids(stages["decontamination"](spark, docs, folder)) == [i for i in every if i != 5]
    hidden = stages["pii"](spark, docs, folder).collect()
    assert sorted((r.doc_id or 0) for r in hidden) == every
    by = {r.doc_id: r for r in hidden if r.doc_id}
    assert by[4].text != "mail bob@example.com" and len(by[4].text) == by[4].n_chars == 20 and (by[2].text, by[2].n_chars) == (None, 2) and by[3].n_chars == 0
    tokens = stages["bpe"](spark, docs, folder).collect()
    assert sorted((r.doc_id or 0) for r in tokens) == every and {r.n_tokens for r in tokens if r.doc_id in (2, 3)} == {0}


def test_stages_on_an_empty_table(spark, make, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), folder).collect() == []


def test_run_against_plain_stages(spark):
    """The rows of run() from a plain version of each stage: scores, shingle sets, windows and ids one document at a time."""
    import hashlib
    import re

    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from lodestone.llm import pii, toxicity

    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    model = toxicity.fit(table, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    ids = sorted(texts)
    texts = {i: texts[i] for i, s in zip(ids, model.scores([texts[i] for i in ids]), strict=True) if s < 0.5}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = t.translate(lower).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in texts}
    for _ in range(10):
        for i in texts:
            for j in texts:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    texts = {i: t for i, t in texts.items() if top[i] == i}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        if w := split((r.text or "").translate(lower)):
            windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    leaks = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    texts = {i: t for i, t in texts.items() if not leaks(split(t.translate(lower)))}
    hide, tok = pii.Pseudonyms(corpus_pipeline.KEY), tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in texts.items():
        got = tok.encode(hide.apply(t), add_special_tokens=False).ids
        want.add((i, len(got), sha(" ".join(map(str, got))), sha(tok.decode(got, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want and len(want) > 50
