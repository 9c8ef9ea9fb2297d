import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, ids string, score double, node long, path string"


def make_rows(seed=1, n=60):
    """Random texts, copies, near copies, shared passages, odd and very long ones, nulls and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(300)] + ["Ünï", "naïve", "Straße", "日本", "it's", "x,y."]
    text = lambda k: "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in rng.choices(vocab, k=k))
    passage = text(60)
    texts = [text(rng.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 5):
        texts.append(texts[i])  # exact copies
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words).upper() if i % 2 else " ".join(words))  # near copies
        texts.append(text(20) + passage + text(rng.randint(0, 30)))  # a shared passage
    texts += [None, "", " ", "\n\t", "one", "one two three", "ONE two three", "a " * 50, "long " + text(6000), text(3000) + passage, "x" * 5000]
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, "x", 0.5, -1, "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="session")
def make(spark):
    return lambda given: frame(spark, given)
