"""Toxicity scores from a character n-gram classifier scaled by naive Bayes log-count ratios.

Training takes labelled documents. Of each document the distinct n-grams of 3 to 5
characters (letters in lower case; everything else counts as a space) are hashed into
``2**BITS`` features. Spark sums, for each feature, the documents of either class that have
it; the log ratio r of the smoothed shares is the feature's scale. The ``features``
features whose presence tells most about the label are kept, and a logistic regression on
r * presence is fitted by gradient descent, weights held near their mean size so that the
model interpolates between naive Bayes and the free fit.

Counts and fit read a bounded sample: at most ``sample`` labelled documents, those with the
smallest hashes of doc_id, whatever the size of the tables. Scoring covers every document
and the whole text.

The ``features`` that are kept (1,024 by default) bound the model: n-grams beyond them tell
least about the label and weigh nothing.

Defined cases: a very long text is read in overlapping parts and counts each n-gram once; a null text counts as empty and scores the base rate; documents with a null
doc_id are scored but never learnt from; labels that are null or not 0 or 1 are left out;
without labels of both classes every score is the base rate (0.0 without labels), which is
reported as it is; a score of exactly 0.5 counts as toxic; repeated rows are scored alike;
an empty table gives no rows; columns besides doc_id, text and the kept ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import staged

BITS, SIZES = 18, (3, 4, 5)
FACTORS = np.asarray([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
#: Texts are hashed together up to this many characters, a longer one in overlapping parts.
BLOCK = 1 << 18


def _letters() -> np.ndarray:
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


LETTERS = _letters()


def _hits(texts: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of the n-grams whose entry in ``table`` is not below 0; may repeat."""

    def parts():
        doc, held, size = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                piece = " " + t[max(0, at - max(SIZES)) : at + BLOCK] + " "
                doc.append((i, len(piece)))
                held.append(piece)
                size += len(piece)
                if size >= BLOCK:
                    yield doc, "".join(held)
                    doc, held, size = [], [], 0
        if held:
            yield doc, "".join(held)

    for doc, text in parts():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(codes < len(LETTERS), LETTERS[np.minimum(codes, len(LETTERS) - 1)], codes)
        of = np.repeat(np.asarray([i for i, _ in doc]), [n for _, n in doc])
        hashed, n_done = np.zeros(len(codes), np.uint32), 0
        for n in SIZES:
            for k in range(n_done, n):
                m = len(codes) - k
                hashed[: max(m, 0)] += codes[k:] * FACTORS[k]
            n_done = n
            m = len(codes) - n + 1
            if m <= 0:
                break
            got = table[((hashed[:m] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)]
            at = np.flatnonzero(got >= 0)
            at = at[of[at] == of[at + n - 1]]  # not across two texts
            yield of[at], got[at]


def presence(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, sorted."""
    top = int(table.max(initial=0)) + 1
    found = [np.unique(d.astype(np.int64) * top + f) for d, f in _hits(texts, table)]
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // top, both % top


class Model:
    """``table`` gives a hash's feature or -1; the score is the logistic of bias + the weights of the features present."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, feature = presence(texts, self.table)
        z = self.bias + np.bincount(doc, self.weights[feature], len(texts)) if len(doc) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fit(docs: DataFrame, labels: DataFrame, features: int = 1024, sample: int = 8000, rounds: int = 400, decay: float = 3e-4) -> Model:
    """A model from the texts of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks 0 or 1.

    A document with several labels counts as toxic if one says so; of several texts with one
    doc_id the smallest is read.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # ``sample`` rows of two numbers: small enough to send to every task
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = staged(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))

    def count(batches):
        every, seen = np.arange(1 << BITS, dtype=np.int32), np.zeros((2, 1 << BITS), np.int64)
        n, has = np.zeros(2, np.int64), np.zeros(1 << BITS, bool)
        for b in _slices(batches):
            for text, label in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                has[:] = False
                for _, feature in _hits([text.as_py() or ""], every):
                    has[feature] = True
                seen[label] += has
                n[label] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], n[0])), pa.array(np.append(seen[1][at], n[1]))], ["feature", "clean", "toxic"])

    sums = rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = np.asarray([tuple(r) for r in sums.collect()], np.int64).reshape(-1, 3)  # 2**BITS rows at most
    n0, n1 = got[got[:, 0] < 0, 1:].sum(0) if len(got) else (0, 0)
    empty = np.full(1 << BITS, -1, np.int32)
    if not n0 or not n1:
        base = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(empty, np.zeros(1), float(np.log(base / (1 - base))) if 0 < base < 1 else 500.0 * (1 if base else -1))
    got = got[got[:, 0] >= 0]
    p, q = (got[:, 2] + 1) / (n1 + 2), (got[:, 1] + 1) / (n0 + 2)
    both, share = (p * n1 + q * n0) / (n0 + n1), n1 / (n0 + n1)
    tells = share * (p * np.log(p / both) + (1 - p) * np.log((1 - p) / (1 - both))) + (1 - share) * (q * np.log(q / both) + (1 - q) * np.log((1 - q) / (1 - both)))
    kept = got[np.lexsort((got[:, 0], -tells))[:features]]
    order = np.argsort(kept[:, 0])
    kept = kept[order]
    ratio = np.log(((kept[:, 2] + 1) / (n1 + 2)) / ((kept[:, 1] + 1) / (n0 + 2)))
    empty[kept[:, 0]] = np.arange(len(kept), dtype=np.int32)
    table = empty

    def vectors(batches):
        for b in _slices(batches):
            doc, feature = presence([t.as_py() or "" for t in b.column(1)], table)
            ends = np.cumsum(np.bincount(doc, minlength=b.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(2), lists], ["label", "present"])

    fitted = rows.orderBy("doc_id").mapInArrow(vectors, "label int, present array<int>").toArrow()
    y = fitted.column("label").to_numpy().astype(float)
    lists = fitted.column("present").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    feature = np.asarray(lists.values)
    scale = ratio[feature]
    w, bias = np.full(len(kept), 1e-3), float(np.log(n1 / n0))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(doc, scale * w[feature], len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.append(np.bincount(feature, scale * err[doc], len(w)) / len(y) + decay * (w - w.mean()), err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(table, ratio * w, float(bias))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``, from 0 to 1, of its column text; a kept column named score would clash and is refused."""
    if "score" in keep:
        raise ValueError("a column named score cannot be kept beside the score")
    kept = list(keep)
    copy = "text_"
    while copy in kept:
        copy += "_"
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias(copy))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "score double"])

    def run(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores([t.as_py() or "" for t in b.columns[-1]]), pa.float64())], [*kept, "score"])

    return source.mapInArrow(run, fields)


def learnable(labels: DataFrame, learn: bool = True) -> DataFrame:
    """The rows of ``labels`` that may be learnt from (or, else, that are held out)."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return labels.where(rest != 0 if learn else rest == 0)
