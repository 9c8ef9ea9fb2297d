"""A pipeline over the documents: toxic ones go, near copies go, benchmark leaks go, personal data is hidden, texts become tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, jaccard_join, pii, toxicity
from lodestone.llm.common import staged

#: For the invented documents here; a pipeline over real ones needs a secret of its own.
KEY = b"an example, not a secret"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among ``docs``, scores below 0.5.

    Null and empty texts score the base rate, very long ones are read whole; rows with a null
    doc_id are scored but not learnt from; repeated rows go or stay together; a score of
    exactly 0.5 rejects; an empty table gives no rows; other columns are left out.
    """
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=tuple(COLUMNS))
    # the scorer passes text on beside the copy that it reads
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id; rows without doc_id stay.

    Of rows that repeat a doc_id that stays, the one with the smallest text is kept. Null and
    empty texts link with nothing and stay; an empty table gives no rows; other columns are
    left out.
    """
    classes = jaccard_join.similar(docs, 5, 75)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = staged(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(once.select("doc_id", "row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any occurrence of a benchmark window.

    Null and empty texts have no words and stay; rows are judged by their own text, also where
    doc_id is null or repeated, so repeated rows go or stay together; an empty table, or an
    empty benchmark, changes nothing; other columns are left out.
    """
    found = decontamination.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    hit = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    source = docs.select(*COLUMNS)
    return source.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms; n_chars follows the text.

    A null text stays null and keeps its n_chars; empty and clean texts stay as they are; rows
    with a null or repeated doc_id are treated each for itself; an empty table gives no rows;
    other columns are left out.
    """
    hidden = pii.pseudonymise(docs.select(*COLUMNS), KEY)
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts' token ids and of what these decode to.

    A null text counts as empty; every row gives one, also where doc_id is null or repeated; an
    empty table gives no rows; other columns are left out.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", tokenise),
]

#: A classifier fitted by gradient descent is not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of ``documents``, each stage written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
