"""The operators' registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: For the registered query over invented texts; real data needs a secret of its own.
EXAMPLE_KEY = b"an example, not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import removed_passages

    found = removed_passages(_table(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard

    placed = shard(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard_join import similar

    return similar(_table(spark, sf_dir, "documents"), 5, 75)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.edit_embedding import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banding and verification of the fingerprints: each document's class of near ones."""
    from lodestone.llm.edit_embedding import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), EXAMPLE_KEY).select("doc_id", "n_pii", "text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import read_back, write_archives

    return read_back(spark, write_archives(_table(spark, sf_dir, "pages")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import fit, learnable, score

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, learnable(_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if callable(f) and (name.startswith("op") or f is fingerprint_classes)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.oracle import SQL

    return dict(SQL)
