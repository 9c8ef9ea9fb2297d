"""Helpers that the text operators share: shared folders, staging, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master (tests on one
    machine) may leave it unset; then a temporary folder is made. Elsewhere that is an error,
    as each machine would write to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def write_staged(df: DataFrame) -> str:
    """Write ``df`` to a new folder in the shared one and return its path."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write_staged(df))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """How many parts a keyed exchange gets; the session's setting follows the input's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of ``docs``, from one pass over the column."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def pieces_of(n_bytes: int, least: int, each: int) -> int:
    """How many pieces of about ``each`` bytes make ``n_bytes``, at least ``least``: pieces keep their size when the input grows."""
    return max(least, -(-n_bytes // each))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as rows (node, component).

    component is the smallest node that is reachable; nodes without an edge to another
    node are left out. Large-star and small-star rounds (each an aggregate and a join on
    longs) run until the edges are stars; the rounds needed grow with the logarithm of the
    longest path. Hubs are no hazard: the minimum is aggregated before the exchange and
    the join back may be split by the adaptive skew join. A round's input is deleted once
    its result is written.
    """
    spark = edges.sparkSession
    path = write_staged(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        stars = spark.read.schema("a long, b long").parquet(path)
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: (a, b) with b < a; every a is hung below its smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        made = write_staged(
            small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        )
        remove(spark, path)
        path = made
        stars = spark.read.schema("a long, b long").parquet(path)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
