"""Sharding by best-fit-decreasing bin packing.

Groups (here: the documents of one text) are indivisible. Sorted by size, each goes into
the bin whose remaining capacity is the tightest that still holds it, found in a balanced
tree; a bin is opened only when none fits. So that no task and no group grows with the
data, the packing has two levels:

1. Each task packs the small groups that hash to it into pallets, bins of a fixed small
   share of a shard. A group larger than a pallet is a pallet of its own; only a group
   larger than a whole shard is cut, into runs of its rows that fill a shard each, and a rest.
2. Pallets, of which there are at most ``2 * shards * PALLETS`` besides one for each task,
   are packed into the shards, whose common capacity is the smallest that needs no more
   than ``shards`` of them.

Slots come from prefix sums over runs in groups, groups in pallets and pallets in shards.

Defined cases: a null text has no bytes, and null texts are a group apart from empty ones;
rows with a null doc_id are placed like others; repeated rows get a slot each; an empty
table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, staged

OVERHEAD = 16
#: Pallets in a shard; the sizes of shards come as near as one part in so many.
PALLETS = 400


class Treap:
    """A balanced search tree of distinct (remaining capacity, bin) keys."""

    def __init__(self):
        self.root, self.random = None, random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = self._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def add(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, (key, self.random.random(), None, None)), b)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key whose capacity is ``least`` or more."""
        a, b = self._split(self.root, (least, -1))
        if b is None:
            self.root = a
            return None
        first = b
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(b, (first[0][0], first[0][1] + 1))
        self.root = self._join(a, rest)
        return first[0]


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each size, bins numbered in the order of opening; a size over ``capacity`` has one of its own."""
    sizes = list(sizes)
    bins, free, opened = [0] * len(sizes), Treap(), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.take(sizes[i])
        left, at = found or (max(capacity, sizes[i]), opened)
        opened += found is None
        bins[i] = at
        free.add((left - sizes[i], at))
    return bins


def fewest_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """The smallest capacity (to one part in 10,000) at which best fit decreasing opens at most ``bins``, and the bins."""
    low = max(-(-sum(sizes) // bins), max(sizes, default=0))
    step, good = max(1, low // 10_000), None
    high, grow = low, step
    while good is None:
        packed = best_fit_decreasing(sizes, high)
        if max(packed, default=0) < bins:
            good = packed
        else:
            low, high, grow = high + 1, high + grow, grow * 2
    while low + step <= high:
        middle = (low + high) // 2
        packed = best_fit_decreasing(sizes, middle)
        if max(packed, default=0) < bins:
            high, good = middle, packed
        else:
            low = middle + 1
    return high, good


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    parts = partitions(spark)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("grp"),
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("salt"),
    )
    rows = staged(rows.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "salt").orderBy("doc_id")).cast("long") - 1))
    salted = rows.groupBy("grp", "salt", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    groups = salted.groupBy("grp", "size").agg(F.sum("n").alias("n"))
    total = groups.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    capacity = -(-total // shards)
    pallet = max(1, capacity // PALLETS)
    run = F.when(F.col("n") * F.col("size") > capacity, F.greatest(F.floor(F.lit(capacity) / F.col("size")), F.lit(1))).otherwise(F.col("n")).cast("long")
    groups = groups.withColumn("run", run)
    # a group is cut only when larger than a shard: into no more runs than there are pallets in all
    units = groups.select("grp", "size", "run", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div run"))).alias("piece"))
    units = units.select("grp", "piece", F.least(F.col("run"), F.col("n") - F.col("piece") * F.col("run")).alias("n"), "size").withColumn("bytes", F.col("n") * F.col("size"))

    def pack(frame):
        frame = frame.sort_values(["bytes", "grp", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        frame["pallet"] = best_fit_decreasing(frame["bytes"].tolist(), pallet)
        frame["offset"] = frame.groupby("pallet")["n"].cumsum() - frame["n"]
        return frame[["grp", "piece", "bucket", "pallet", "offset", "n", "bytes"]]

    bucket = F.pmod(F.xxhash64("grp", "piece"), F.lit(parts)).cast("int")
    packed = staged(units.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(pack, "grp string, piece long, bucket int, pallet long, offset long, n long, bytes long"))
    pallets = packed.groupBy("bucket", "pallet").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("bucket", "pallet").collect()  # at most 2 * shards * PALLETS + parts
    _, bins = fewest_capacity([p["bytes"] for p in pallets], shards)
    base, placed = [0] * shards, []
    for p, at in zip(pallets, bins or [], strict=True):
        placed.append((p["bucket"], p["pallet"], at, base[at]))
        base[at] += p["n"]
    where = spark.createDataFrame(placed, "bucket int, pallet long, shard int, base long")
    units = packed.join(where, ["bucket", "pallet"]).select("grp", "piece", "shard", (F.col("base") + F.col("offset")).alias("base"))
    runs = groups.select("grp", "run")
    counted = salted.select("grp", "salt", "before").join(runs, "grp")
    found = rows.join(counted, ["grp", "salt"]).withColumn("nth", F.col("nth") + F.col("before")).withColumn("piece", F.expr("nth div run"))
    return found.join(units, ["grp", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.expr("nth % run")).alias("slot"))
