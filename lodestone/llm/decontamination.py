"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

A window is ``width`` consecutive words of an item, or all words of a shorter one. Its
shingles are its runs of ``SHINGLE`` words (of its own length, if it is shorter). The texts
of the documents are taken apart once: each of their shingles that any window has is noted
with its place, and nothing else of a text is kept.

From these notes come the counts that order shingles by rarity. A document that holds a
window holds all its shingles, so of a window's prefix one token is necessary and enough:
only its rarest shingle is joined with the notes. The shingle's place in the window gives
the place where the window would start; starts before the document's first word, or windows
that reach beyond its last, are dropped. A window occurs where all its shingles are noted at
their places in a row; shingles are compared as words, so this is exact.

Words are compared after A-Z are lower-cased, in both tables by the same expression.

Defined cases: null and empty texts have no words; very long texts are one array of words in
a task, nothing else of them meets in one place; an item without words, or with a null
item_id, has no window; documents with a null doc_id are judged like others; rows that share
a doc_id are judged by their own texts, repeated documents alike, and repeated items count
once for an item_id; of shingles that are equally rare the smaller number is joined, which
changes no result; empty tables give no rows, or rows without hits; columns besides the ids
and text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import staged

#: What separates words: ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 3
#: A larger vocabulary of shingles, or table of windows, is joined by shuffles, not sent to every task.
BROADCAST_BYTES = 4 << 20
#: No word has a blank: stands behind a document's last word, where its place is the number of words.
END = " "


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; sigma and all other letters stay as they are."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, BREAK), "")


def _key(size: int, at: Column) -> Column:
    """The hash of the first ``size`` words of a struct (a, b, c); null where it has fewer."""
    parts = [at["a"], at["b"], at["c"]][:size]
    return F.when(parts[-1].isNotNull() & (parts[-1] != END), F.xxhash64(F.lit(size), *parts))


def _runs(array: str) -> Column:
    """Each word of an array as a struct (a, b, c) with the next two."""
    rest = [F.expr(f"slice({array}, {n + 1}, greatest(size({array}) - {n}, 0))") for n in (1, 2)]
    return F.arrays_zip(F.col(array).alias("a"), rest[0].alias("b"), rest[1].alias("c"))


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Rows (item_id, window array<string>): the different windows of each item."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    return items.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start") + 1, F.lit(width)).alias("window")).distinct()


class Notes:
    """What the one pass over the documents leaves.

    ``hits``: rows (doc_id, text_hash, pos, sid) for shingles of the benchmark in documents;
    ``documents``: rows (doc_id, text_hash, n_words), one for each row of the table;
    ``windows``: rows (wid, length); ``shingles``: rows (wid, place, sid); ``items``: rows (wid, item_id).
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int, limit: int):
        held = staged(windows(benchmark, width))
        whole = staged(held.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window"))
        self.items = staged(held.join(whole, "window").select("wid", "item_id"))
        self.windows = whole.select("wid", F.size("window").alias("length"))
        size = F.least(F.size("window"), F.lit(SHINGLE))
        spread = whole.select("wid", size.alias("size"), F.posexplode(_runs("window")).alias("place", "at"))
        cut = lambda n, c: F.when(F.col("size") > n, F.col(f"at.{c}")).alias(c)
        shingles = spread.where(F.when(F.col("size") == 3, F.col("at.c").isNotNull()).when(F.col("size") == 2, F.col("at.b").isNotNull()).otherwise(True)).select("wid", "place", "size", F.col("at.a").alias("a"), cut(1, "b"), cut(2, "c"))
        vocabulary = staged(shingles.select("size", "a", "b", "c").distinct().withColumn("sid", F.monotonically_increasing_id()))
        same = [shingles[k].eqNullSafe(vocabulary[k]) for k in ("size", "a", "b", "c")]
        self.shingles = staged(shingles.join(vocabulary, same).select("wid", "place", "sid"))

        sizes = sorted(r[0] for r in vocabulary.select("size").distinct().collect())  # at most SHINGLE numbers
        n_bytes = vocabulary.agg(F.sum(F.octet_length(F.concat_ws(" ", "a", "b", "c")) + 48)).first()[0] or 0
        self.small = n_bytes <= limit
        told = vocabulary.select("sid", "size", F.struct("a", "b", "c").alias("v")).select("sid", F.coalesce(*(F.when(F.col("size") == n, _key(n, F.col("v"))) for n in (1, 2, 3))).alias("key"), F.col("size").alias("v_size"), *(F.col(f"v.{c}").alias(f"v_{c}") for c in "abc"))
        end = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("sid"), F.xxhash64(F.lit(0), F.lit(END)).alias("key"), F.lit(0).alias("v_size"), F.lit(END).alias("v_a"), *(F.lit(None).cast("string").alias(f"v_{c}") for c in "bc"))
        source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("words"))
        placed = source.select("doc_id", "text_hash", F.posexplode(_runs("words")).alias("pos", "at"))
        ends = F.when(F.col("at.a") == END, F.xxhash64(F.lit(0), F.lit(END)))
        keys = [_key(n, F.col("at")) for n in sizes]
        if len(keys) > 1:
            found = placed.select("doc_id", "text_hash", "pos", "at", F.explode(F.array(F.coalesce(ends, keys[0]), *keys[1:])).alias("key"))
        else:
            found = placed.select("doc_id", "text_hash", "pos", "at", F.coalesce(ends, *keys).alias("key"))
        found = found.where("key is not null")
        agree = (F.col("at.a") == F.col("v_a")) & ((F.col("v_size") < 2) | (F.col("at.b") == F.col("v_b"))) & ((F.col("v_size") < 3) | (F.col("at.c") == F.col("v_c")))
        columns = ["doc_id", "text_hash", "pos", "sid"]
        if self.small:
            # one pass: the mark behind the last word is a word of the vocabulary, so each document leaves a row
            notes = staged(found.join(F.broadcast(told.union(end)), "key").where(agree).select(*columns))
            self.hits = notes.where("sid >= 0").distinct()
            self.documents = notes.where("sid < 0").select("doc_id", "text_hash", F.col("pos").alias("n_words"))
        else:
            self.hits = staged(found.where(ends.isNull()).join(told, "key").where(agree).select(*columns).distinct())
            self.documents = source.select("doc_id", "text_hash", (F.size("words") - 1).alias("n_words"))

    def sent(self, df: DataFrame) -> DataFrame:
        """A table no larger than the vocabulary times a window's length: sent to every task if the vocabulary may be."""
        return F.broadcast(df) if self.small else df

    def places(self) -> DataFrame:
        """Rows (doc_id, text_hash, wid, at, length): where windows occur; at counts words from 0."""
        counts = self.hits.groupBy("sid").agg(F.count("*").alias("n"))
        counted = self.shingles.join(counts, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        prefix = counted.groupBy("wid").agg(F.min(F.struct("n", "sid", "place")).alias("low"), F.count("*").alias("n_shingles"))
        # a window with a shingle that no document has cannot occur
        prefix = staged(prefix.where("low.n > 0").join(self.windows, "wid").select("wid", "length", "n_shingles", F.col("low.sid").alias("sid"), F.col("low.place").alias("place")))
        starts = self.hits.join(self.sent(prefix), "sid").withColumn("at", F.col("pos") - F.col("place")).where("at >= 0")
        starts = starts.select("doc_id", "text_hash", "wid", "at", "length", "n_shingles")
        single, more = starts.where("n_shingles = 1"), starts.where("n_shingles > 1")
        wanted = more.join(self.sent(self.shingles), "wid").select("doc_id", "text_hash", "wid", "at", "length", "n_shingles", (F.col("at") + F.col("place")).alias("pos"), "sid")
        hits = self.hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p"), F.col("sid").alias("s"))
        met = wanted.join(hits, (wanted["text_hash"] == hits["h"]) & (wanted["pos"] == hits["p"]) & (wanted["sid"] == hits["s"]) & wanted["doc_id"].eqNullSafe(hits["d"]))
        held = met.groupBy("doc_id", "text_hash", "wid", "at", "length", "n_shingles").agg(F.count("*").alias("n")).where("n = n_shingles")
        columns = ["doc_id", "text_hash", "wid", "at", "length"]
        return single.select(*columns).union(held.select(*columns))


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, at, length): where windows of items occur in documents.

    at counts words from 0. text_hash is xxhash64(text); with doc_id it names the document.
    """
    notes = Notes(docs, benchmark, width, broadcast_bytes)
    return notes.places().join(notes.sent(notes.items), "wid").select("doc_id", "text_hash", "item_id", "at", "length")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items array<string>) for each document; items are sorted as strings."""
    notes = Notes(docs, benchmark, width, broadcast_bytes)
    places = staged(notes.places())
    own = ["doc_id", "text_hash"]
    covered = places.select(*own, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*own).agg(F.count("*").alias("n_hit"))
    # a document's list has each item once, so it is bounded by the benchmark
    named = places.select(*own, "wid").distinct().join(notes.sent(notes.items), "wid").select(*own, F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy(*own).agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = covered.join(listed, covered["doc_id"].eqNullSafe(listed["doc_id"]) & (covered["text_hash"] == listed["text_hash"]))
    hits = hits.select(covered["doc_id"].alias("d"), covered["text_hash"].alias("h"), "n_hit", "items")
    source = notes.documents.withColumn("text_hash", F.coalesce("text_hash", F.lit(0)))
    joined = source.join(hits, source["doc_id"].eqNullSafe(hits["d"]) & (source["text_hash"] == hits["h"]), "left")
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
