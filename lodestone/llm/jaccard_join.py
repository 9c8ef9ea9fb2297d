"""Joins documents whose sets of word shingles are similar, by T-occurrence search.

Two sets of n and m shingles whose Jaccard similarity is t or more have at least
``T = ceil(t / (1 + t) * (n + m))`` shingles in common, and at least ``ceil(t * n)`` whatever
m is. The join narrows down in exact steps:

1. Each chunk of documents (about ``CHUNK`` bytes of text, whatever the size of the table)
   sends its distinct shingle hashes as packed arrays to buckets of hashes, which tell it
   the shingles that two sets or more have, and how many. A set with fewer than
   ``ceil(t * n)`` such shingles links with nothing.
2. Of the others, the rarest ``n - ceil(t * n) + 1`` shingles are posted: two linked sets
   share one of these. Sets that share posted shingles, directly or by way of others, form a
   group.
3. In each group an inverted index is searched with DivideSkip: of a set's lists the longest
   are set aside, the short ones are merged by a heap, what occurs often enough there is
   looked up in the long ones by binary search, and sets that reach T are linked. Lists name
   only sets whose size allows a link and that are not in the set's class yet, so no more
   links come out of a task than it has sets.
4. A group of more than ``block`` sets is split, and its parts are searched alike. First each
   of its sets is indexed beside its head, the smallest of the sets it shares most posted
   shingles with, and the heads are searched for; then each set outside the largest class so
   found is searched for in the blocks that it shares a posted shingle with, two blocks in a
   task.

:func:`similar` gives the classes, :func:`links` every link between different sets by the
same search, without leaving out sets of one class.

Equal sets are one node from the start, however many documents have them; they are named by
their size and two independent 64-bit sums. Shingles are compared by 64-bit hashes that no
sum or product of letters can make collide.

Defined cases: a null text, or one without words, has no shingles and links with nothing; a
text of fewer words than a shingle has its whole sequence as the one shingle; a very long
text is a chunk of its own, and its words are taken apart block by block; a row with a null
doc_id joins the class of an equal set and else has no component; rows that share a doc_id
count as one document; ties between equal sets go to the smallest doc_id; an empty table
gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, partitions, pieces_of, staged, text_bytes
from lodestone.llm.packed import by_bucket, contains, pack, unpack
from lodestone.llm.words import split_words

KEY_BITS = 48
#: Bytes of text that a chunk, and the keys of a bucket, come from.
CHUNK = 8 << 20
SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
TOLD = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("tokens", pa.list_(pa.int64()))])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with any set it links with."""
    return -(-n * percent // 100)


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Chunk:
    """A chunk's documents in order of doc_id: the shingle set of each, and which of equal sets is the first."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # nulls last
        texts = table.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        self.ids = table.column("doc_id")
        words = split_words(texts, lower=True, twice=True)
        runs, again = words.grams(width)[0], words.grams(width, second=True)[0]
        self.sets, self.names = [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                s, at = np.unique(runs[a : b - width + 1], return_index=True)
                two = again[a + at]
            elif b > a:
                s, two = (words.run(a, b - a, 8 * (b - a), second) for second in (False, True))
            else:
                s = two = runs[:0]
            self.sets.append(s)
            self.names.append((len(s), int(s.sum(dtype=np.uint64)), int(two.sum(dtype=np.uint64))))
        seen: set = set()
        self.first = [bool(n[0]) and n not in seen and not seen.add(n) for n in self.names]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of the chunk's distinct sets, and how many sets have each."""
        own = [s >> np.uint64(64 - KEY_BITS) for s, f in zip(self.sets, self.first, strict=True) if f]
        return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Index:
    """Inverted lists over sets; :meth:`search` finds those that share at least T tokens with a query."""

    #: Weighs the cost of merging against that of binary search in the number of long lists.
    MU = 0.01
    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((owners, tokens))
        self.owners = owners[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def search(self, query: np.ndarray, size: int, percent: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets among ``wanted`` (a mask) that link with the query, and their overlaps. size: the query's, with tokens that no other set has."""
        wanted = wanted & (100 * self.sizes >= percent * size) & (percent * self.sizes <= 100 * size)
        low = least_shared(size, percent)
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query] if len(self.tokens) else at[:0]
        if len(at) < low or not wanted.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = (self.owners[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True))
        lists = sorted((x[wanted[x]] for x in whole), key=len)
        if len(lists[low - 1 - len(lists)]) == 0:  # fewer lists than T name any set
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_long = min(low - 1, int(low / (self.MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        least = low - n_long
        found = [(k, n) for k, g in groupby(heapq.merge(*(x.tolist() for x in short if len(x)))) if (n := sum(1 for _ in g)) >= least]
        ids, counts = np.asarray([k for k, _ in found], np.int64), np.asarray([n for _, n in found], np.int64)
        need = -(-percent * (size + self.sizes[ids]) // (100 + percent))
        for left in range(n_long, -1, -1):
            if left % 8 == 0 or left == n_long:
                keep = counts + left >= need
                ids, counts, need = ids[keep], counts[keep], need[keep]
                if not len(ids):
                    break
            if left:
                x = long[n_long - left]
                counts = counts + (x[np.minimum(np.searchsorted(x, ids), len(x) - 1)] == ids)
        return ids, counts


def all_links(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], upper: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """All links of the sets; where some are of the ``upper`` block, only links between the two blocks."""
    two = upper.any()
    held = np.flatnonzero(upper) if two else np.arange(len(nodes))
    index, found = Index([np.sort(sets[i]) for i in held], sizes[held]), []
    for q in (np.flatnonzero(~upper) if two else held).tolist():
        wanted = np.ones(len(held), bool) if two else held > q
        found += [(int(nodes[q]), int(nodes[held[i]])) for i in index.search(np.sort(sets[q]), int(sizes[q]), percent, wanted)[0]]
    return found


def spanning_links(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], classes: np.ndarray, outside: np.ndarray, upper: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all classes that any link with a set ``outside`` joins.

    Where some sets are of the ``upper`` block, only links between the two blocks count.
    """
    top = dict(zip(classes.tolist(), classes.tolist(), strict=True))

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    two = upper.any()
    held = np.flatnonzero(upper) if two else np.arange(len(nodes))
    index = Index([np.sort(sets[i]) for i in held], sizes[held])
    of, others = classes[held].copy(), outside[held]
    links = []
    for q in np.flatnonzero(~upper if two else outside).tolist():
        own = find(int(classes[q]))
        wanted = of != own
        ids, _ = index.search(np.sort(sets[q]), int(sizes[q]), percent, wanted if outside[q] else wanted & others)
        for i in ids.tolist():
            other = find(int(of[i]))
            if other != own:
                links.append((int(nodes[q]), int(nodes[held[i]])))
                top[other] = own
                of[of == other] = own
    return links


def shingle_sets(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, one, two, tokens): each document's set, named by (one, two) and its size.

    tokens are the set's shingles that another set has too, the rarest first, where these may
    be enough for a link; null else, and null for all but one of a chunk's equal sets.
    """
    # rows of one doc_id, or of none, are dealt by their texts; chunks and buckets keep their size when the input grows
    parts = pieces_of(text_bytes(docs), partitions(docs.sparkSession), CHUNK)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("chunk")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(chunk, "doc_id", "text").repartition(partitions(docs.sparkSession), "chunk")

    def send(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        keys, counts = Chunk(table, width).keys()
        rows = []
        for b, s in by_bucket(keys, parts, KEY_BITS):
            head = pack(keys[s])
            rows.append((b, number, len(head).to_bytes(4, "little") + head + counts[s].astype("<u4").tobytes()))
        return _table(SENT, rows)

    def meet(table: pa.Table) -> pa.Table:
        """The keys that two sets or more have, and how many, told to each chunk that has them."""
        of, keys, counts = table.column("chunk").to_pylist(), [], []
        for d in table.column("data"):
            d = d.as_py()
            cut = 4 + int.from_bytes(d[:4], "little")
            keys.append(unpack(d[4:cut]))
            counts.append(np.frombuffer(d, "<u4", -1, cut))
        every = np.concatenate(keys)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.diff(every, prepend=np.uint64(1 << 63)))
        n = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
        shared, n = every[first][n > 1], n[n > 1]
        rows = []
        for c, k in zip(of, keys, strict=True):
            k = k[contains(shared, k)]
            if len(k):
                rows.append((c, pack(k), n[np.searchsorted(shared, k)].astype("<u8").tobytes()))
        return _table(TOLD, rows)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(SETS, [])
        own = Chunk(left, width)
        shared = [unpack(k.as_py()) for k in right.column("keys")]
        counts = [np.frombuffer(c.as_py(), "<u8") for c in right.column("counts")]
        shared, counts = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (shared, counts))
        order = np.argsort(shared)
        shared, counts = shared[order], counts[order]
        tokens: list = []
        for s, first in zip(own.sets, own.first, strict=True):
            kept = None
            if first and len(shared):
                key = s >> np.uint64(64 - KEY_BITS)
                has = contains(shared, key)
                if has.sum() >= least_shared(len(s), percent):
                    n = counts[np.searchsorted(shared, key[has])]
                    kept = s[has][np.lexsort((s[has], n))].view(np.int64)
            tokens.append(kept)
        names = [[_signed(n[i]) for n in own.names] for i in (1, 2)]
        return pa.table([own.ids, pa.array([n[0] for n in own.names], pa.int64()), pa.array(names[0], pa.int64()), pa.array(names[1], pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=SETS)

    told = base.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, data binary").groupBy("bucket").applyInArrow(meet, "chunk int, keys binary, counts binary")
    return base.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(choose, "doc_id long, n_shingles long, one long, two long, tokens array<long>")


def _searched(frame: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links found in each (grp, low, high) of ``frame(grp, low, high, node, n, tokens, class, outside, upper)``."""

    def search(table: pa.Table) -> pa.Table:
        plain = lambda name: table.column(name).to_numpy()
        sets = [np.asarray(t.values) for t in table.column("tokens")]
        if every:
            return _table(LINKS, all_links(plain("node"), plain("n"), sets, plain("upper"), percent))
        return _table(LINKS, spanning_links(plain("node"), plain("n"), sets, plain("class"), plain("outside"), plain("upper"), percent))

    return frame.groupBy("grp", "low", "high").applyInArrow(search, "a long, b long")


def block_pairs(known: DataFrame, posted: DataFrame) -> DataFrame:
    """Rows (grp, low, high, node, n, tokens, class, outside, upper): the sets that each pair of blocks needs.

    A set goes to the pair of its own block with each block that has a set with the same
    posted token, if one of the two is outside; linked sets share a posted token.
    """
    where = known.select("node", "block", "outside").distinct()
    at = staged(posted.join(where, "node").select("token", "node", "block", "outside"))
    reached = at.groupBy("token", F.col("block").alias("other")).agg(F.max("outside").alias("any"))
    pairs = at.join(reached, "token").where(F.col("outside") | F.col("any")).select("node", "other").distinct()
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return known.join(pairs, "node").select("grp", low, high, "node", "n", "tokens", "class", "outside", (F.col("block") > F.col("other")).alias("upper"))


def beside_heads(best: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """Rows like those of :func:`block_pairs`: the sets of ``best(node, head)`` are the upper block, their heads the queries.

    About ``block`` heads of a group share a task; a head that more than ``block`` sets have is
    sent to a task for each ``block`` of them.
    """
    counts = best.groupBy("head").agg(F.count("*").alias("sets"))
    homes = large.select(F.col("node").alias("head"), F.col("grp").alias("home"), "members")
    hot = F.col("sets") > block
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.ceil(F.col(n) / block)).cast("int")
    low = F.when(hot, -1 - deal("node", "sets")).otherwise(deal("head", "members")).alias("low")
    dealt = best.join(counts, "head").join(homes, "head").select("node", "head", F.when(hot, F.col("head")).otherwise(F.col("home")).alias("grp"), low)
    held = dealt.select("grp", "low", "node", F.lit(True).alias("upper"))
    queries = dealt.select("grp", "low", F.col("head").alias("node"), F.lit(False).alias("upper")).distinct()
    return held.union(queries).join(large.select("node", "n", "tokens"), "node").select("grp", "low", F.col("low").alias("high"), "node", "n", "tokens", F.col("node").alias("class"), F.lit(True).alias("outside"), "upper")


class Groups:
    """What :func:`similar` and :func:`links` search in: ``rows`` of documents, ``nodes`` for distinct sets, ``posted`` tokens, ``shares`` of heads, ``members`` of groups."""

    NAME = ("n_shingles", "one", "two")

    def __init__(self, docs: DataFrame, width: int, percent: int):
        name = [*self.NAME]
        self.rows = staged(shingle_sets(docs, width, percent))
        self.nodes = self.rows.where("n_shingles > 0").groupBy(*name).agg(F.min("doc_id").alias("node"))
        chosen = self.rows.where("tokens is not null and doc_id is not null").select(*name, F.col("doc_id").alias("node"), "tokens")
        sets = staged(chosen.join(self.nodes, [*name, "node"]).groupBy("node", *name).agg(F.first("tokens").alias("tokens")).select("node", F.col("n_shingles").alias("n"), "tokens"))

        n_posted = F.size("tokens") - F.expr(f"(n * {percent} + 99) div 100").cast("int") + 1
        self.posted = staged(sets.select("node", F.explode(F.slice("tokens", F.lit(1), F.greatest(n_posted, F.lit(1)))).alias("token")).distinct())
        heads = self.posted.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("sets")).where("sets > 1")
        self.shares = staged(self.posted.join(heads, "token").where("node <> head").groupBy("node", "head").agg(F.count("*").alias("shared")))
        grouped = components(self.shares.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "grp")
        sized = grouped.join(grouped.groupBy("grp").agg(F.count("*").alias("members")), "grp")
        self.members = staged(sets.join(sized, "node"))

    def small(self, block: int) -> DataFrame:
        """The groups of up to ``block`` sets, each to be searched whole."""
        return self.members.where(F.col("members") <= block).select("grp", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "n", "tokens", F.col("node").alias("class"), F.lit(True).alias("outside"), F.lit(False).alias("upper"))

    def blocks(self, known: DataFrame, block: int) -> DataFrame:
        """Pairs of blocks of the groups of more than ``block`` sets, ``known`` with their classes."""
        own = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)).cast("int")
        return block_pairs(staged(known.select("grp", "node", "n", "tokens", "class", "outside", own.alias("block"))), self.posted)


def similar(docs: DataFrame, width: int = 5, percent: int = 75, block: int = 1000) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Documents are linked when 100 * intersection >= percent * union of their sets of
    ``width``-word shingles (A-Z lower-cased, words between ASCII white space);
    component_id is the smallest doc_id that links reach.
    """
    groups = Groups(docs, width, percent)
    name, rows, shares = [*Groups.NAME], groups.rows, groups.shares
    links = [staged(_searched(groups.small(block), percent))]

    # large groups: each set beside one other, then a search by pairs of blocks for the sets outside the largest class
    large = groups.members.where(F.col("members") > block)
    if not large.isEmpty():
        order = Window.partitionBy("node").orderBy(F.desc("shared"), "head")
        best = staged(shares.join(large.select("node"), "node").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("node", "head"))
        links.append(staged(_searched(beside_heads(best, large, block), percent)))
        classes = components(links[-1]).withColumnRenamed("component", "class")
        known = large.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        largest = known.groupBy("grp", "class").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("class", F.struct("k", "class")).alias("main"))
        known = known.join(largest, "grp").withColumn("outside", F.col("class") != F.col("main"))
        links.append(staged(_searched(groups.blocks(known, block), percent)))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    found = components(every)
    classed = groups.nodes.join(found, "node", "left").select(*name, F.coalesce("component", "node").alias("component_id"))
    # rows without shingles link with nothing; a set that many rows have is split by the adaptive skew join
    joined = rows.where("n_shingles > 0").select("doc_id", *name).join(classed, name).select("doc_id", "n_shingles", "component_id")
    return joined.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, width: int = 5, percent: int = 75, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets: rows (a, b), a < b, and rows (doc_id, node) that say whose sets these are.

    A node is the smallest doc_id of an equal set, so copies are not expanded into pairs. The
    rows are as many as there are links, which in a class of near copies grow with the square
    of its different sets; :func:`similar` needs only those that join classes.
    """
    groups = Groups(docs, width, percent)
    large = groups.members.where(F.col("members") > block).withColumn("class", F.col("node")).withColumn("outside", F.lit(True))
    frame = groups.small(block).unionByName(groups.blocks(large, block))
    found = _searched(frame, percent, every=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    member = groups.rows.where("n_shingles > 0").join(groups.nodes, [*Groups.NAME]).select("doc_id", "node")
    return found, member
