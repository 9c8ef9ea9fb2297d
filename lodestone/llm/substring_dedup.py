"""Removal of repeated passages with fixed-block anchors.

Every document is cut into blocks of ``ANCHOR`` words that do not overlap: these are the
index. Every run of ``ANCHOR`` words, at each position, probes it. A repeat of at least
``2 * ANCHOR - 1`` words holds a whole block of its earlier place, so a run that is found
there again; no other words can be part of a repeat. Around each hit the match is extended
to the left and to the right, a word at a time: every window of ``width`` words that still
contains the hit is compared with those around all other hits, and of equal windows the
first keeps its words. Windows that are repeated one after another make the maximal repeat.
The comparison is with all earlier places at once, not with the place of one hit: where
several documents share an anchor, the earlier copy of a window may stand in another of them
than that of its neighbour, and an extension against one of them would miss it.

Index, probes and windows are exchanged as packed arrays of hashes (one row for each chunk
of documents and bucket of hashes; both hold about ``CHUNK`` bytes of text, whatever the
size of the table). In a chunk equal hashes are merged before the exchange, so a passage in
any number of documents costs a bucket no more keys than there are chunks. Anchors are 48
bits of a hash: a false hit only makes a candidate, which the comparison of windows rejects.
Windows are compared by 96 bits of two independent hashes, which no sum or product of
letters can make collide.

Defined cases: a null text has no words and its kept text is empty; a very long text is a
chunk of its own, and its words are taken apart block by block; a null doc_id counts as
larger than all others; of rows with one doc_id, or with none, that with the smaller
xxhash64 of its text comes first, so that many of them are dealt over several chunks; rows
that are equal in both repeat each other; an empty table gives no rows; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, pieces_of, staged, text_bytes
from lodestone.llm.packed import by_bucket, contains, pack, unpack
from lodestone.llm.words import split_words

ANCHOR, KEY_BITS = 10, 48
#: Bytes of text that a chunk, and the keys of a bucket, come from.
CHUNK = 8 << 20
SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
TOLD = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("kept", pa.string())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _planes(ids: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of all of them: bytes that seldom differ stand together and are packed by the shuffle."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8).T).tobytes()


class Chunk:
    """A chunk's documents in order, their words, and which anchors are valid."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])  # nulls last
        self.texts = table.column("text").combine_chunks()
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks) if self.texts.num_chunks else pa.array([], pa.string())
        self.ids = table.column("doc_id")
        self.words = split_words(self.texts, twice=True)
        hashed, self.valid = self.words.grams(ANCHOR)
        self.keys = hashed >> np.uint64(64 - KEY_BITS)
        sizes = np.diff(self.words.first)
        self.place = np.arange(len(self.keys)) - np.repeat(self.words.first[:-1], sizes)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        #: What orders documents: whether the id is null, the id, the tie between rows of one id.
        self.order = [np.asarray(c, np.int64) for c in (self.ids.is_null().to_numpy(), self.ids.fill_null(0).to_numpy(), table.column("tie").to_numpy())]

    def anchors(self) -> np.ndarray:
        """The distinct keys, ascending, with two bits: a block has it; it occurs more than once."""
        block = (self.place % ANCHOR == 0)[self.valid]
        found = np.sort(self.keys[self.valid] << np.uint64(1) | block.astype(np.uint64))
        if not len(found):
            return found
        first = np.flatnonzero(np.diff(found >> np.uint64(1), prepend=np.uint64(1 << 63)))
        last = np.append(first[1:], len(found)) - 1
        return (found[last] << np.uint64(1)) | (last > first).astype(np.uint64)

    def windows(self, hits: np.ndarray, width: int):
        """Of the windows around hits: places, first hash, second hash, by ascending hashes; and whether a place is its group's first."""
        hit = contains(hits, self.keys) & self.valid
        sums = np.concatenate([[0], np.cumsum(hit)])
        one, valid = self.words.grams(width)
        two = (self.words.grams(width, second=True)[0] >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(valid)
        at = at[sums[at + width - ANCHOR + 1] > sums[at]]
        at = at[np.lexsort((two[at], one[at]))]
        one, two = one[at], two[at]
        first = np.ones(len(at), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return at, one, two, first


def removed_passages(docs: DataFrame, width: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, starts, lengths, kept) for each row of ``docs(doc_id, text)``.

    starts and lengths give the maximal runs of removed words; kept is the other words joined
    by single spaces. ``width`` must be at least ``2 * ANCHOR - 1``.
    """
    if width < 2 * ANCHOR - 1:
        raise ValueError(f"a window of {width} words may hold no whole block of {ANCHOR}")
    spark = docs.sparkSession
    chunks = parts = pieces_of(text_bytes(docs), partitions(spark), CHUNK)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    again = staged(base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"), F.lit(True).alias("repeated")))
    if again.isEmpty():
        base = base.withColumn("tie", F.lit(0).cast("long"))
    else:
        base = base.join(again, base["doc_id"].eqNullSafe(again["again"]), "left").select("doc_id", "text", F.when(F.col("repeated"), F.xxhash64("text")).otherwise(0).alias("tie"))
    chunk = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("int").alias("chunk")
    base = base.select(chunk, "doc_id", "tie", "text").repartition(partitions(spark), "chunk")

    def send(table: pa.Table) -> pa.Table:
        at = table.column("chunk")[0].as_py()
        keys = Chunk(table).anchors()
        return _rows(SENT, [(b, at, pack(keys[s])) for b, s in by_bucket(keys, parts, KEY_BITS + 2)])

    def meet(table: pa.Table) -> pa.Table:
        """The anchors that a block has and another run has too, told to each chunk that has them."""
        of = table.column("chunk").to_pylist()
        keys = [unpack(d.as_py()) for d in table.column("data")]
        every = np.sort(np.concatenate(keys))
        plain = every >> np.uint64(2)
        first = np.flatnonzero(np.diff(plain, prepend=np.uint64(1 << 63)))
        n = np.diff(np.append(first, len(plain))) + np.maximum.reduceat((every & np.uint64(1)).astype(np.int64), first)
        block = np.maximum.reduceat(every & np.uint64(2), first) > 0
        hits = plain[first][block & (n > 1)]
        rows = []
        for c, k in zip(of, keys, strict=True):
            k = k >> np.uint64(2)
            if len(k := k[contains(hits, k)]):
                rows.append((c, 0, pack(k)))
        return _rows(TOLD, rows)

    def told(table: pa.Table, kind: int) -> list[bytes]:
        return [d.as_py() for d, k in zip(table.column("data"), table.column("kind"), strict=True) if k.as_py() == kind]

    def gathered(data: list[bytes]) -> np.ndarray:
        return np.sort(np.concatenate([unpack(d) for d in data])) if data else np.zeros(0, np.uint64)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each distinct window around a hit, with the chunk's first document that has it."""
        hits = gathered(told(right, 0))
        if not left.num_rows or not len(hits):
            return _rows(SENT, [])
        own, rows = Chunk(left), []
        at, one, two, first = own.windows(hits, width)
        at, one, two = at[first], one[first], two[first]
        number = left.column("chunk")[0].as_py()
        for b, s in by_bucket(one, parts, 64):
            head = pack(one[s])
            rows.append((b, number, len(head).to_bytes(4, "little") + head + two[s].tobytes() + b"".join(_planes(o[own.doc[at[s]]]) for o in own.order)))
        return _rows(SENT, rows)

    def compare(table: pa.Table) -> pa.Table:
        """The windows that a smaller document of another chunk has, told to each chunk that has them."""
        of, ones, twos, docs_of, sizes = table.column("chunk").to_pylist(), [], [], [], []
        for d in table.column("data"):
            d = d.as_py()
            cut = 4 + int.from_bytes(d[:4], "little")
            ones.append(unpack(d[4:cut]))
            n = len(ones[-1])
            twos.append(np.frombuffer(d, np.uint32, n, cut))
            docs_of.append([np.frombuffer(d, np.uint8, 8 * n, cut + (4 + 8 * k) * n).reshape(8, n).T.copy().view(np.int64).ravel() for k in range(3)])
            sizes.append(n)
        one, two = map(np.concatenate, (ones, twos))
        null, doc, tie = map(np.concatenate, zip(*docs_of, strict=True))
        owner = np.repeat(np.arange(len(of)), sizes)
        order = np.lexsort((tie, doc, null, two, one))
        one, two, owner = one[order], two[order], owner[order]
        later = np.zeros(len(one), bool)
        later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        one, two, owner = one[later], two[later], owner[later]
        order = np.argsort(owner, kind="stable")  # within an owner they stay ascending
        one, two, owner = one[order], two[order], owner[order]
        rows = []
        edges = np.searchsorted(owner, np.arange(len(of) + 1))
        for c, a, b in zip(of, edges[:-1], edges[1:], strict=True):
            if b > a:
                head = pack(one[a:b])
                rows.append((c, 1, len(head).to_bytes(4, "little") + head + two[a:b].tobytes()))
        return _rows(TOLD, rows)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(RESULT, [])
        own = Chunk(left)
        n = len(own.keys)
        covered = np.zeros(n, bool)
        hits = gathered(told(right, 0))
        if len(hits):
            at, one, two, first = own.windows(hits, width)
            ones, twos = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
            for d in told(right, 1):
                cut = 4 + int.from_bytes(d[:4], "little")
                ones.append(unpack(d[4:cut]))
                twos.append(np.frombuffer(d, np.uint32, -1, cut))
            later_one, later_two = np.concatenate(ones), np.concatenate(twos)
            order = np.lexsort((later_two, later_one))
            later_one, later_two = later_one[order], later_two[order]
            low, high = np.searchsorted(later_one, one, "left"), np.searchsorted(later_one, one, "right")
            again = ~first
            for k in range(int((high - low).max(initial=0))):
                again |= (low + k < high) & (later_two[np.minimum(low + k, max(len(later_two) - 1, 0))] == two)
            steps = np.bincount(at[again], minlength=n + width)[: n + width] - np.bincount(at[again] + width, minlength=n + width)[: n + width]
            covered = np.cumsum(steps)[:n] > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        # a run goes on over a document's end only if both documents are covered there
        bounds = own.words.first
        begin = np.flatnonzero(covered & ((edge[:-1] == 1) | (own.place == 0)))
        last = np.zeros(n, bool)
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        stop = np.flatnonzero(covered & ((edge[1:] == -1) | last)) + 1
        run = np.searchsorted(begin, bounds)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(run.astype(np.int32)), pa.array(v.astype(np.int32)))
        sums = np.concatenate([[0], np.cumsum(covered)])
        kept = []
        keep = ~covered
        for i, text in enumerate(own.texts):
            a, b = bounds[i], bounds[i + 1]
            words = (text.as_py() or "").encode().split()
            kept.append(b" ".join(words if sums[b] == sums[a] else compress(words, keep[a:b].tolist())).decode())
        return pa.table([own.ids.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), lists(begin - bounds[own.doc[begin]]), lists(stop - begin), pa.array(kept, pa.string())], schema=RESULT)

    sent, told_schema = "bucket int, chunk int, data binary", "chunk int, kind int, data binary"
    hits = base.groupBy("chunk").applyInArrow(send, sent).groupBy("bucket").applyInArrow(meet, told_schema)
    windows = base.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, sent)
    later = windows.groupBy("bucket").applyInArrow(compare, told_schema)
    facts = hits.union(later)
    return base.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, starts array<int>, lengths array<int>, kept string")
