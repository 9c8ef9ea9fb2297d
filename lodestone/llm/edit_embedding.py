"""Document fingerprints by a randomised edit embedding.

All documents share one random walk. At step j the walk reads the character that it stands
on and, by a random bit of (j, character), stays or moves on. Two texts with few edits
between them fall into step again soon after each edit, so the sequences of characters read
differ at few steps: edit distance becomes Hamming distance. A fingerprint samples
``samples`` steps, of every text the same ones as far as it is long enough (the sampled
step of a longer walk is that of a shorter one, or lies beyond its end), and keeps eight
bits of the character read at each, as two hexadecimal digits. The likeness of two
fingerprints is the share of samples that agree.

The bits repeat after ``PERIOD`` steps and characters fall into ``CLASSES`` classes; then
the wait on a character is one look into a table. Memory is constant in the text's length.

Defined cases: a null text counts as empty; the fingerprint of an empty text is all zeros;
a very long text is walked through in parts; rows with a null doc_id are fingerprinted, and
come last in the order, but belong to no class of :func:`near_duplicates`; rows that share a
doc_id are ordered by the hash of their texts; repeated rows give repeated results; an empty
table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, partitions, staged

CLASSES, PERIOD, CHUNK = 64, 4096, 1 << 16
FARTHEST = 1 << 48


class Walk:
    """The shared randomness; :meth:`start` begins the walk over one text."""

    def __init__(self, samples: int = 128, seed: int = 20240):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        moves[:, ::64] = 1  # so that no wait is longer
        self.wait = []
        for row in moves:
            at = np.flatnonzero(np.concatenate([row, row]))
            self.wait.append((at[np.searchsorted(at, np.arange(PERIOD))] - np.arange(PERIOD) + 1).astype(np.uint8).tobytes())
        # the sampled step of a walk of length n is the last of these below n: each step up to n is as likely
        steps, owners = [], []
        for k in range(samples):
            at = 0
            while at < FARTHEST:
                steps.append(at)
                owners.append(k)
                at = max(at + 1, int((at + 1) / (1 - rng.random())))
        order = np.argsort(steps, kind="stable")
        self.steps, self.owners = np.asarray(steps)[order], np.asarray(owners)[order]
        self.salt = rng.integers(1, 1 << 32, samples, dtype=np.uint64) | np.uint64(1)
        self.samples = samples

    def start(self) -> State:
        return State(self, 0, np.zeros(self.samples, np.uint8))


class State:
    """A walk under way: the step reached and the samples so far."""

    def __init__(self, walk: Walk, step: int, values: np.ndarray):
        self.walk, self.step, self.values = walk, step, values

    def copy(self) -> State:
        return State(self.walk, self.step, self.values.copy())

    def feed(self, text: str) -> State:
        w, wait, mask = self.walk, self.walk.wait, PERIOD - 1
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
            classes = ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8).tobytes()
            starts, j = [], self.step
            note = starts.append
            for c in classes:
                note(j)
                j += wait[c][j & mask]
            lo, hi = np.searchsorted(w.steps, (self.step, j))
            if hi > lo:
                owners = w.owners[lo:hi]
                read = codes[np.searchsorted(np.asarray(starts), w.steps[lo:hi], "right") - 1].astype(np.uint64)
                self.values[owners] = ((read + np.uint64(1)) * w.salt[owners] >> np.uint64(24)).astype(np.uint8)
            self.step = j
        return self

    def fingerprint(self) -> str:
        return self.values.tobytes().hex()

    def likeness(self, other: State) -> float:
        return float(np.mean(self.values == other.values))


def likeness(a: str, b: str) -> float:
    """The share of samples in which two fingerprints agree."""
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint8) for v in (a, b))
    return float(np.mean(x == y)) if len(x) else 1.0


def fingerprints(docs: DataFrame, samples: int = 128) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint) of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]):
        walk = Walk(samples)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([walk.start().feed(t).fingerprint() for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


class Bands:
    """Which samples two near fingerprints must agree in.

    Samples are dealt into groups, by their steps in a walk of ``USUAL`` steps in turn, so that those
    read from a text's first few characters are spread. Of two fingerprints that disagree in at most
    ``miss`` samples, some group disagrees in at most ``few = miss // groups``. Such a group, cut into
    ``few + 2`` bands or more, has two of its first ``few + 2`` bands whole, the earlier of them among
    the first ``few + 1``.
    """

    USUAL = 4096

    def __init__(self, walk: Walk, need: int, band: int = 4):
        samples = walk.samples
        n = max(1, min(4, samples // 16))
        usual = np.zeros(samples, np.int64)
        before = walk.steps < self.USUAL
        np.maximum.at(usual, walk.owners[before], walk.steps[before])
        turn = np.argsort(usual, kind="stable")
        self.few = (samples - need) // n
        self.groups, dealt = [], []  # where a group begins, how many samples it has, and the edges of its bands
        for g in range(n):
            own = turn[g::n]
            cuts = max(-(-len(own) // band), self.few + 2)
            spans = [own[i::cuts] for i in range(cuts)]
            self.groups.append((sum(map(len, dealt)), len(own), np.cumsum([0, *map(len, spans)]).tolist()))
            dealt += spans
        #: Fingerprints in this order have each group's and each band's samples side by side.
        self.order = np.concatenate(dealt)

    def firsts(self) -> list[tuple[int, int, int]]:
        """For each group and each band that may be the earlier one: the group, where the band begins and how long it is."""
        return [(g, a + edges[x], edges[x + 1] - edges[x]) for g, (a, _, edges) in enumerate(self.groups) for x in range(self.few + 1)]

    def keys(self, number: int, group: np.ndarray):
        """For the first band ``number``, a key of it and each later band, of rows of the group's samples."""
        edges = self.groups[number // (self.few + 1)][2]
        x = number % (self.few + 1)

        def add(key: np.ndarray, k: int) -> np.ndarray:
            for i in range(edges[k], edges[k + 1]):
                key = (key ^ group[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            return key

        first = add(np.zeros(len(group), np.uint64), x)
        for y in range(x + 1, self.few + 2):
            yield add(first, y)


def close_pairs(keys: np.ndarray, classes: np.ndarray, group: np.ndarray, few: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key and two classes that disagree in at most ``few`` columns of ``group``, about ``most`` compared at a time."""
    n = len(keys)
    order = np.lexsort((classes, keys))
    k, c = keys[order], classes[order]
    words = np.zeros((n, -(-group.shape[1] // 8) * 8), np.uint8)
    words[:, : group.shape[1]] = group[order]
    words = words.view(np.uint64)
    other = k[1:] != k[:-1]

    def ends(new: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(new) + 1
        return np.repeat(np.append(at, n), np.diff(np.concatenate([[0], at, [n]])))

    begins = ends(other | (c[1:] != c[:-1]))  # a row meets the classes of its key after its own
    counts = ends(other) - begins
    upto = np.cumsum(counts)
    rest, top = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    at = 0
    while at < n and upto[-1] > (upto[at - 1] if at else 0):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        some = counts[at:stop]
        left = np.repeat(np.arange(at, stop), some)
        right = np.arange(len(left)) + np.repeat(begins[at:stop] - np.cumsum(some) + some, some)
        differ = words[left] ^ words[right]
        near = np.bitwise_count(((differ & rest) + rest | differ) & top).sum(1) <= few  # the top bit of each byte that is not 0
        yield order[left[near]], order[right[near]]
        at = stop


def verified(pairs: DataFrame, nodes: DataFrame, need: int, samples: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose fingerprints ``nodes(head, print)`` agree in at least ``need`` samples."""

    def agree(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, samples) for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= need))

    one, two = (nodes.select(F.col("head").alias(i), F.col("print").alias(f"print_{i}")) for i in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "print_a", "print_b").mapInArrow(agree, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.75, band: int = 4, samples: int = 128, block: int = 1 << 17) -> DataFrame:
    """Rows (doc_id, component): documents whose fingerprints agree in a share ``least`` of samples.

    Equal fingerprints are one node. First each node of a key of eight samples is compared with the
    key's smallest, which joins most of what is near. Then the nodes of one first band (see
    :class:`Bands`) share a task, which compares those of different classes that also agree in a
    later band, by their group's samples: two near nodes are compared in some task, so no link is
    missed, and unrelated ones seldom are. What a group leaves is verified on the full
    fingerprints. The nodes of a first band that more than ``block`` have are compared block
    against block, two in a task.
    """
    need = min(samples, max(0, math.ceil(least * samples - 1e-9)))
    parts = partitions(docs.sparkSession)
    bands = Bands(Walk(samples), need, band)
    few, order, firsts = bands.few, bands.order, bands.firsts()

    def run(batches: Iterator[pa.RecordBatch]):
        walk = Walk(samples)
        for b in batches:
            made = [walk.start().feed(t.as_py() or "").values[order].tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "print"])

    prints = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id long, print binary"))
    heads = staged(prints.groupBy("print").agg(F.min("doc_id").alias("head")))

    edges = [*range(0, samples, 8), samples]
    wide = [F.xxhash64(F.lit(a), F.substring("print", a + 1, b - a)) for a, b in pairwise(edges)]
    keyed = heads.select("head", F.explode(F.array(*wide)).alias("key"))
    smallest = keyed.groupBy("key").agg(F.min("head").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(smallest, "key").where("head > first").select(F.col("head").alias("a"), F.col("first").alias("b")).distinct()
    found = components(verified(pairs, heads, need, samples)).select(F.col("node").alias("head"), F.col("component").alias("class"))
    classed = staged(heads.join(found, "head", "left").select("head", F.coalesce("class", "head").alias("class"), "print"))

    at = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("print", a + 1, n)).alias("value"), F.substring("print", bands.groups[g][0] + 1, bands.groups[g][1]).alias("group")) for i, (g, a, n) in enumerate(firsts)))).alias("at")
    banded = classed.select("head", "class", at).select("head", "class", "at.*")
    large = staged(banded.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > block).select("band", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    shares = -(-4 * heads.count() // block) or 1
    placed = banded.join(F.broadcast(large), ["band", "value"], "left")  # at most a row for each ``block`` rows of ``banded``
    part = F.when(F.col("blocks").isNull(), F.pmod("value", F.lit(shares))).otherwise(F.col("value")).alias("part")
    own = F.when(F.col("blocks").isNull(), -1).otherwise(F.pmod(F.xxhash64("head"), "blocks")).cast("int").alias("own")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    task = ["band", "part", "low", "high"]
    met = placed.select("band", part, own, other, "head", "class", "group").select("band", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "head", "class", "group")

    def compare(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by task; a task is compared when the next one begins."""

        def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            number, part, low, high, own, head, kind = (table.column(i).to_numpy() for i in range(7))
            starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(c) != 0 for c in (number, part, low, high)])]))
            for a, b in zip(starts, [*starts[1:], len(head)], strict=True):
                group = np.frombuffer(b"".join(table.column(7)[a:b].to_pylist()), np.uint8).reshape(b - a, -1)
                for keys in bands.keys(int(number[a]), group):
                    for x, y in close_pairs(keys, kind[a:b], group, few):
                        if low[a] != high[a]:  # each block meets itself in a task of its own
                            two = own[a:b][x] != own[a:b][y]
                            x, y = x[two], y[two]
                        if len(x):
                            one, two = head[a:b][x], head[a:b][y]
                            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            name = [b.column(i).to_numpy() for i in range(4)]
            new = [n[0] for n in name] != [held[-1].column(i)[-1].as_py() for i in range(4)] if held else False
            if new:
                yield from pairs_of(pa.Table.from_batches(held))
                held = []
            last = int(np.flatnonzero(np.logical_or.reduce([n != n[-1] for n in name]))[-1]) + 1 if any((n != n[-1]).any() for n in name) else 0
            if last:
                yield from pairs_of(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    rest = met.repartition(parts, *task).sortWithinPartitions(*task).mapInArrow(compare, "a long, b long").distinct()
    joined = classed.where("head <> class").select(F.col("head").alias("a"), F.col("class").alias("b"))
    found = components(joined.union(verified(rest, heads, need, samples)))
    members = prints.join(heads, "print").select("doc_id", "head")
    return members.join(found, F.col("head") == F.col("node"), "left").select("doc_id", F.coalesce("component", "head").alias("component"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, samples: int = 128) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    The next document is that of the next smaller doc_id (ties: the smaller xxhash64 of the
    text, so that many rows of one doc_id are dealt over several tasks), after the last the first; the edited text has the last third of the characters replaced by the
    first of the next. Documents are range-partitioned in that order, so a task meets each
    next document but that of its last row; those few rows, one for each partition, are
    completed in a second step from the first texts of the partitions.
    """

    def complete(state, walk, doc_id, text, after):
        cut = len(text) // 3
        head, tail = text[: len(text) - cut], after[:cut]
        prefix = state.feed(head)
        edited = prefix.copy().feed(tail)
        full = prefix.feed(text[len(text) - cut :])
        return [doc_id, len(text), hashlib.sha256((head + tail).encode()).hexdigest(), full, edited]

    def row(done, after):
        doc_id, n, digest, full, edited = done
        return (doc_id, n, digest, full.fingerprint(), edited.fingerprint(), full.likeness(edited), full.likeness(after))

    def out(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    plain = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    wide = pa.schema([*plain, ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())])

    def inner(batches: Iterator[pa.RecordBatch]):
        """Whole rows, a row with the partition's first text, and one with its last row's id and text."""
        walk, part, rows = Walk(samples), TaskContext.get().partitionId(), []
        before = waiting = None  # the row before; the one before that, which waits for the full fingerprint of its next
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                if before is None:
                    rows.append((None,) * 7 + (part, text, None))
                else:
                    done = complete(walk.start(), walk, *before, text)
                    if waiting:
                        rows.append(row(waiting, done[3]) + (None, None, None))
                    waiting = done
                before = doc_id, text
            if rows:
                yield out(rows, wide)
                rows = []
        if before is not None:
            if waiting:
                rows.append(row(waiting, walk.start().feed(before[1])) + (None, None, None))
            rows.append((before[0],) + (None,) * 6 + (part, None, before[1]))
            yield out(rows, wide)

    def edges(batches: Iterator[pa.RecordBatch]):
        walk = Walk(samples)
        for b in batches:
            rows = [row(complete(walk.start(), walk, i, last, first), walk.start().feed(first)) for i, last, first in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield out(rows, plain)

    falling = F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), falling, "tie").sortWithinPartitions(falling, "tie", "text").select("doc_id", "text")
    made = staged(ordered.mapInArrow(inner, f"{RESULT}, part int, first string, last string"))
    parts = made.where("first is not null").select("part")
    order = Window.orderBy("part")  # one row for each partition
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("then"))
    firsts = made.where("first is not null").select(F.col("part").alias("then"), "first")
    lasts = made.where("last is not null").select("doc_id", "last", "part").join(follows, "part").join(firsts, "then").select("doc_id", "last", "first")
    return made.where("part is null").select(*plain.names).union(lasts.mapInArrow(edges, RESULT))
