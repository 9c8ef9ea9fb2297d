"""Byte pair encoding as a bounded-lookahead streaming transducer, and its inverse.

A word's symbols are read from left to right into a buffer. From the merge list a
sufficient lookahead is computed: no merge can depend on a symbol farther to the right of
its own end. So a token whose end has that many symbols after it in the buffer is stable
and is emitted; the buffer never holds more than a fixed number of symbols, however long
the word. Words that occur again are taken from a store bounded in bytes, emptied after each
task. How a text becomes words is the library's own normalizing and splitting, applied to
parts of the text between white space.

Decoding is an incremental state machine: ids go in one by one, text comes out as soon as
its bytes are complete (or, for vocabularies without a byte decoder, token by token).

Defined cases: a null text counts as empty and gives no ids and an empty text; a very long
text goes through in parts, a very long word through the buffer; rows with a null or the same
doc_id are treated each for itself, and repeated rows give repeated results; an empty table
gives no rows; columns besides doc_id and text are not read by :func:`encode`, and kept
unchanged by :func:`decode`.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stores import Store

#: Texts of these characters alone need no tables: NFC leaves them as they are and each belongs to one known class.
OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
GAPS = re.compile("[\t\n\r ]+")
#: The splitting pattern that :data:`PLAIN` stands for in such texts, once these are in lower case. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Characters taken from a text at once, cut at white space.
SECTION = 1 << 18
ABSENT, WIDE = 1 << 60, 24
#: Words of up to so many characters are merged side by side, and runs of so many symbols without a heap.
SHORT = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols to the right of a merge's end on which the merge can depend, at most.

    A merge (u, v) fails at a place when an earlier merge (a, b) has taken the right end of
    v, where a is v or a right-most part of it. Whether that happened depends on b's end in
    the same way, so the reach is the longest such chain of ever earlier merges.
    """
    made = {a + b: (a, b) for a, b in merges}
    reach: dict[str, int] = {}  # of the earlier merges that begin with a token: the farthest symbol that matters
    most = 0
    for u, v in merges:
        far, part = 0, v
        while True:
            far = max(far, reach.get(part, 0))
            if part not in made:
                break
            part = made[part][1]
        most = max(most, far)
        reach[u] = max(reach.get(u, 0), length(v) + far)
    return most


class BpeTransducer:
    """Encoder and decoder for a tokenizers JSON file with a BPE model and a splitting pattern.

    The merges are done here; how a text becomes words is left to the library's normalizer
    and splitter, but for texts of Latin letters, digits and ASCII, where a pattern is enough.
    """

    def __init__(self, path: str, max_bytes: int = 36 << 20):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec.get("normalizer") or {"normalizers": []}
        kinds = {s["type"] for s in steps.get("normalizers", [steps])}
        splits = [s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
        if kinds - {"NFC", "Replace", "Lowercase"} or len(splits) != 1 or model["type"] != "BPE" or not splits[0]["invert"] or splits[0]["behavior"] != "Removed":
            raise ValueError(f"{path}: only BPE models with one splitting pattern are supported")
        pattern = splits[0]["pattern"]["Regex"]
        self.plain = pattern == PATTERN and "Lowercase" in kinds
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if len({a + b for a, b in merges}) < len(merges):
            raise ValueError(f"{path}: two merges make the same token")
        self.vocab = model["vocab"]
        number = self.vocab.__getitem__
        #: A pair of tokens as one number -> the merge's place in the list; and the token that each merge makes.
        self.rank = {number(a) << WIDE | number(b): i for i, (a, b) in enumerate(merges)}
        self.made = [number(a + b) for a, b in merges]
        # the same as arrays, for many words at once
        self.made_array = np.asarray(self.made)
        self.pairs = np.sort(np.fromiter(self.rank, np.int64, len(self.rank)))
        self.places = np.asarray([self.rank[p] for p in self.pairs.tolist()])
        self.lengths = {i: self.length(t) for t, i in self.vocab.items()}
        self.longest = max(self.lengths.values())
        self.lookahead = sufficient_lookahead(merges, self.length)
        self.buffer = self.lookahead + max(4096, 2 * self.longest)
        self.bytes = byte_alphabet()
        #: The token of each byte within a word, and as its last.
        self.inner, self.last = ([self.vocab.get(c + end, -1) for c in self.bytes] for end in ("", self.end))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.store = Store(self.words, max_bytes)

    def length(self, token: str) -> int:
        return len(token) - len(self.end) * bool(self.end and token.endswith(self.end))

    def merged(self, parts: list[int]) -> list[int]:
        """The tokens of some symbols: the earliest merge that applies is done at its first place, again and again."""
        if len(parts) > SHORT:
            return self._merged_by_heap(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << WIDE | b, ABSENT) for a, b in pairwise(parts)]
        while ranks and (low := min(ranks)) != ABSENT:
            i = ranks.index(low)
            parts[i] = new = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << WIDE | new, ABSENT)
            if i < len(ranks):
                ranks[i] = rank(new << WIDE | parts[i + 1], ABSENT)
        return parts

    def _merged_by_heap(self, parts: list[int]) -> list[int]:
        """The same, with the merges that may apply in a heap; for long runs of symbols."""
        rank, made, n = self.rank.get, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(parts)) if (r := rank(a << WIDE | b, ABSENT)) != ABSENT]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << WIDE | parts[j], ABSENT) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := rank(parts[i] << WIDE | parts[k], ABSENT)) != ABSENT:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := rank(parts[h] << WIDE | parts[i], ABSENT)) != ABSENT:
                heapq.heappush(heap, (new, h))
        return [t for t in parts if t >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """The tokens of one word, each as soon as it is stable."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.buffer:
                sure, done = len(held) - self.lookahead, 0
                for token in self.merged(held[:]):
                    n = self.lengths[token]
                    if done + n > sure:
                        break
                    yield token
                    done += n
                del held[:done]
        yield from self.merged(held)

    def symbols(self, word: str) -> Iterator[int]:
        """The tokens of a word's bytes, the last that of a word's end."""
        before = -1
        for at in range(0, len(word), 4096):
            for c in word[at : at + 4096].encode():
                if before >= 0:
                    yield self.inner[before]
                before = c
        yield self.last[before]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words as little-endian 32-bit integers; those that are far from filling the buffer are merged side by side."""
        short = [w for w in words if len(w) <= SHORT]
        got = dict(zip(short, self._side_by_side(short), strict=True)) if short else {}
        return [got[w] if len(w) <= SHORT else array("i", self.stream(self.symbols(w))).tobytes() for w in words]

    def _side_by_side(self, words: list[str]) -> Iterator[bytes]:
        """In each round every word gets one merge, the earliest that applies, at its first place; words without one leave."""
        held = pa.array(words, pa.large_string())
        _, offsets, values = held.buffers()
        ends = np.frombuffer(offsets, np.int64)[1 : len(words) + 1]
        data = np.frombuffer(values, np.uint8)[: ends[-1]]
        token = np.asarray(self.inner)[data]
        token[ends - 1] = np.asarray(self.last)[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        rank = np.full(len(token), ABSENT)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(token[:-1], token[1:]), ABSENT)
        finished = []
        while len(token):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(word)))
            if (low == ABSENT).any():
                going = np.repeat(low != ABSENT, size)
                finished.append((word[~going], token[~going]))
                word, token, rank = word[going], token[going], rank[going]
                size, low = size[low != ABSENT], low[low != ABSENT]
                if not len(token):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            at = at[np.diff(word[at], prepend=-1) != 0]
            token[at] = self.made_array[low]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            rank[at] = rank[at + 1]  # whether a symbol of the word follows; the rank itself is set anew
            word, token, rank = word[stays], token[stays], rank[stays]
            at -= np.arange(len(at))
            after = at[(at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])]
            rank[at] = ABSENT
            rank[after] = self._ranks(token[after], token[after + 1])
            before = at[(at > 0) & (word[at - 1] == word[at])] - 1
            rank[before] = self._ranks(token[before], token[before + 1])
        word, token = (np.concatenate(c) for c in zip(*finished, strict=True))
        order = np.argsort(word, kind="stable")
        flat = token[order].astype("<i4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]) * 4
        return (flat[a:b] for a, b in pairwise(cuts.tolist()))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << WIDE | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.places[at], ABSENT)

    def _piece(self, piece: str) -> list[str]:
        """The words of text that holds no added token."""
        if self.plain and not OTHER.search(piece):
            return PLAIN.findall(piece.lower())
        normal = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return [w for w, _ in self.splitter.pre_tokenize_str(normal)]

    def _sections(self, text: str) -> Iterator[list[str]]:
        """The same for a text of any length, a part at a time; no word and no composed character reaches over white space."""
        at = 0
        while at < len(text):
            gap = GAPS.search(text, at + SECTION) if len(text) - at > SECTION else None
            to = gap.end() if gap else len(text)
            part = text[at:to]
            if self.plain and OTHER.search(part):
                yield [w for piece in GAPS.split(part) for w in self._piece(piece)]
            else:
                yield self._piece(part)
            at = to

    def sections(self, text: str) -> Iterator[list[str] | bytes]:
        """The words of a text, section by section, and the ids of added tokens between them."""
        if self.special is None or not any(a in text for a in self.added):
            yield from self._sections(text)
            return
        for part in self.special.split(text):
            if part in self.added:
                yield np.asarray([self.added[part]], "<i4").tobytes()
            else:
                yield from self._sections(part)

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return self.store.texts(map(self.sections, texts))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decoder(self) -> Decoder:
        return Decoder(self)


@lru_cache(maxsize=2)
def transducer(path: str) -> BpeTransducer:
    """The tables of one file, for each Python worker, which runs many tasks; its store is emptied after each."""
    return BpeTransducer(path)


#: Ids that the decoder takes at once.
RUN = 4096


class Decoder:
    """Takes ids one by one (or in runs) and returns the text that they complete."""

    def __init__(self, bpe: BpeTransducer):
        self.tokens, self.started = bpe.tokens, False
        self.values = {c: b for b, c in enumerate(bpe.bytes)} if bpe.byte_decoder else None
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        tokens = list(map(self.tokens.__getitem__, ids))
        if self.values is None:
            text = " ".join(tokens)
            if tokens and self.started:
                text = " " + text
            self.started = self.started or bool(tokens)
            return text
        get = self.values.get
        data = b"".join(bytes(map(get, t)) if all(c in self.values for c in t) else t.encode() for t in tokens)
        return self.utf8.decode(data, last)


def _pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _lists(runs: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in runs)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(runs), "<i4")))


def _texts(bpe: BpeTransducer, lists: pa.Array) -> pa.Array:
    """What lists of ids decode to, each read run by run."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(lists).fill_null(0))
    texts, at = [], 0
    for n in ends.tolist():
        machine, end = bpe.decoder(), at + n
        parts = [machine.feed(values[a : min(a + RUN, end)].tolist(), last=a + RUN >= end) for a in range(at, end, RUN)]
        texts.append("".join(parts))
        at = end
    return pa.array(texts, pa.string())


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows (doc_id, ids array<int>) of ``docs(doc_id, text)``."""

    def run(batches):
        bpe = transducer(tokenizer_path)
        try:
            for b in _pieces(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(bpe.encode_all(t.as_py() or "" for t in b.column(1)))], ["doc_id", "ids"])
        finally:
            bpe.store.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with its column ``ids`` replaced by ``text``; a null list gives an empty text."""
    kept = encoded.select(*(f"`{c}`" for c in encoded.columns if c not in ("ids", "text")))

    def run(batches):
        bpe = transducer(tokenizer_path)
        for b in _pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _texts(bpe, b.columns[-1])], [*kept_names, "text"])

    kept_names = kept.columns
    return encoded.select(*(f"`{c}`" for c in kept_names), "ids").mapInArrow(run, ", ".join(filter(None, [_fields(kept), "text string"])))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows (doc_id, ids, decoded): :func:`encode` and :func:`decode` in one pass, so that a task needs one Python worker."""

    def run(batches):
        bpe = transducer(tokenizer_path)
        try:
            for b in _pieces(batches):
                ids = _lists(bpe.encode_all(t.as_py() or "" for t in b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, _texts(bpe, ids)], ["doc_id", "ids", "decoded"])
        finally:
            bpe.store.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_trip(docs, tokenizer_path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
