"""Token ids as flat binary files with 64-bit offsets.

Documents are range-partitioned and sorted by id. Each task encodes its documents and
writes two files to the shared folder: ``.ids`` (ids as unsigned little-endian integers,
16 bits wide where the vocabulary allows, else 32) and ``.off`` (64-bit offsets of the
documents, then their 64-bit doc_ids). A manifest of the files that finished tasks wrote is
kept as a table, so files of failed or repeated attempts are never read. The base of a
file, i.e. the ids of all files before it, is a prefix sum over the manifest (one row for
each file); readers memory-map the files, or read ranges of them where the file system is no
mounted one.

Defined cases: a null text counts as empty and has the end id alone; a very long text is
encoded in parts and read back in pieces; documents with a null doc_id come first; rows that
share a doc_id follow the hash of their text, so that many of them are dealt over several
tasks, and repeated rows are written once each; an empty table makes no file and no row;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import byte_alphabet
from lodestone.llm.common import partitions, shared_dir, staged
from lodestone.llm.stores import Store

MANIFEST = "part int, path string, width int, n_docs long, n_ids long"


class Encoder:
    """Encodes texts as the tokenizers library does, by its model, remembering the parts of texts.

    The byte-level pattern cuts texts into parts that the model encodes one by one. In texts of
    ASCII and Latin letters that pattern is :attr:`PLAIN`. It always starts a new part at a
    space that a visible character follows, so another text is cut there, and what is not plain
    goes through the whole library, as do texts that name an added token.
    """

    #: A space before a character that every definition counts as visible.
    CUT = re.compile(" (?=[!-~À-ɏ])")
    #: The byte-level pattern within plain characters. Fixed values.
    PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
    OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
    #: Characters taken from a text at once, cut as above.
    SECTION = 1 << 18

    def __init__(self, path: str, max_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.tok, self.added = tok, [t.content for t in tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # the model alone encodes a part, once its bytes have been written as the byte-level alphabet does
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.store = Store(self._made, max_bytes)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _made(self, parts: list[str]) -> Iterator[bytes]:
        tokenize, shown, code, other = self.tok.model.tokenize, self.shown, self.code, self.OTHER.search
        for p in parts:
            yield self.whole(p) if other(p) else array(code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))]).tobytes()

    def sections(self, text: str) -> Iterator[list[str] | bytes]:
        if any(a in text for a in self.added):
            yield self.whole(text)
            return
        at = 0
        while at < len(text):
            cut = self.CUT.search(text, at + self.SECTION) if len(text) - at > self.SECTION else None
            to = cut.start() if cut else len(text)
            yield self._parts(text[at:to])
            at = to

    def _parts(self, text: str) -> list[str]:
        if not self.OTHER.search(text):
            return self.PLAIN.findall(text)
        parts: list[str] = []
        for i, p in enumerate(self.CUT.split(text)):
            p = " " + p if i else p
            parts += [p] if self.OTHER.search(p) else self.PLAIN.findall(p)
        return parts

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        return self.store.texts(map(self.sections, texts))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks; its store is emptied after each."""
    return Encoder(path)


def _open_out(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_output_stream(name)


@contextmanager
def _opened(path: str) -> Iterator[Callable[[int, int], np.ndarray]]:
    """A function that gives the bytes from one place of a file to another: memory-mapped on a mounted file system, by ranged reads elsewhere."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    if isinstance(where, fs.LocalFileSystem):
        data = np.memmap(name, np.uint8, "r")
        yield lambda a, b: data[a:b]
    else:
        with where.open_input_file(name) as f:
            yield lambda a, b: np.frombuffer(f.read_at(b - a, a), np.uint8)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out: str | None = None) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order; returns the manifest with ``base``.

    ``base`` is the number of ids in all files before the row's file.
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark)
    if "://" not in out:
        out = f"file://{out}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(tokenizer_path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        path = f"{out}/part-{part:06d}-{uuid.uuid4().hex}"
        where, folder = fs.FileSystem.from_uri(out)
        where.create_dir(folder, recursive=True)
        lengths, ids = [np.zeros(1, np.int64)], []

        def rest():
            yield first
            yield from batches

        try:
            with _open_out(f"{path}.ids") as f:
                for batch in rest():
                    for at in range(0, batch.num_rows, 512):
                        some = batch.slice(at, 512)
                        data = [d + end for d in enc.encode_all(text.as_py() or "" for text in some.column(1))]
                        f.write(b"".join(data))
                        lengths.append(np.asarray([len(d) for d in data], np.int64) // enc.dtype.itemsize)
                        ids.append(some.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
        finally:
            enc.store.forget()
        offsets = np.cumsum(np.concatenate(lengths))
        with _open_out(f"{path}.off") as f:
            f.write(offsets.astype("<i8").tobytes())
            f.write(np.concatenate(ids).astype("<i8").tobytes())
        row = {"part": [part], "path": [path], "width": [enc.dtype.itemsize], "n_docs": [len(offsets) - 1], "n_ids": [int(offsets[-1])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    manifest = staged(ordered.mapInArrow(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


#: Bytes of ids that a reader has in hand, but for a longer document, which is read in pieces of as many.
READ = 8 << 20


def _crcs(ids: Callable[[int, int], np.ndarray], at: np.ndarray, width: int) -> np.ndarray:
    """The crc32 of each document's ids as 32-bit integers; ``at`` are the documents' offsets."""
    out, step, n = np.empty(len(at) - 1, np.int64), READ // width, len(at) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        if at[j] - at[i] <= step:
            held = ids(int(at[i]) * width, int(at[j]) * width).view(f"<u{width}").astype("<u4")
            cut = (at[i : j + 1] - at[i]).tolist()
            out[i:j] = [zlib.crc32(held[a:b]) for a, b in pairwise(cut)]
        else:
            crc = 0
            for a in range(int(at[i]), int(at[j]), step):
                crc = zlib.crc32(ids(a * width, min(a + step, int(at[j])) * width).view(f"<u{width}").astype("<u4"), crc)
            out[i] = crc
        i = j
    return out


def read_token_files(manifest: DataFrame, docs_at_once: int = 65536) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, n, base in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "n_docs", "base")), strict=True):
                with _opened(f"{path}.off") as off, _opened(f"{path}.ids") as ids:
                    for a in range(0, n, docs_at_once):
                        b = min(a + docs_at_once, n)
                        at = off(8 * a, 8 * (b + 1)).view("<i8").astype(np.int64)
                        doc = off(8 * (n + 1 + a), 8 * (n + 1 + b)).view("<i8").astype(np.int64)
                        columns = [pa.array(doc, mask=doc == np.iinfo(np.int64).min), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(_crcs(ids, at, width))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(partitions(manifest.sparkSession), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
