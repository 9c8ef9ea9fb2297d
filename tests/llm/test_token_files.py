"""Token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lodestone.llm.token_files import Encoder, read_token_files, write_token_files  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.mark.parametrize("alphabet", ["ab c", "a  \n\t", "é漢 ̈\x1c\x85　\xa0x", "it's we'll 've,.!", "<|endoftext|> \n", "Aé1 9.,\n;", "\r\t x!2 ", "ª×÷µº ÿß"])
def test_pieces_give_what_whole_texts_do(library, alphabet):
    rng, own = random.Random(alphabet), Encoder(PATH, max_bytes=20_000)
    for n in [0, 1, 2, 3, 5, 10, 40, 300] * 15:
        parts = ["<|endoftext|>", " ", "\n", "a"] if "<|" in alphabet else alphabet
        text = "".join(rng.choices(parts, k=n))
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def in_order(spark, rows):
    """By doc_id, nulls first, then by the hash of the text, as Spark computes it."""
    from pyspark.sql import functions as F

    tie = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()} if rows else {}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1] or ""))


def check(got, rows, library, end=0):
    start, want = 0, []
    for i, t in rows:
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_files(docs, rows, make, library, tmp_path):
    manifest = write_token_files(docs, PATH, out=str(tmp_path))
    check(read_token_files(manifest).collect(), in_order(docs.sparkSession, rows), library)
    files = manifest.collect()
    assert sum(r.n_docs for r in files) == len(rows) and {r.width for r in files} == {2}
    first = min(files, key=lambda r: r.part)
    ids = np.memmap(first.path.removeprefix("file://") + ".ids", "<u2", "r")
    off = np.memmap(first.path.removeprefix("file://") + ".off", "<i8", "r")
    assert len(ids) == first.n_ids == off[first.n_docs] and first.base == 0 and len(off) == 2 * first.n_docs + 1


def test_odd_rows(make, library):
    rows = [(None, "x"), (3, None), (3, "b"), (3, "b"), (1, ""), (-5, "neg ative")]
    given = make(rows)
    check(read_token_files(write_token_files(given, PATH)).collect(), in_order(given.sparkSession, rows), library)
    assert read_token_files(write_token_files(make([]), PATH)).collect() == []


def test_what_is_remembered_is_bounded():
    own, rng = Encoder(PATH, max_bytes=100_000), random.Random(1)
    for _ in range(10):
        own.encode_all(" ".join("".join(rng.choices("abcdef", k=8)) for _ in range(300)) for _ in range(3))
        assert sum(len(w) + len(b) for w, b in [*own.store.young.items(), *own.store.old.items()]) < 100_000
    own.encode("e" * 1_000_000)
    assert max(map(len, own.store.young), default=0) <= 64


def test_long_texts_go_in_sections(library, monkeypatch):
    own = Encoder(PATH)
    monkeypatch.setattr(Encoder, "SECTION", 50)
    rng = random.Random(5)
    for alphabet in ("ab c", "é日 x\n ", " \t\n"):
        text = "".join(rng.choices(alphabet, k=3000))
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_longer_than_a_read(make, library, monkeypatch):
    from lodestone.llm import token_files

    given = make([(1, "some words of it " * 50), (2, "x"), (3, None)])
    manifest = write_token_files(given, PATH)
    (row,) = [r for r in manifest.collect() if r.n_docs] if manifest.count() == 1 else [max(manifest.collect(), key=lambda r: r.n_ids)]
    monkeypatch.setattr(token_files, "READ", 64)
    with token_files._opened(f"{row.path}.ids") as ids, token_files._opened(f"{row.path}.off") as off:
        at = off(0, 8 * (row.n_docs + 1)).view("<i8")
        whole = ids(0, row.n_ids * row.width).view(f"<u{row.width}").astype("<u4")
        assert token_files._crcs(ids, at, row.width).tolist() == [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
