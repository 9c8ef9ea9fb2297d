"""The streaming transducer against the tokenizers library."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lodestone.llm.bpe import BpeTransducer, decode, encode, round_trip  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def own():
    return BpeTransducer(PATH, max_bytes=200_000)


@pytest.mark.parametrize("alphabet", ["ab", "etaoin shr", "é漢aΣİ ̈\x1c\x85", "a!1'sllve\n", "<|endoftext|> x", "ABÇ 12,.", "​﻿🙂 a"])
def test_random_texts(library, own, alphabet):
    rng = random.Random(alphabet)
    for n in [0, 1, 2, 5, 50, 700, 12000]:
        parts = [alphabet] if "<|" in alphabet and rng.random() < 0.5 else alphabet
        text = "".join(rng.choices(parts, k=n))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<i4").tolist() == want
        assert own.decoder().feed(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library, own):
    """Between letters, after a letter that marks combine with, and in a run of its kind."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20000):
        text = " ".join(f"a{c}b1 {c}{c}!" for c in points[at : at + 20000])
        got = np.frombuffer(own.encode(text), "<i4")
        assert np.array_equal(got, library.encode(text, add_special_tokens=False).ids), f"U+{ord(points[at]):04X} or later"


def test_tokens_come_out_before_the_word_ends(own):
    """A word without end takes no more memory than the buffer."""
    read = 0

    def endless():
        nonlocal read
        rng = random.Random(1)
        while True:
            read += 1
            yield own.inner[ord(rng.choice("etaoinshrdlu"))]

    stream = own.stream(endless())
    for _ in range(300):
        next(stream)
    assert read < own.buffer + 300 * own.longest


def test_streamed_tokens_are_those_of_the_whole_word(own):
    rng = random.Random(2)
    for alphabet in ("ab", "the", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choices(alphabet, k=5000))
        whole = own.merged(list(own.symbols(word)))
        assert list(own.stream(own.symbols(word))) == whole
        assert [np.frombuffer(b, "<i4").tolist() for b in own._side_by_side([word, "a", word[:9]])] == [whole, own.merged(list(own.symbols("a"))), own.merged(list(own.symbols(word[:9])))]


def test_what_is_remembered_is_bounded(own):
    rng = random.Random(3)
    for n in range(12):
        own.encode(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 90))) for _ in range(400)))
        assert own.store.size <= own.store.third and not any(len(w) > 64 for w in own.store.young)
        assert sum(len(w) + len(b) for w, b in [*own.store.young.items(), *own.store.old.items()]) < 200_000
    own.encode("e" * 100_000)
    assert max(map(len, own.store.young), default=0) <= 64
    own.store.forget()
    assert not own.store.young and not own.store.old


def test_decoding_in_parts(own, library):
    ids = library.encode("some text, Größe 漢字 and more", add_special_tokens=False).ids
    d = own.decoder()
    assert "".join(d.feed([i]) for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_bytes_become_text_when_complete(own):
    d = own.decoder()
    d.values = {c: b for b, c in enumerate(own.bytes)}
    shown = [own.bytes[b] for b in "é漢".encode()]
    d.tokens = dict(enumerate(shown))
    assert [d.feed([n]) for n in range(5)] == ["", "é", "", "", "漢"] and d.feed([3], last=True) == "�"


def test_operator(docs, rows, make, library):
    ids = encode(docs, PATH)
    got = {r.doc_id: r.ids for r in ids.collect()}
    texts = {r.doc_id: r.text for r in decode(ids, PATH).collect()}
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == want and texts[i] == library.decode(want, skip_special_tokens=False)
    assert {r.doc_id: (r.ids, r.decoded) for r in round_trip(docs, PATH).collect()} == {i: (got[i], texts[i]) for i in got}
    assert encode(make([]), PATH).collect() == round_trip(make([]), PATH).collect() == []
    again = encode(make([(None, "a"), (None, "a"), (1, None)]), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in decode(again, PATH).collect()) == [(0, "a</w>"), (0, "a</w>"), (1, "")]
