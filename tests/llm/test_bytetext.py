"""The vectorised readers against plain ones, on texts of any characters."""

import functools
import re

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import bytetext
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = st.sampled_from(["a", "B", "é", "日", " ", "\n", "\t", ".", ",", "'", "<|", "|>", "<|endoftext|>", "'s", "1", "²", "̸", " ", "\u0085", "ß", "Σ", "İ", "-", "don't", "\x00", "\U0001f600", "ﬁ"])
TEXTS = st.lists(st.lists(PIECES, max_size=25).map("".join), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    data, offsets = bytetext.of_arrow(pa.array(texts, pa.string()))
    starts, ends, first = bytetext.words(data, offsets)
    raw = data.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)] == [WORD.findall(t) for t in texts]
    h, _ = bytetext.word_hashes(data, offsets)
    names = [w for t in texts for w in WORD.findall(t)]
    assert len({(w, x) for w, x in zip(names, h.tolist(), strict=True)}) == len(set(names)) == len(set(h.tolist()))


def counting(bits):
    """The word that says of each number whether its bits are odd in number, and the opposite word: polynomials modulo 2 ** 64 can't tell them apart."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", range(3, 13))
def test_words_that_count_bits_differ(bits):
    data, offsets = bytetext.of_arrow(pa.array(counting(bits), pa.string()))
    starts, ends = offsets[:-1], offsets[1:]
    assert len(set(bytetext.words_hash(data, starts, ends).tolist())) == 2
    assert len(set(bytetext.span_hash(bytetext.prefix_hash(data), starts, ends).tolist())) == 2


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_span_hash_is_the_polynomial(raw):
    base, prime = bytetext._BASE, bytetext._PRIME
    data = np.frombuffer(raw, np.uint8)
    prefix = bytetext.prefix_hash(data)
    assert prefix.tolist() == [sum((c + 1) * pow(base, i, prime) for i, c in enumerate(raw[:k])) % prime for k in range(len(raw) + 1)]
    twice = np.concatenate([data, data])
    h = bytetext.span_hash(bytetext.prefix_hash(twice), np.array([0, len(data)]), np.array([len(data), len(twice)]))
    assert h[0] == h[1]


def test_long_runs_and_long_words():
    data = np.random.default_rng(1).integers(0, 256, bytetext._RUN + 50).astype(np.uint8)
    data[-40:] = data[:40]
    h = bytetext.span_hash(bytetext.prefix_hash(data), np.array([0, len(data) - 40]), np.array([40, len(data)]))
    assert h[0] == h[1]
    a, b = np.array([0, 0, 5]), np.array([8, 300, 5])
    assert bytetext.same_bytes(data, a, b, data, a, b).all()
    other = data.copy()
    other[[7, 299]] ^= 1
    assert bytetext.same_bytes(data, a, b, other, a, b).tolist() == [False, False, True]
    assert bytetext.same_bytes(data, a[:1], b[:1], data, a[:1], b[:1] - 1).tolist() == [False]


def test_encoder_tells_words_of_one_hash_apart():
    from graphloom.llm.packing import WordEncoder

    class Clashing(WordEncoder):
        hashes = staticmethod(lambda data, starts, ends: (ends - starts).astype(np.uint64))

    texts = ["one two six understanding", "two one ten and international waters", "understanding international", "eight888 seven77 eight889", " ".join(counting(10)), " ".join(counting(11))]
    got, plain = Clashing("word_bpe_49k.json"), WordEncoder("word_bpe_49k.json")
    for t in texts:
        one = bytetext.of_arrow(pa.array([t], pa.string()))
        ids, n = got.encode(*one)
        assert ids.tolist() == plain.encode(*one)[0].tolist() == plain.tokenizer.encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_encoder_is_the_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm.packing import WordEncoder

    global _encoder, _tokenizer
    if "_encoder" not in globals():
        _encoder, _tokenizer = WordEncoder("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, n = _encoder.encode(*bytetext.of_arrow(pa.array(texts, pa.string())))
    parts = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=4), st.integers(3, 12))
def test_runs_hold_every_window(texts, length):
    from graphloom.llm.suffix_dedup import Runs

    data, offsets = bytetext.of_arrow(pa.array(texts, pa.string()))
    runs = Runs(data, offsets, length, 3)
    seen = {}
    for t, s, n, p, a in zip(runs.text, runs.start, runs.windows, runs.place, runs.sample, strict=True):
        for w in range(n):
            text = texts[t][s + w : s + w + length]
            assert len(text) == length and seen.setdefault(text, (p - w, a)) == (p - w, a)  # equal windows, equal sample and place
    assert sum(runs.windows) == sum(max(0, len(t) - length + 1) for t in texts)


def test_encoder_gives_plain_words_to_the_model_alone():
    """Only words with other characters than plain letters go through the whole tokenizer, and all words have its ids."""
    from graphloom.llm.packing import WordEncoder

    class Watched:
        def encode_batch_fast(self, words, **options):
            seen.extend(words)
            return whole.encode_batch_fast(words, **options)

    encoder, seen = WordEncoder("word_bpe_49k.json"), []
    whole, encoder.tokenizer = encoder.tokenizer, Watched()
    odd = ["ª", "×", "naïve÷", "a1", "it's", "ǆ", "ﬁn", "née", "<|endoftext|>", "日本", "a­b", "Σ"]
    plain = ["the", "Größe", "NACIÓN", "ÀÖØÞßàöøÿ", "international", "É", "y", "ÿ", "zzzqqqxxx"]
    texts = [" ".join(plain), " ".join(odd), " ".join(plain[::-1] + odd[::-1]), "", *plain, *odd]
    ids, n = encoder.encode(*bytetext.of_arrow(pa.array(texts, pa.string())))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert sorted(seen) == sorted(odd)


@functools.cache
def encoder_of_latin():
    from graphloom.llm.packing import WordEncoder

    return WordEncoder("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]) | st.sampled_from("̸̧́ "), max_size=40), max_size=6))
def test_encoder_on_latin_letters(texts):
    ids, n = encoder_of_latin().encode(*bytetext.of_arrow(pa.array(texts, pa.string())))
    want = [encoder_of_latin().tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
