"""Words are looked up once for many texts; ids are those of the library whatever the white space."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

for _module in ("tokenizers", "public_tokenizers"):
    pytest.importorskip(_module)

from patcheval.llm import word_cache  # noqa: E402
from patcheval.llm.common import tokenizer_file  # noqa: E402


def test_each_different_word_is_looked_up_once():
    encoder = word_cache.WordEncoder(tokenizer_file("byte_bpe_50k.json"))
    asked, values = [], encoder.words.values
    encoder.words.values = lambda words: asked.extend(words) or values(words)
    texts = ["one two, two one."] * 500
    want = encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(pa.array(texts))] == [want] * 500
    assert sorted(asked) == ["one", "two"]


@pytest.mark.parametrize("together", [8_000_000, 500, 1])
def test_uneven_white_space_like_the_library(monkeypatch, together):
    monkeypatch.setattr(word_cache, "TOGETHER", together)
    r = random.Random(3)
    some = [*"ab Z9.,%: \n", " ", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "é", "ʯ", "ʰ", "中", "😀", "\u0301", "'s", "<|endoftext|>"]
    texts = ["".join(r.choices(some, k=r.randrange(40))) for _ in range(1500)]
    texts += [" ".join("".join(r.choices("abé.,%!;:ʰ中9'", k=r.randrange(1, 9))) for _ in range(r.randrange(30))) for _ in range(500)]
    encoder = word_cache.WordEncoder(tokenizer_file("byte_bpe_50k.json"), entries=100)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == want


def test_known_words_are_not_asked_again():
    encoder = word_cache.WordEncoder(tokenizer_file("byte_bpe_50k.json"))
    asked, values = [], encoder.words.values
    encoder.words.values = lambda words: asked.extend(words) or values(words)
    text = "some known words, then some more."
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for new in (["known", "more", "some", "then", "words"], []):
        asked.clear()
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([text, text])] == [want] * 2
        assert sorted(asked) == new


def test_words_in_use_stay_and_others_go():
    asked = []
    words = word_cache.Words(lambda new: asked.extend(new) or pa.array([w.encode() * 2 for w in new], pa.large_binary()), entries=20)
    for i in range(50):
        some = ["kept", "x" * 65, *(f"{i}-{j}" for j in range(9))]
        assert words.take(pa.array(some, pa.large_string())).to_pylist() == [w.encode() * 2 for w in some]
        assert len(words.known) == len(words.ids) == len(words.met) <= 2 * 20 + 10
    assert asked.count("kept") == 1 and asked.count("x" * 65) == 50
    assert words.take(pa.array([], pa.large_string())).to_pylist() == []


def test_lines_are_looked_up_one_by_one():
    encoder = word_cache.WordEncoder(tokenizer_file("byte_bpe_50k.json"))
    asked, values = [], encoder.words.values
    encoder.words.values = lambda words: asked.extend(words) or values(words)
    texts = ["a one\ntwo, one.\ntwo one\n\ntwo one\n", "a one\ntwo\none"] * 2
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == want
    assert sorted(asked) == ["\none", "\ntwo", "one", "one\n", "one\n\ntwo"]


def test_line_feeds_like_the_library():
    r = random.Random(11)
    some = ["\n", "\n", "\n", " ", " ", "ab", "Z", "9", ".", ",!", "'s", "é", "中", "́", "\t", "\xa0", "<|endoftext|>"]
    texts = ["".join(r.choices(some, k=r.randrange(40))) for _ in range(3000)]
    texts += [" ".join("\n".join(r.choices(["ab", "c.", "Dé,", "9", "'s", "中!"], k=r.randrange(1, 4))) for _ in range(r.randrange(9))) for _ in range(500)]
    encoder = word_cache.WordEncoder(tokenizer_file("byte_bpe_50k.json"), entries=100)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == want
