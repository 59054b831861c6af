"""What workers and the driver hold: one cache at a time, n-grams as numbers."""

from __future__ import annotations

import gc
import random
import tracemalloc
import weakref

import pytest

for _module in ("tokenizers", "sentencepiece", "ahocorasick", "public_tokenizers"):
    pytest.importorskip(_module)

from patcheval.llm import pieces, toxicity, word_cache  # noqa: E402
from patcheval.llm.common import tokenizer_file  # noqa: E402


def test_a_worker_keeps_one_encoder():
    first = pieces.piece_encoder(tokenizer_file("piece_bpe_32k.model"))
    assert pieces.piece_encoder(tokenizer_file("piece_bpe_32k.model")) is first
    gone = weakref.ref(first)
    del first
    second = word_cache.word_encoder(tokenizer_file("byte_bpe_50k.json"))
    gc.collect()
    assert gone() is None
    assert word_cache.word_encoder(tokenizer_file("byte_bpe_50k.json")) is second


def test_training_holds_ngrams_as_numbers():
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefghij", k=12)) for _ in range(500)) for _ in range(60)]
    s = toxicity.Settings(buckets=1 << 10, dim=2, rounds=1)
    tracemalloc.start()
    try:
        toxicity.fit(texts, [i % 2 for i in range(60)], (30, 30), s)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 30,000 words of 30 n-grams: 4 bytes each, not an object each
    assert peak < 25e6, peak
