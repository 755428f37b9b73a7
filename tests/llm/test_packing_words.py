"""Token ids for packing equal the library's, and words are remembered once, whatever stands beside them."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import packing


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


def texts():
    rng = random.Random(5)
    latin = [chr(i) for i in range(256)]
    parts = [*latin, *"''''' ..  ", "'s", "'T", "'re", "'VE", "'m", "'ll", "'d", "'l", "''s", "'s's", "it's", "don't", "Ära", "½", "1234", "&&&", ",***", "straße", "ÀÉ÷×ª"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    return [*some, None, "", " ", "'", "x'", "a" * 500, "Σ σς “x” 日本 ²", "a <|endoftext|> b's", "é é"]


def want(library, t):
    return np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_library(spec):
    library, encoder = Tokenizer.from_buffer(spec), packing.Encoder(spec)
    for several in (texts(), texts()[::-1], ["'ll"], [None], ["日'"], []):
        assert list(encoder.encode(several)) == [want(library, t) for t in several]


def test_words_are_remembered_once(spec):
    encoder = packing.Encoder(spec)
    list(encoder.encode(["Word word, word. (word) &&& word's", "word!"]))
    assert sorted(encoder.number) == sorted([b"word", b",", b".", b"(", b")", b"&&&", b"'s", b"!"])


def test_forgets_words_of_one_batch(spec, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 8)
    library, encoder = Tokenizer.from_buffer(spec), packing.Encoder(spec)
    for i in range(30):
        t = "usual words " + " ".join(f"{chr(97 + i % 26)}x{chr(97 + j)}" for j in range(9)) + f" {'long' * i}"
        assert list(encoder.encode([t, t + "'s"])) == [want(library, t), want(library, t + "'s")]
    assert len(encoder.number) < 40 and b"usual" in encoder.number
