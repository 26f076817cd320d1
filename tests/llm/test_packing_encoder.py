"""The packing encoder against the vocabulary's own encoder, text by text."""

import random

import numpy as np

from kindred.llm import packing


def test_texts_by_numbered_chunks_have_the_ids_of_whole_texts():
    encoder = packing.Encoder.of(packing.default_vocabulary())
    r = random.Random(7)
    parts = ["a", "b", "foo", "'s", "12", " ", " ", " ", "\n", "\t", "\r\n", " ", "　", "é", "\U0001f600", "\x00", "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)] + ["", " ", "  ", "a ", " a", "a" * 5000]
    for some in (texts, texts[::-1], [], [""], ["a b"]):
        assert encoder.encode(some) == [np.array(encoder.bpe.encode_ordinary(t), dtype="<u2").tobytes() for t in some]


def test_a_lone_surrogate_among_texts_is_encoded():
    encoder = packing.Encoder.of(packing.default_vocabulary())
    texts = ["one two", "odd \ud800x three", "\udfff"]
    assert encoder.encode(texts) == [np.array(encoder.bpe.encode_ordinary(t), dtype="<u2").tobytes() for t in texts]


def test_an_encoder_that_forgot_its_chunks_gives_the_same_ids():
    encoder = packing.Encoder.of(packing.default_vocabulary())
    before = encoder.encode(["one two three", "two  three"])
    assert encoder.cache
    encoder.forget()
    assert not encoder.cache
    assert encoder.encode(["one two three", "two  three"]) == before
