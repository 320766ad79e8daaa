"""Long texts of numbers: few segments are held at a time, and reading equals decoding all at once."""

import random
import tracemalloc

import numpy as np
import pytest

from histomesh.llm import personal


def numbers(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(str(r.randint(0, 99999)) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    own, r = personal.Field(), np.random.default_rng(2)
    own.weights[:] = r.normal(0, 0.3, own.weights.shape)
    own.follows[:] = r.normal(0, 0.3, own.follows.shape)
    return own


@pytest.mark.parametrize("text", [numbers(900, 1), "+49 (30) 12\n\n7  8-9.1.2.3 DE12 a", "ſ² ½1 ½ ²3 (4)", "", "x1" * 40])
def test_reading_equals_decoding_all_at_once(field, text):
    for tokens in personal.zones(text, []):
        listed = personal.candidates(text, tokens)
        assert field.read(text, tokens, 1.0) == field.decode(len(tokens), listed, 1.0)


def test_memory_grows_by_little_with_the_text(field):
    peaks = []
    for n in (2_000, 16_000):
        text = numbers(n, 3)
        tracemalloc.start()
        personal.spans(text, field)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 14_000 * 400


def test_taken_spans_are_walked_once():
    text = "\n".join(f"{k} a@b{k}.org and {'word ' * 12}" for k in range(400))
    base = [(a, b) for a, b, _ in personal.base_spans(text)]
    for tokens in personal.zones(text, base):
        first, last = tokens[0][0], tokens[-1][1]
        assert all(b <= first or a >= last for a, b in base)
