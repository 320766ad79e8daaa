"""Secrets without a digit, and secrets wider than the room around an anchor."""

import random
import string

import pytest

from histomesh.llm import personal


@pytest.fixture(scope="module")
def field(docs):
    return personal.train(personal.stretches(docs))


def test_secrets_of_letters_are_found_and_words_left(spark, field):
    r = random.Random(8)
    secrets = ["".join(r.choice(string.ascii_letters) for _ in range(r.choice([24, 32, 40]))) for _ in range(40)]
    words = ["internationalization", "Geschwindigkeitsbegrenzung", "responsibilities and characteristically", "anticonstitutionnellement"]
    rows = [(k, f"keep the token = \"{s}\" to yourself") for k, s in enumerate(secrets)] + [(100 + k, f"they speak of {w} here") for k, w in enumerate(words)]
    found = {r["doc_id"]: r["redacted"] for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert sum(found[k] == 'keep the token = "[SECRET]" to yourself' for k in range(40)) >= 36
    assert [found[100 + k] for k in range(len(words))] == [None] * len(words)


def test_zones_hold_whole_tokens():
    for text in ("see " + "k" * 60 + "7" + "x" * 60 + " now", "7" + "x" * 60, "x" * 60 + "7", "a " * 30 + "7 " + "b" * 70 + " c"):
        whole = {m.span() for m in personal._TOKEN.finditer(text)}
        assert all(set(tokens) <= whole for tokens in personal.zones(text, []))
