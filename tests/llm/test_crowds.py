"""Groups that many rows fall into: bounded, and with the same results as brute force."""

import random

import numpy as np
import pytest

from histomesh.llm import suffix


@pytest.fixture(scope="session")
def surrounded():
    """One passage in many surroundings, at edges of texts too, with repeats of the surroundings."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, rows = letters(170), []
    for k in range(60):
        left, right = letters(r.choice([0, 5, 40, 150])), letters(r.choice([0, 7, 60, 150]))
        rows.append((k, left + passage[r.choice([0, 0, 20]) : r.choice([170, 170, 150])] + right))
    ab = [rows[k][1][-80:] + rows[k + 1][1][:120] for k in range(0, 20, 2)]
    rows += [(100 + k, t) for k, t in enumerate(ab)] + [(200, "xy" * 200), (201, "xy" * 90), (202, "z" * 150), (5, rows[5][1]), (7, rows[9][1] + "!"), (None, rows[3][1] + "?")]
    return rows


def without_repeats(rows, length):
    """(id, what is left) by looking at every string in turn."""
    seen, out = set(), []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = set()
        for a in range(len(text) - length + 1):
            if text[a : a + length] in seen:
                gone.update(range(a, a + length))
            seen.add(text[a : a + length])
        out.append((i, "".join(c for k, c in enumerate(text) if k not in gone)))
    return out


def test_crowded_anchors_give_what_brute_force_gives(spark, surrounded):
    rows = [r for r in surrounded if r[0] != 7]  # two texts under one id stand by hash
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = set(without_repeats(rows, 100))
    for crowd in (5, 4096):
        found = {(r["doc_id"], bytes(r["kept"]).decode()) for r in suffix.remove_repeats(docs, crowd=crowd).collect()}
        assert found == want


def test_no_group_stays_crowded(spark, surrounded):
    text = dict(surrounded[:60])
    passage = max((t for t in text.values()), key=len)
    gram = next(passage[k : k + 32] for k in range(len(passage) - 32) if sum(passage[k : k + 32] in t for t in text.values()) > 50)
    at = {i: t.index(gram) for i, t in text.items() if gram in t}
    rows = [(1, i, 0, a, max(a - 68, 0), bytearray(text[i][max(a - 68, 0) : a + 100].encode())) for i, a in at.items()]
    snippets = spark.createDataFrame(rows, "h long, id long, tie long, at long, start long, snippet binary")
    _, bounded = suffix.deal_again(snippets, 100, 3)
    assert len(rows) > 50 and max(r["count"] for r in bounded.groupBy("h").count().collect()) <= 3


def test_every_string_lies_in_one_snippet_with_the_same_anchor_wherever_it_is():
    r = random.Random(6)
    letters = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    passage, owners = letters(400), {}
    for text in (letters(150) + passage + letters(99), passage + letters(300), b"xy" * 200 + passage[:250], b"z" * 180, passage[:100], passage[:99]):
        h, _, at, shape = suffix.anchors(np.frombuffer(text, np.uint8), 100)
        spans = [(b - s // 200, b + s % 200, b, a) for a, b, s in zip(h.tolist(), at.tolist(), shape.tolist(), strict=True)]
        assert [k for start, end, *_ in spans for k in range(start, end - 99)] == list(range(max(len(text) - 99, 0)))
        for start, end, b, a in spans:
            assert start <= b and b + suffix.GRAM <= start + 100
            for k in range(start, end - 99):
                assert owners.setdefault(text[k : k + 100], (a, b - k)) == (a, b - k)
