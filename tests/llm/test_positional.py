"""Benchmark passages by the positional index, against plain Python."""

import random
import re
from collections import Counter

import pytest

from histomesh.llm import positional


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def plain(docs, items, width):
    out = []
    for i, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item, t in items:
            asked = words_of(t)
            n = min(width, len(asked))
            windows = {tuple(asked[k : k + n]) for k in range(len(asked) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int").repartition(3)
    return table, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")


def found(spark, docs, items, width):
    return sorted(map(tuple, positional.contamination(*tables(spark, docs, items), width).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["the", "of"] * 12 + [f"w{k}" for k in range(40)] + ["É", "naïve", "Ünï"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for k in range(25)]
    items += [(100, "the the the the the the"), (101, "zzz never seen"), (102, items[3][1]), (103, "É")]
    docs = []
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if k % 3 == 0:
            asked = items[k % len(items)][1].split(" ")
            a = r.randrange(len(asked))
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() if w.isascii() else w for w in asked[a : a + r.randint(1, 20)]]
        docs.append((k, r.choice([", ", " ", "\n--\t"]).join(words)))
    return docs, items


@pytest.mark.parametrize("width", [1, 3, 10])
def test_hits_equal_scanning(spark, corpus, width):
    docs, items = corpus
    assert found(spark, docs, items, width) == plain(docs, items, width)


def test_odd_rows(spark):
    docs = [(1, "a b c"), (1, "a b c"), (None, "x A-B c"), (2, None), (3, ""), (4, "..."), (None, None), (5, "a " * 50)]
    items = [(7, "a b"), (7, "a b"), (None, "b c"), (8, None), (9, "!"), (10, "a a"), (None, "a b")]
    assert found(spark, docs, items, 2) == plain(docs, items, 2)
    assert found(spark, docs, [], 2) == plain(docs, [], 2)
    assert found(spark, [], items, 2) == []


def test_a_very_long_text_of_frequent_words(spark):
    docs = [(1, "the of " * 60_000 + "rare one here " + "of the " * 60_000), (2, "one here")]
    items = [(1, "of the of rare one here of the"), (2, "here the")]
    assert found(spark, docs, items, 4) == plain(docs, items, 4)


def test_matches_are_maximal_runs(spark):
    docs, items = [(1, "q a b c d e q a b q")], [(5, "z a b c d e")]
    _, _, runs = positional.exact_matches(*tables(spark, docs, items), width=3)
    assert [(r["diagonal"], r["pos"], r["length"]) for r in runs.collect()] == [(0, 1, 5)]


def test_proximity_equals_scanning(spark, corpus):
    docs, items = corpus
    width, slack = 4, 2
    counts = Counter(w for _, t in docs for w in words_of(t))
    expected = set()
    for i, t in docs:
        places = {}
        for k, w in enumerate(words_of(t)):
            places.setdefault(w, []).append(k)
        for item, text in items:
            asked = words_of(text)
            n = min(width, len(asked))
            for s in range(len(asked) - n + 1):
                rare = sorted((counts[asked[k]], asked[k], k) for k in range(s, s + n))
                if not rare[0][0]:
                    continue
                for a in places.get(rare[0][1], ()):
                    if n == 1:
                        expected.add((i, item, a - rare[0][2], 0))
                    for b in places.get(rare[1][1], ()) if n > 1 else ():
                        off = (b - rare[1][2]) - (a - rare[0][2])
                        if abs(off) <= slack:
                            expected.add((i, item, a - rare[0][2], off))
    near = positional.proximity_matches(*tables(spark, docs, items), width, slack).drop("row").collect()
    assert set(map(tuple, near)) == expected and len(near) == len(expected)
