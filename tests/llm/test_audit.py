"""The filter audit against plain Python."""

import re
from itertools import permutations

import numpy as np
import pytest

from histomesh.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string"


def plain(docs, labels):
    """docs: (doc_id, source, text); the report by applying every order to every part."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = {}
    for i, s, t in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        marks = [any(lab[k] == 1 for lab in labels if lab[0] == i and i is not None) for k in (1, 2)]
        parts.setdefault(s or "", []).append(({f for f in fails if fails[f]}, *marks))
    out = []
    for part, rows in parts.items():
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                failing = [r for r in rows if f in r[0]]
                steps.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def found(spark, docs, labels):
    table = spark.createDataFrame([(i, s, t, True) for i, s, t in docs], "doc_id long, source string, text string, first boolean")
    marks = spark.createDataFrame([(*lab, "x") for lab in labels], LABELS)
    result = audit.audit(table.repartition(3), marks)
    assert result.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, result.collect()))


def test_every_order_equals_applying_it(spark, texts):
    docs = [(i, s, t) for i, t, _, s in texts] + [(3000 + k, "s1", f"A{'B' * k} # {k} " + "w " * (90 * k)) for k in range(6)]
    docs += [(i + 5000, s, t) for i, s, t in docs[:40]]
    labels = [(i, k % 2, k % 3 == 0) for k, (i, _, _) in enumerate(docs[::2])] + [(docs[0][0], 1, None), (None, 1, 1), (99999, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_odd_rows(spark):
    docs = [(1, "s", "one two"), (1, "s", "one two"), (1, "s", "other"), (2, None, "one two"), (3, "", None), (4, "t", ""), (None, "t", "one two"), (None, "t", None), (None, None, "x")]
    labels = [(1, 1, None), (1, 0, 1), (4, None, None), (None, 1, 1)]
    assert found(spark, docs, labels) == plain(docs, labels)
    assert found(spark, [], labels) == []
    assert found(spark, docs, []) == plain(docs, [])


def test_a_very_long_text_and_shared_ranges(spark):
    docs = [(1, "s", "word " * 300_000), (2, "s", "Ab " * 100_000), (3, "s", "word " * 300_000)]
    assert found(spark, docs, [(3, 1, 1)]) == plain(docs, [(3, 1, 1)])


@pytest.mark.parametrize("seed", range(5))
def test_lists(seed):
    r = np.random.default_rng(seed)
    lists = [np.unique(r.integers(0, 10 ** (seed + 1), n)) for n in (0, 1, 3000, 40, 20000)]
    sets = [set(x.tolist()) for x in lists]
    mark = np.unique(r.integers(0, 10 ** (seed + 1), 500))
    for a in lists:
        for b in lists:
            assert audit.merged(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))
            assert a[audit.held_in(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            assert audit.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    seen = 0
    for f, mask, gone, removed, marked in audit.differences(lists, [mark]):
        before = set().union(*[s for k, s in enumerate(sets) if mask >> k & 1])
        assert (gone, removed) == (len(before | sets[f]), len(sets[f] - before))
        assert marked == len((sets[f] - before) & set(mark.tolist()))
        seen += 1
    assert seen == 80


def test_number_of_filters(spark):
    with pytest.raises(ValueError, match="filters"):
        audit.interactions(None, list("ABCDEFG"), [])
