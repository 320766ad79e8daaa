"""Near duplicates, components, repeats and top-k search against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.llm import components, covertree, induced, minhash, suffix, words


def shingles(text, width):
    seq = (text or "").encode().lower().split()
    return frozenset(tuple(seq[k : k + width]) for k in range(len(seq) - width + 1)) if len(seq) >= width else frozenset([tuple(seq)] if seq else [])


def groups(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(docs, texts, width):
    sets = {i: shingles(t, width) for i, t, *_ in texts}
    want = groups(sets, 80)
    rows = minhash.near_duplicates(docs, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_chain_that_no_centre_holds_together(spark, monkeypatch):
    """Links only between neighbours of a chain, blocks of a few members each."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[8 * k : 8 * k + 120])) for k in range(30)]
    want = groups({i: shingles(t, 2) for i, t in rows}, 80)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert len(set(want.values())) < 8


def test_near_duplicates_of_odd_and_no_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 5
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows)
    assert minhash.near_duplicates(none).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    least = minhash.least_matches(0.8, 1e-5)
    assert least == sorted(least) and least[-1] < 0.8 * minhash.HASHES
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, (4000, minhash.HASHES), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, a + 1)
    rows = np.arange(len(a))
    assert len(minhash.likely(a, b, rows, rows, least)) >= 3998
    b = np.where(r.random(a.shape) < 0.4, a, a + 1)
    assert len(minhash.likely(a, b, rows, rows, least)) < 10


def test_signatures_estimate_overlap():
    texts = [" ".join(f"w{k}" for k in range(low, low + 400)).encode() for low in (0, 40)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    sets, cuts = words.shingle_sets(data, at, 2)
    marks = minhash.signatures(sets, cuts)
    assert abs((marks[0] == marks[1]).mean() - 359 / 439) < 0.12


def test_words_across_steps(monkeypatch):
    monkeypatch.setattr(words, "STEP", 16)
    text = b"alpha  Beta\tgamma delta\x0bepsilon alpha " + b"x" * 40 + b" beta"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.word_bounds(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == text.split()
    h = words.word_hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[7] and len(set(h.tolist())) == 6


def test_components_of_random_links(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(0, k) for k in range(400, 600)] + [(7, 7)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {x: root(x) for x in parent} and len(found) == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_order_and_prefixes():
    r = random.Random(1)
    for _ in range(150):
        letters = r.choice([b"ab", b"abc", b"a", bytes(range(97, 110))])
        snippets = [bytes(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        codes = [c for k, s in enumerate(snippets) for c in [*((1, b) for b in s), (0, k)]]
        want = sorted(range(len(codes)), key=lambda i: codes[i:])
        order, common, _ = induced.suffix_order(snippets, r.choice([1, 1 << 20]))
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = codes[want[k - 1] :], codes[want[k] :]
            assert common[k] == next(n for n in range(len(codes)) if a[n : n + 1] != b[n : n + 1])


def repeats(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\x01" * length
            seen.add(raw[k : k + length])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1000, 2 << 20])
def test_repeats_equal_brute_force(spark, docs, texts, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    r = random.Random(2)
    passage = "".join(r.choice("xyz ,.") for _ in range(230))
    rows = [(i, t) for i, t, *_ in texts]
    rows += [(5000 + k, rows[k][1][:90] + passage[k : k + 150] + rows[k + 1][1][:200] + passage[: 100 + k]) for k in range(30)]
    rows += [(6000, "a" * 450), (6001, "b" + "a" * 130), (6002, passage[:99]), (6003, passage[:100] * 3)]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == repeats(rows, 100)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_repeats_of_odd_and_no_rows(spark, odd, none):
    assert len(suffix.remove_repeats(odd).collect()) == 5
    assert suffix.remove_repeats(none).collect() == []
    twice = spark.createDataFrame([(1, "q" * 20 + "r" * 200)] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in suffix.remove_repeats(twice).collect()] == [199, 199]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<long>")


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "DATA_BLOCK", 100)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 10)
    r = np.random.default_rng(3)
    points = r.integers(-900, 900, (600, 6))
    points[100:160] = points[5]
    points[200:230] = points[200] + r.integers(-2, 3, (30, 6))
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    data = vectors(spark, [*rows, (9000, None), (9001, [1, None, 2, 3, 4, 5]), (None, rows[0][1]), (9002, [1, 2]), rows[3]])
    found = covertree.top_k(vectors(spark, [x for x in rows if x[0] % 20 == 0]), data, k=7).collect()
    got = defaultdict(list)
    for q, rank, i, score in sorted(found):
        got[q].append((rank, i, score))
    for q in range(0, 600, 20):
        scores = sorted((-int(points[q] @ points[i]), i) for i in range(600) if i != q)[:7]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert len(got) == 30


def test_top_k_with_few_or_no_candidates(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (2, [0, 0])]
    found = covertree.top_k(vectors(spark, rows[:1]), vectors(spark, rows), k=10).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 11), (0, 2, 2, 0)]
    assert covertree.top_k(vectors(spark, []), vectors(spark, []), k=10).collect() == []
    assert covertree.top_k(vectors(spark, rows[:1]), vectors(spark, rows[:1]), k=10).collect() == []


def test_cover_tree_covers():
    points = np.random.default_rng(5).integers(-50, 50, (700, 3))
    tree = covertree.CoverTree(points)
    inside = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(700))
    for centre, radius, start, end, _ in tree.nodes:
        assert np.sqrt(((inside[start:end] - centre) ** 2).sum(1)).max() <= radius + 1e-9


def test_long_words_made_to_agree_stay_different(spark):
    """A sequence of two letters and its complement agree under any polynomial modulo 2^64."""
    from histomesh.llm import minhash

    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(1, f"p q r s {one} t u"), (2, f"p q r s {other} t u"), (3, f"p q r s {one.upper()} t u")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1}
