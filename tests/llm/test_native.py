"""Fingerprints, mixing and sharding against plain Python."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from histomesh.llm import imatch, mixing, ring


def test_edited_text_and_likeness(docs, texts):
    ordered = sorted(texts)
    rows = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs, low=0.0, high=0.5).collect()}
    assert len(rows) == len(texts)
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    by_text = defaultdict(set)
    for i, text, *_ in texts:
        by_text[text or ""].add(rows[i]["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({p for prints in by_text.values() for p in prints}) > 100
    long = [r for r in rows.values() if r["n_chars"] > 200]
    assert sum(r["near_edited"] for r in long) > 3 * sum(r["near_next"] for r in long)


def test_fingerprint_is_the_sorted_terms_of_each_subset(spark):
    rows = spark.createDataFrame([(0, 1, "b a c a", "C b, A")], "home long, nth int, x string, y string")
    words = spark.createDataFrame([("a",), ("b",)], "t string").select(F.xxhash64("t").alias("term"))
    row = imatch.fingerprints(rows, {"x": "p", "y": "q"}, F.lit("f"), words, "home", "nth").first()
    assert row["p"] == row["q"] and row["facts"] == "f"
    assert [e["slot"] for e in row["p"]] == sorted(e["slot"] for e in row["p"])
    assert min(e["slot"] for e in row["p"]) >= 0


def test_lexicon_band(spark):
    texts = spark.createDataFrame([("all some",), ("all some",), ("all one",), ("all",)], "t string")
    kept = {r["term"] for r in imatch.lexicon(texts, "t", 0.4, 0.8).collect()}
    assert kept == {r["h"] for r in spark.createDataFrame([("some",)], "t string").select(F.xxhash64("t").alias("h")).collect()}


def test_successors_over_gaps(spark):
    keys = [5, -3, 1000000007, 6, 12]
    rows = imatch.successors(spark.createDataFrame([(k,) for k in keys + keys], "k long"), "k").collect()
    ordered = sorted(keys)
    assert dict(rows) == dict(zip(ordered, ordered[1:] + [None], strict=True))


def test_next_document_over_distant_ids(spark):
    rows = [(10**k, f"text number {k} of these") for k in range(12)]
    found = imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        k = len(str(r["doc_id"])) - 1
        text, after = rows[k][1], rows[(k + 1) % 12][1]
        half = len(text) // 2
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_of_odd_and_no_rows(odd, none):
    rows = imatch.edited_fingerprints(odd).collect()
    assert len(rows) == 5 and sum(r["doc_id"] is None for r in rows) == 2
    assert imatch.edited_fingerprints(none).collect() == []


def targets_by_resharing(sizes, weights, share, most):
    """Share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += unit * weight[s]
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix_targets_and_copies(docs, texts):
    rows = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    size = {i: len((t or "").encode().split()) for i, t, *_ in texts}
    sizes, taken = Counter(), Counter()
    for i, _, _, s in texts:
        sizes[s] += size[i]
    target = targets_by_resharing(sizes, (5, 2, 1), 1.5, 2.0)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["mix_size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        assert (r["row"], r["size"]) == ("x", 7)
        taken[r["source"]] += r["copies"] * r["mix_size"]
    largest = defaultdict(int)
    for i, _, _, s in texts:
        largest[s] = max(largest[s], size[i])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)


def test_mix_repeats_itself_and_splits_cells(docs):
    once = mixing.mix(docs, F.lit(1)).select("doc_id", "copies")
    assert sorted(once.collect()) == sorted(mixing.mix(docs.repartition(5), F.lit(1)).select("doc_id", "copies").collect())
    split = mixing.mix(docs, F.lit(1), cell_rows=4)
    per = split.groupBy("source").agg(F.sum("copies").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 1 for r in per)


def test_mix_emits_whole_copies_of_odd_rows(odd, none):
    mixed = mixing.mix(odd, mixing.word_count(F.col("text")))
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(none, F.lit(1)).collect() == []


def test_ring_is_balanced_gapless_and_repeatable(docs, texts):
    place = lambda df: ring.ring_shards(df, F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), shards=7, nodes=16)
    rows = place(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(texts)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = place(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_ring_walk_matches_key_by_key():
    """The counted walk places exactly as many rows per cell and shard as single keys would."""
    owner = ring.owners(5, 8, cells=64)
    counts = {c: (c * 7) % 5 for c in range(64)}
    total = sum(counts.values())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    used, waiting, want = [0] * 5, [(c, c) for c in range(64) for _ in range(counts[c])], Counter()
    while waiting:
        later = []
        for cell, at in waiting:
            shard = owner[at]
            if used[shard] < room[shard]:
                used[shard] += 1
                want[cell, shard] += 1
            else:
                at = (at + 1) % 64
                while owner[at] == owner[at - 1]:
                    at = (at + 1) % 64
                later.append((cell, at))
        waiting = later
    got = Counter()
    for cell, first, end, shard, _ in ring.walk(counts, owner, 5):
        got[cell, shard] += end - first
    assert got == want


def test_ring_moves_little_when_a_shard_is_added():
    before, after = ring.owners(10, 64), ring.owners(11, 64)
    moved = sum(a != b for a, b in zip(before, after, strict=True))
    assert moved < len(before) / 6 and all(b == 10 for a, b in zip(before, after, strict=True) if a != b)


def test_ring_of_odd_and_no_rows(odd, none):
    assert ring.ring_shards(odd, F.col("doc_id"), F.lit(0), shards=40).count() == 5
    assert ring.ring_shards(none, F.col("doc_id"), F.lit(0)).collect() == []
