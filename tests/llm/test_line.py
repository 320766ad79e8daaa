"""The mix of small cells is the mix of the registered SQL."""

import math
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from histomesh.llm import mixing


def by_line(rows, targets):
    """(id, copies) with documents lined up by (size, key) as SQL["op8_mixing"] does."""
    of, found = defaultdict(list), []
    for i, size, source in rows:
        of[source].append((size, i is not None, i or 0))
    for source, own in of.items():
        total, u = sum(o[0] for o in own), int(md5(f"0:{'n' if source is None else 's' + source}".encode()).hexdigest()[:8], 16) / 4294967296.0
        e = targets[source] / total if total else 0
        for n, (size, known, i) in enumerate(sorted(own), 1):
            found.append((i if known else None, math.floor(n * e + u) - math.floor((n - 1) * e + u)))
    return sorted(found, key=str)


@pytest.mark.parametrize("cell_rows", [1, 8, 40, 1 << 20])
@pytest.mark.parametrize("equal", [False, True])
def test_line_is_the_same_at_every_cell_size(spark, cell_rows, equal):
    rows = [(k * 7919 % 1000, 5 if equal else k * k % 90, ("a", "b", None)[min(k % 5, 2)]) for k in range(400)] + [(None, 5, "a"), (None, 70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string").repartition(5)
    mixed = mixing.mix(docs, F.col("size"), cell_rows=cell_rows).collect()
    targets = {r["source"]: r["target"] for r in mixed}
    assert sorted(((r["doc_id"], r["copies"]) for r in mixed), key=str) == by_line(rows, targets)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17])
def test_part_counts_the_bounds_below(spark, n):
    bounds = list(range(0, 10 * n, 10))
    length = math.isqrt(n - 1) + 1
    steps = [bounds[k : k + length] for k in range(0, n, length)]
    rows = spark.createDataFrame([(p, steps) for p in range(-1, 10 * n + 1)], "place int, steps array<array<int>>")
    found = rows.select("place", mixing.part_of(F.col("place"), F.col("steps")).alias("part")).collect()
    assert all(r["part"] == sum(b < r["place"] for b in bounds) for r in found)
    assert spark.createDataFrame([(1, None)], rows.schema).select(mixing.part_of(F.col("place"), F.col("steps"))).first()[0] == 0


def test_line_is_the_same_with_few_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "ab"[k % 2], k * 7 % 50) for k in range(200)], "doc_id long, source string, size int")
    plain = mixing.mix(docs, F.col("size"), cell_rows=1).select("doc_id", "copies").collect()
    monkeypatch.setattr(mixing, "MOST_BOUNDS", 9)
    assert sorted(mixing.mix(docs, F.col("size"), cell_rows=1).select("doc_id", "copies").collect()) == sorted(plain)
