"""How filters of a corpus interact, from sorted posting lists of the documents each one fails.

Rows get a number once, in a written table; 65,536 numbers in a row are a range. For every
(part, range) each filter has the sorted list of the numbers it fails. Unions of filters are
galloping merges of these lists, each subset's from a smaller subset's and one list more;
what a filter removes after others is the difference of its list and their union. Lists of
different ranges have nothing in common, so sizes are added up over ranges. Any order of the
filters reads off these sizes: a step removes ``filter minus union of those before it``.

A part with a third of all rows is spread over its ranges, a task holds one range at a time,
and only sizes are shuffled.

Null texts are empty; null parts are the empty string. A document is a row: repeated rows count
each, a row without an id is nobody's copy. Of equal texts under one smallest id none is a copy. Labels of one
id are taken together (1 if any is 1). No documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut
from histomesh.llm.frames import pick

RANGE_BITS = 16
BLOCK = 512
MOST_FILTERS = 6
SALTS = 1024


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: short, repetitive, loud, marked up."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's part, failed filters A to E, and whether it is good or toxic.

    E is being identical to the text of a smaller id. Texts are read once; what is joined are
    digests. The smallest id of a text is found by an aggregation that combines before its
    shuffle, and met again under (id, digest), so a text with many copies is no hot key.
    """
    docs, labels = pick(docs, "doc_id", "source", "text"), pick(labels, "doc_id", "quality", "toxic")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    tests = [test.alias(name) for name, test in text_filters(F.col("text")).items()]
    read = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), *tests, digest.alias("digest")))
    firsts = read.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(0)
    rows = read.join(firsts, ["doc_id", "digest"], "left").withColumn("salt", spread)
    rows = rows.join(marked.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    return rows.select(
        "doc_id", "part", *"ABCD",
        (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def posting_lists(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(numbered, lists)``: the rows with their number ``nth``, and their posting lists.

    ``lists`` has one row per (part, range): the number of rows ``n`` and for each of the boolean
    columns ``names`` the sorted numbers of the rows where it holds.
    """
    numbered = cut(rows.withColumn("nth", F.monotonically_increasing_id()))
    span = F.shiftright("nth", RANGE_BITS).alias("range")
    held = [F.sort_array(F.collect_list(F.when(F.col(name), F.col("nth")))).alias(name) for name in names]
    return numbered, numbered.groupBy("part", span).agg(F.count(F.lit(1)).alias("n"), *held)


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``needles`` belongs in the sorted ``hay``.

    Block by block of needles: from the last place found, steps double until they pass the
    block, and only what they bracket is searched.
    """
    found = np.empty(len(needles), np.int64)
    low = 0
    for at in range(0, len(needles), BLOCK):
        block = needles[at : at + BLOCK]
        step = len(block)
        while low + step < len(hay) and hay[low + step] < block[-1]:
            step *= 2
        found[at : at + BLOCK] = low + np.searchsorted(hay[low : low + step + 1], block)
        low = int(found[at + len(block) - 1])
    return found


def held_in(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Which needles are in ``hay``."""
    if not len(hay):
        return np.zeros(len(needles), bool)
    at = gallop(needles, hay)
    return hay[np.minimum(at, len(hay) - 1)] == needles


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sorted union of two sorted lists without repeats; the shorter gallops through the longer."""
    if len(a) > len(b):
        a, b = b, a
    a = a[~held_in(a, b)]
    return np.insert(b, gallop(a, b), a) if len(a) else b


def differences(lists: list[np.ndarray], marks: list[np.ndarray]):
    """(filter, mask of those before, size of their union with it, removed, removed with each mark)."""
    unions = [lists[0][:0]]
    for mask in range(1, 1 << len(lists)):
        top = mask.bit_length() - 1
        unions.append(merged(unions[mask - (1 << top)], lists[top]))
    for f, own in enumerate(lists):
        for mask, before in enumerate(unions):
            if not mask >> f & 1:
                gone = own[~held_in(own, before)]
                yield f, mask, len(before) + len(gone), len(gone), *(int(held_in(gone, mark).sum()) for mark in marks)


def interactions(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Sizes of all differences of ``filters`` by part.

    One row per part, filter and subset of the others (``before``, a bit for each filter):
    ``gone`` by both, ``removed`` by the filter alone, and for each mark how many of these have it.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"needs 1 to {MOST_FILTERS} filters")

    def sizes(batches):
        for batch in batches:
            parts, found = [], []
            columns = {name: batch.column(name) for name in [*filters, *marks]}
            for row in range(batch.num_rows):
                held = {name: column[row].values.to_numpy(zero_copy_only=False) for name, column in columns.items()}
                new = list(differences([held[name] for name in filters], [held[name] for name in marks]))
                found += new
                parts += [batch.column("part")[row].as_py()] * len(new)
            values = np.array(found, np.int64).reshape(len(found), 4 + len(marks))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *map(pa.array, values.T)], names=["part", *numbers])

    numbers = ["filter", "before", "gone", "removed", *marks]
    schema = "part string, " + ", ".join(f"`{name}` long" for name in numbers)
    found = lists.select("part", *filters, *marks).mapInArrow(sizes, schema)
    return found.groupBy("part", "filter", "before").agg(*[F.sum(name).alias(name) for name in numbers[2:]])


def every_order(lists: DataFrame, filters: list[str], good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Part by part, every order of the filters with what each of its steps does."""
    spark, n = lists.sparkSession, len(filters)
    sizes = cut(interactions(lists, filters, [good, toxic]))
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[k] for k in order), step, f, before))
            before |= 1 << f
    steps = spark.createDataFrame(rows, "filter_order string, step int, filter long, before long")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    others = (1 << n) - 1 - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("filter").cast("int"))
    alone = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).cast("long").alias("shapley"),
    )
    totals = lists.groupBy("part").agg(F.sum("n").alias("n"))
    return (
        sizes.join(F.broadcast(steps), ["filter", "before"])
        .join(alone, ["part", "filter"])
        .join(totals, "part")
        .select(
            "part", "filter_order", "step",
            (F.col("n") - F.col("gone")).alias("kept"),
            "removed",
            (F.col("fails") - F.col("removed")).alias("redundant"),
            "unique_fails",
            F.col(good).alias("good_lost"),
            F.col(toxic).alias("toxic_lost"),
            "shapley",
        )
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over ``docs`` in every order; see the columns of ``every_order``."""
    _, lists = posting_lists(failures(docs, labels), [*"ABCDE", "good", "toxic"])
    return every_order(cut(lists), list("ABCDE"))
