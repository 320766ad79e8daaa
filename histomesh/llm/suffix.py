"""Removing repeated byte strings across documents, by suffix order over shards.

A byte goes if a string of ``length`` bytes around it also starts earlier, in a document with
a smaller id or earlier in the same one. Two strings of that length that are equal contain
equal anchors at the same place: of their ``length - GRAM + 1`` GRAM-byte pieces the first with
the smallest hash. So it is enough to compare snippets, an anchor with all strings whose anchor
it is, between documents that share the anchor; every string lies in one snippet.

1. Copies of a whole text count once, for the first document that has it.
2. Anchors are dealt out by hash. Snippets that are alike from end to end fall to the first
   of them; the others are repeated throughout. Anchors met once are settled.
3. Snippets of an anchor with more than ``CROWD`` surroundings are dealt out again by longer
   pieces around it, halving the places at which a string may begin, until groups are bounded.
4. The first snippets of an anchor that is met in several surroundings are dealt out to
   shards, and each shard's suffixes are sorted by external induced sorting. Where
   neighbours in that order share ``length`` bytes, all but the earliest start are repeats.
5. Repeated stretches are joined with the texts.

Steps 1 to 3 only take away what needs no comparison; no piece of text is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut, scratch_path, small
from histomesh.llm.induced import suffix_order
from histomesh.llm.words import _DOWN, _UP, _VALUE, BACK, BASE, STEP, _powers, mixed, pieces, utf8

GRAM = 32
SHARD = 600_000
CROWD = 4096
BROADCAST_ROWS = 1_000_000
BROADCAST_SNIPPETS = 100_000


def _windows_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, hashes of their snippets, anchor positions and shapes of one text.

    The anchor of a string is the first of its pieces with the smallest upper half of a hash, so
    equal strings have it at the same place. A snippet holds the strings that have this anchor, and
    its shape is ``2 * length`` times the bytes before the anchor plus those from it on.
    """
    n, window = len(data), length - GRAM + 1
    if n < length:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = (_UP, _DOWN) if n <= STEP else (_powers(BASE, n + 1), _powers(BACK, n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    least = _windows_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window)
    owner = (least & low).astype(np.int64)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    at, end = owner[start], np.append(start[1:], len(owner)) - 1 + length
    around = (total[end] - total[start]) * down[start]
    shape = (at - start) * (2 * length) + (end - at)
    return grams[at], mixed(around + mixed(shape.astype(np.uint64) + np.uint64(1))), at, shape


def _settle(h: np.ndarray, c: np.ndarray, own: pa.RecordBatch, counts: np.ndarray, at: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that come later, in this part of the input, than one with the same snippet.

    They are repeats whatever else there is. Their shape is made negative, and they get a hash of
    their own, so that what is met very often isn't dealt out to one place.
    """
    ids, ties = (np.repeat(own.column(k).to_numpy(), counts) for k in range(2))
    order = np.lexsort((at, ties, ids, c, h))
    alike = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    head = np.maximum.accumulate(np.where(np.append(False, alike), 0, np.arange(len(order)))) if len(order) else order
    first = order[head]
    twin = (ids[order] == ids[first]) & (ties[order] == ties[first]) & (at[order] == at[first])
    later = order[~twin]
    h, shapes = h.copy(), shapes.copy()
    h[later] = mixed((ids[later] * 1_000_003 + at[later]).astype(np.uint64)).view(np.int64)
    shapes[later] *= -1
    return h, shapes


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for row, to in pieces(offsets, 2 << 20):
                found = [anchors(data[offsets[r] : offsets[r + 1]], length) for r in range(row, to)]
                counts = np.array([len(f[0]) for f in found])
                own = batch.slice(row, to - row)
                rows = pa.array(np.repeat(np.arange(to - row), counts))
                h, c, at, shapes = (np.concatenate([f[k] for f in found]) for k in range(4))
                h, shapes = _settle(h.view(np.int64), c, own, counts, at, shapes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c.view(np.int64)), own.column(0).take(rows), own.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(shapes.astype(np.int32))],
                    ["h", "c", "id", "tie", "at", "shape"],
                )

    return run


def _sieve(length: int):
    """From anchors in order of (h, c, id, tie, at): repeated stretches and open snippets.

    Works on a stream; of an anchor, only the last first snippet seen is remembered. Rows of
    documents that are there twice follow each other and count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["open", "h", "id", "tie", "start", "end", "at"]

        def out(is_open: bool, columns: list[np.ndarray]) -> pa.RecordBatch:
            h, _, ident, tie, at, shape = columns
            start, end = at - shape // (2 * length), at + shape % (2 * length)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), is_open)), pa.array(h), pa.array(ident), pa.array(tie), pa.array(start), pa.array(end), pa.array(at)], names)

        before, last, waiting, waiting_open = None, None, None, False
        for batch in batches:
            columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(6)]
            if not len(columns[0]):
                continue
            rows = np.stack(columns)
            again = np.append((rows[:, 0] == before).all() if before is not None else False, (rows[:, 1:] == rows[:, :-1]).all(0))
            before = rows[:, -1]
            settled = ~again & (columns[5] < 0)
            if settled.any():
                done = [x[settled] for x in columns]
                yield out(False, [*done[:5], -done[5]])
            columns = [x[~again & ~settled] for x in columns]
            if not len(columns[0]):
                continue
            h, c = columns[:2]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first[0] = last != (h[0], c[0])
            last = (h[-1], c[-1])
            yield out(False, [x[~first] for x in columns])
            heads = [x[first] for x in columns]
            if waiting is not None:
                heads = [np.append(w, x) for w, x in zip(waiting, heads, strict=True)]
            if not len(heads[0]):
                continue
            same = heads[0][1:] == heads[0][:-1]
            contested = np.append(waiting_open, same) | np.append(same, False)
            yield out(True, [x[:-1][contested[:-1]] for x in heads])
            waiting, waiting_open = [x[-1:] for x in heads], bool(contested[-1])
        if waiting is not None and waiting_open:
            yield out(True, waiting)

    return run


def _cut_snippets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            for row in range(batch.num_rows):
                spots = lists[row].values
                starts, ends, h, at = (spots.field(k).to_numpy() for k in ("start", "end", "h", "at"))
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                rows = pa.array(np.full(len(h), row))
                snippets = pa.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at), pa.array(starts), snippets], ["h", "id", "tie", "at", "start", "snippet"])

    return run


def deal_again(snippets: DataFrame, length: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Snippets of crowded anchors as (repeated stretches, open snippets of at most ``crowd`` a group).

    A string of ``length`` bytes around an anchor begins 0 to ``length - GRAM`` bytes before it.
    These places are halved: strings that begin ``low`` to ``high`` bytes before the anchor all
    hold the bytes from ``low`` before it to ``length - high`` behind its start, so equal strings
    meet under those bytes, and what is beyond the ``high`` and ``length - low`` goes. As in the
    sieve, of pieces alike from end to end the first stays and the others are repeats; a group of
    one is settled. With one place left the piece is the whole string, so no group stays crowded.
    """
    settled, bounded = [], []
    items = snippets.select("*", F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"))
    for _ in range((length - GRAM).bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
        end = F.col("start") + F.octet_length("snippet")
        items = items.select("h", "id", "tie", "at", "start", end.alias("end"), "snippet", F.explode(halves).alias("half"))
        items = items.select("*", "half.low", "half.high").filter(f"low <= high AND at - low >= start AND at + {length} - high <= end")
        within = lambda a, b: F.substring(F.col("snippet"), (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))
        begin, until = F.greatest(F.col("at") - F.col("high"), F.col("start")), F.least(F.col("at") + length - F.col("low"), F.col("end"))
        core = within(F.col("at") - F.col("low"), F.col("at") + length - F.col("high"))
        items = cut(
            items.select(
                F.xxhash64("h", "low", core).alias("h"), "id", "tie", "at", begin.alias("start"), within(begin, until).alias("snippet"), "low", "high", (F.col("at") - begin).alias("lead")
            )
        )
        heads = items.groupBy("h", "lead", "snippet").agg(F.min(F.struct("id", "tie", "start", "at", "low", "high")).alias("first"), F.count(F.lit(1)).alias("n"))
        heads = cut(heads)
        again = items.join(small(heads.filter("n > 1"), BROADCAST_SNIPPETS), ["h", "lead", "snippet"])
        again = again.filter("id != first.id OR tie != first.tie OR start != first.start")
        settled.append(again.select("id", "tie", "start", (F.col("start") + F.octet_length("snippet")).alias("end")))
        groups = small(heads.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        heads = cut(heads.join(groups, "h").select("h", "first.id", "first.tie", "first.at", "first.start", "snippet", "first.low", "first.high", "size"))
        bounded.append(heads.filter(F.col("size") <= crowd).select("h", "id", "tie", "start", "snippet"))
        items = heads.filter(F.col("size") > crowd).drop("size")
        if items.isEmpty():
            break
    return reduce(DataFrame.union, settled), reduce(DataFrame.union, bounded)


def repeats(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, snippets: list[bytes], length: int, memory: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(snippet, offset) of all ``length``-byte strings of a shard that start earlier elsewhere."""
    order, common, first = suffix_order(snippets, *([memory] if memory else []))
    alike = np.flatnonzero(common >= length)
    member = np.zeros(len(order), bool)
    member[alike], member[alike - 1] = True, True
    group = np.cumsum(common < length)[member]
    suffix = order[member]
    snippet = np.searchsorted(first, suffix, "right") - 1
    offset = suffix - first[snippet]
    keys = (starts[snippet] + offset, ties[snippet], ids[snippet], group)
    ranked = np.lexsort(keys)
    place = [k[ranked] for k in keys]
    new = np.append(True, place[3][1:] != place[3][:-1]) if len(ranked) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0)) if len(ranked) else ranked
    earliest = (place[0] == place[0][head]) & (place[1] == place[1][head]) & (place[2] == place[2][head]) if len(ranked) else new
    later = ranked[~earliest]
    return snippet[later], offset[later]


def _stretches(snippet: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings as (snippet, start, end) with neighbouring starts joined."""
    ranked = np.lexsort((offset, snippet))
    snippet, offset = snippet[ranked], offset[ranked]
    if not len(snippet):
        return snippet, offset, offset
    new = np.append(True, (snippet[1:] != snippet[:-1]) | (offset[1:] > offset[:-1] + 1))
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(snippet)) - 1
    return snippet[first], offset[first], offset[final] + length


def _sort_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(tables).combine_chunks()
            ids, ties, starts = (table.column(k).to_numpy() for k in ("id", "tie", "start"))
            found = repeats(ids, ties, starts, table.column("snippet").to_pylist(), length)
            snippet, a, b = _stretches(*found, length)
            return pa.RecordBatch.from_arrays([pa.array(ids[snippet]), pa.array(ties[snippet]), pa.array(starts[snippet] + a), pa.array(starts[snippet] + b)], ["id", "tie", "start", "end"])

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                h = batch.column(0).to_numpy()
                if size >= SHARD:  # only a group's end closes a shard
                    until = int(np.searchsorted(h, held[-1].column(0)[-1].as_py(), "right"))
                    if until:
                        held.append(batch.slice(0, until))
                        batch = batch.slice(until)
                    if batch.num_rows:
                        yield settle(held)
                        held, size = [], 0
                    continue
                room = max(1, (SHARD - size) // (2 * length))
                part = batch.slice(0, room)
                held.append(part)
                size += 2 * length * part.num_rows
                batch = batch.slice(part.num_rows)
        if held:
            yield settle(held)

    return run


def _apply():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            lists = batch.column(2)
            removed, spans, kept = [], [], []
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                if not lists[row].is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text.tobytes())
                    continue
                spots = lists[row].values
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, spots.field("start").to_numpy(), 1)
                np.add.at(edge, spots.field("end").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                kept.append(text[~gone].tobytes())
            sums = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sums)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, crowd: int = CROWD) -> DataFrame:
    """Every document without its repeats: key, n_bytes, n_removed, n_spans, kept, kept_sha256.

    Null texts are empty; texts below ``length`` bytes are kept whole. Null ids come first. Rows
    that share id and text count as one document and get the same result; different texts under
    one id stand in the order of their hash. ``kept`` is bytes: a removed stretch may end
    within a character. An empty table gives no rows. ``crowd`` bounds the snippets of one
    anchor in a shard; results don't depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{key}`"), F.lit(-(1 << 63))).cast("long").alias("id"), F.col(f"`{key}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    marks = cut(rows.select("id", digest.alias("digest"), F.xxhash64("text").alias("tie"), (F.octet_length("text") >= length).alias("long")))
    texts = marks.filter("long").groupBy("digest").agg(F.min(F.struct("id", "tie")).alias("first"))
    first = texts.select("first.id", "first.tie").distinct()
    first = cut(first)
    few = first.count() <= BROADCAST_ROWS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    mine = rows.withColumn("tie", F.xxhash64("text"))
    originals = mine.join(near(first), ["id", "tie"], "left_semi").select("id", "tie", "text")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "h long, c long, id long, tie long, at int, shape int"
    found = originals.mapInArrow(_anchor_rows(length), shape)
    ordered = found.repartition(parts, "h").sortWithinPartitions("h", "c", "id", "tie", "at")
    path = scratch_path(spark, "anchors")
    shape = "open boolean, h long, id long, tie long, start long, end long, at long"
    ordered.mapInArrow(_sieve(length), shape).write.partitionBy("open").parquet(path)
    sieved = spark.read.schema(shape).parquet(path)
    repeated = not marks.filter("long").groupBy("id", "tie").count().filter("count > 1").isEmpty()

    def snippets_of(spots: DataFrame) -> DataFrame:
        contested = spots.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "start", "end", "at")).alias("spots"))
        pulled = mine.join(contested, ["id", "tie"]).select("id", "tie", "text", "spots")
        pulled = pulled.dropDuplicates(["id", "tie"]) if repeated else pulled
        return pulled.mapInArrow(_cut_snippets(length), "h long, id long, tie long, at long, start long, snippet binary")

    opened = sieved.filter("open")
    crowded = small(opened.groupBy("h").count().filter(F.col("count") > crowd).select("h"))
    if crowded.isEmpty():
        snippets = snippets_of(opened).select("h", "id", "tie", "start", "snippet")
        alike = sieved.filter("NOT open").select("id", "tie", "start", "end")
    else:
        again, bounded = deal_again(snippets_of(opened.join(crowded, "h", "left_semi")), length, crowd)
        snippets = snippets_of(opened.join(crowded, "h", "left_anti")).select("h", "id", "tie", "start", "snippet").union(bounded)
        alike = sieved.filter("NOT open").select("id", "tie", "start", "end").union(again)
    shards = snippets.repartition(parts, "h").sortWithinPartitions("h")
    sorted_path = scratch_path(spark, "repeats")
    shards.mapInArrow(_sort_shards(length), "id long, tie long, start long, end long").write.parquet(sorted_path)
    stretches = spark.read.schema("id long, tie long, start long, end long").parquet(sorted_path)
    stretches = stretches.union(alike)
    spots = stretches.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spots"))

    copies = marks.filter("long").join(texts, "digest").filter((F.col("id") != F.col("first.id")) | (F.col("tie") != F.col("first.tie")))
    copies = copies.select("id", "tie").distinct()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    gone = copies.select("id", "tie", F.lit(True).alias("copy"))
    joined = mine.join(spots, ["id", "tie"], "left").join(gone, ["id", "tie"], "left")
    joined = joined.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "text", F.when(F.col("copy"), whole).otherwise(F.col("spots")).alias("spots"))
    shape = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return joined.mapInArrow(_apply(), shape).withColumnRenamed("id", key)
