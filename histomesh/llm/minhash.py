"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact check.

1. Every text gets its shingle set, a digest of the set and a MinHash signature in one pass.
   Documents with equal sets are one class; only the class's smallest id goes on.
2. Signatures are cut into bands; classes that share a band are candidates. First every class
   meets the most central class of its buckets, the one that shares most bands with others, and
   verified links are joined to components: around what many copies were made from, all at once.
   Then only buckets that still hold several components are looked at, and there only pairs
   from different components, each in the first band it shares: in blocks of bounded size,
   compared inside the tasks, which give out members and links but never the pairs.
3. A candidate is compared signature batch by signature batch. With a uniform prior, n hashes
   of which m agree leave the similarity a posterior probability of being at the threshold
   or above; a pair is dropped as soon as that falls below the chosen miss probability.
4. Survivors are confirmed on the full shingle sets of the whole texts.

Pairs inside one component need no comparison, since they change nothing; a class of copies
is never expanded. No bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import Scratch
from histomesh.llm.components import components
from histomesh.llm.words import pieces, shingle_sets, utf8

BANDS, ROWS, BATCH = 28, 4, 16
HASHES = BANDS * ROWS
BLOCK, LARGE = 256, 64
BROADCAST_IDS = 2_000_000

_random = np.random.default_rng(20)
_MULTIPLY = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, one row of 32-bit numbers for every set that is not empty."""
    lengths = np.diff(at)
    starts = at[:-1][lengths > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    step = 1 << 15
    row = 0
    while row < len(starts):
        to = max(int(np.searchsorted(starts, starts[row] + step, "right")) - 1, row + 1)
        end = starts[to] if to < len(starts) else len(sets)
        own, cuts = sets[starts[row] : end], starts[row:to] - starts[row]
        for j in range(HASHES):
            values = ((own * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)
            out[row:to, j] = np.minimum.reduceat(values, cuts)
        row = to
    return out


def least_matches(threshold: float, miss: float) -> list[int]:
    """For 16, 32, … compared hashes: how many must agree for a pair to go on.

    After m of n agree, P(similarity >= t) is the chance of at most m successes in n + 1
    trials of probability t (uniform prior).
    """
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def likely(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions of the pairs (a[i], b[j]) that survive every batch."""
    alive, agreed = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, need in enumerate(least):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (a[i[alive], batch] == b[j[alive], batch]).sum(1)
        kept = agreed >= need
        alive, agreed = alive[kept], agreed[kept]
    return alive


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for row, to in pieces(offsets):
                cut_ = offsets[row : to + 1] - offsets[row]
                sets, at = shingle_sets(data[offsets[row] : offsets[to]], cut_, width)
                full = signatures(sets, at)
                sizes = np.diff(at)
                place = np.cumsum(sizes > 0) - 1
                digests = [hashlib.blake2b(sets[at[r] : at[r + 1]].tobytes(), digest_size=16).digest() if sizes[r] else None for r in range(to - row)]
                marks = [full[place[r]].tobytes() if sizes[r] else None for r in range(to - row)]
                ids = batch.column(0).slice(row, to - row)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], ["id", "n", "digest", "mark"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint32).reshape(len(column), HASHES)


def _prune_pairs(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.arange(batch.num_rows)
                kept = likely(_matrix(batch.column(2)), _matrix(batch.column(3)), rows, rows, least)
                yield batch.select([0, 1]).take(pa.array(kept))

    return run


def first_shared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs (a[i], b[j]) share no band before ``band``: those that meet here first."""
    first = np.ones(len(i), bool)
    for k in range(band):
        rows = slice(k * ROWS, (k + 1) * ROWS)
        left = np.flatnonzero(first)
        first[left] = (a[i[left], rows] != b[j[left], rows]).any(1)
    return first


def across(one: tuple, two: tuple, same: bool, band: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between (ids, components, signatures) of two blocks worth an exact look."""
    i, j = (x.ravel() for x in np.indices((len(one[0]), len(two[0]))))
    other = one[1][i] != two[1][j]
    if same:
        other &= one[0][i] < two[0][j]
    i, j = i[other], j[other]
    kept = likely(one[2], two[2], i, j, least)
    i, j = i[kept], j[kept]
    first = first_shared(one[2], two[2], i, j, band)
    return i[first], j[first]


def _active(least: list[int]):
    """Members of two blocks (or one) that have a likely partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            sides = []
            for k in (6, 7):
                lists = batch.column(k)
                flat = lists.flatten()
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                sides.append((ends, flat.field("rep").to_numpy(), flat.field("component").to_numpy(), _matrix(flat.field("mark"))))
            keys = [batch.column(k).to_numpy() for k in range(6)]
            for row in range(batch.num_rows):
                same = keys[1][row] == keys[3][row] and keys[2][row] == keys[4][row]
                cut_ = [tuple(x[s[0][row] : s[0][row + 1]] for x in s[1:]) for s in sides]
                for side, places in enumerate(across(*cut_, same, int(keys[5][row]), least)):
                    for place in np.unique(places):
                        at.append(row)
                        parts.append((side, cut_[side][0][place], cut_[side][1][place]))
            columns = [pa.array(key[at] if at else key[:0]) for key in keys]
            columns += [pa.array([p[k] for p in parts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["band", "g1", "b1", "g2", "b2", "nr", "side", "rep", "component"])

    return run


def _link_blocks(width: int, percent: int, least: list[int]):
    """Exactly verified links between components, as many as join what can be joined.

    Inside a task a verified link joins two components, and pairs inside one are skipped; so
    no more links leave than there are members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                members = batch.column(3)[row].values
                data, offsets = utf8(members.field("text"))
                sets, at = shingle_sets(data, offsets, width)
                side, rep, component = (members.field(x).to_numpy() for x in ("side", "rep", "component"))
                marks = signatures(sets, at)
                two = side == 1
                same = bool(batch.column(1)[row].as_py())
                here = [(rep[x], component[x], marks[x]) for x in (~two, two)]
                places = [np.flatnonzero(~two), np.flatnonzero(two)]
                i, j = across(*here, same, batch.column(2)[row].as_py(), least)
                agreed = (here[0][2][i] == here[1][2][j]).sum(1)
                joined: dict[int, int] = {}

                def root(x: int, joined=joined) -> int:
                    while x in joined:
                        x = joined[x]
                    return x

                for k in np.argsort(-agreed, kind="stable"):
                    a, b = places[0][i[k]], places[1][j[k]]
                    x, y = root(int(component[a])), root(int(component[b]))
                    if x == y:
                        continue
                    m, n = sets[at[a] : at[a + 1]], sets[at[b] : at[b + 1]]
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    if both and 100 * both >= percent * (len(m) + len(n) - both):
                        joined[max(x, y)] = min(x, y)
                        links.append((rep[a], rep[b]))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            sides = [utf8(batch.column(k)) for k in (2, 3)]
            for row in range(batch.num_rows):
                a, b = (shingle_sets(data[at[row] : at[row + 1]], np.array([0, at[row + 1] - at[row]]), width)[0] for data, at in sides)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    kept.append(row)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def texts_of(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The (id, text) rows of the ``wanted`` ids, which are broadcast if they are few."""
    ids = scratch.keep("wanted", ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["id"] == ids["wanted"]).select("id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are alike enough, kept in the shared folder."""
    pairs = scratch.keep("pairs", pairs.repartition("a"))
    texts = texts_of(docs, pairs.select("a").union(pairs.select("b")).distinct().toDF("wanted"), scratch)
    one = texts.toDF("a", "text_a")
    two = texts.toDF("b", "text_b")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    links = scratch.keep("stars", both.mapInArrow(_confirm(width, percent), "a long, b long").distinct())
    scratch.drop("pairs", "wanted")
    return links


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, miss: float = 1e-5
) -> DataFrame:
    """Component of every document under links of ``percent`` per cent shingle overlap.

    Words are runs without ASCII white space, A-Z as a-z; shingles are ``width`` words. A text
    with fewer words is one shingle; one without words, or null, is empty and linked with
    nothing. Two documents link if 100 * shared >= percent * all shingles. A pair at the very
    threshold shares no band with a chance of 4e-7 and is pruned with one of about ``miss``.
    Rows with equal ids count as one document in links. A null id has a null component, is kept and
    links with nothing. An empty table gives an empty table.
    Returns key, n_shingles, component_id, kept; one row per input row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    scratch = Scratch(spark)
    sketches = scratch.keep("sketches", docs.mapInArrow(_sketch(width), "id long, n long, digest binary, mark binary"))
    classes = sketches.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.first("mark").alias("mark"))
    classes = scratch.keep("classes", classes)
    marks = classes.select("rep", "mark")
    least = least_matches(percent / 100, miss)

    band = F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("mark", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)]))
    bands = classes.select("rep", band.alias("nr", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = scratch.keep("buckets", bands.join(shared, "band"))
    degrees = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degrees, "rep").select("band", "rep", F.struct("degree", (-F.col("rep")).alias("back")).alias("weight"))
    pivots = ranked.groupBy("band").agg(F.max("weight").alias("pivot"))
    stars = ranked.join(pivots, "band").groupBy("rep").agg(F.max("pivot").alias("pivot"))
    stars = stars.select(F.col("rep").alias("a"), (-F.col("pivot.back")).alias("b")).filter("a <> b")

    def with_marks(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(marks.toDF("a", "mark_a"), "a").join(marks.toDF("b", "mark_b"), "b")
        return pairs.select("a", "b", "mark_a", "mark_b").mapInArrow(_prune_pairs(least), "a long, b long")

    links = confirmed(with_marks(stars), docs, width, percent, scratch)
    found = components(links, scratch, "first")

    members = buckets.join(found, F.col("rep") == F.col("node"), "left").select("band", "nr", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    members = scratch.keep("members", members.join(mixed, "band"))
    scratch.drop("buckets", "first")
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("group", F.when(F.col("n") >= LARGE, F.col("component")).otherwise(F.lit(-1)))
    groups = sizes.groupBy("band", "group").agg(F.sum("n").alias("total"))
    sizes = sizes.join(groups, ["band", "group"]).select("band", "component", "group", F.ceil(F.col("total") / BLOCK).alias("blocks"))
    placed = members.join(sizes, ["band", "component"]).join(marks, "rep")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")))
    member = F.struct("rep", "component", "mark")
    blocks = scratch.keep("blocks", placed.groupBy("band", "nr", "group", "block").agg(F.collect_list(member).alias("members")))
    scratch.drop("members")
    one = blocks.select("band", "nr", F.col("group").alias("g1"), F.col("block").alias("b1"), F.col("members").alias("m1"))
    two = blocks.select("band", "nr", F.col("group").alias("g2"), F.col("block").alias("b2"), F.col("members").alias("m2"))
    later = (F.col("g1") < F.col("g2")) | ((F.col("g1") == F.col("g2")) & (F.col("g1") == -1) & (F.col("b1") <= F.col("b2")))
    keys = ["band", "g1", "b1", "g2", "b2", "nr"]
    met = one.join(two, ["band", "nr"]).filter(later).select(*[F.col(k).cast("long") for k in keys], "m1", "m2")
    shape = ", ".join(f"{k} long" for k in [*keys, "side", "rep", "component"])
    active = scratch.keep("active", met.mapInArrow(_active(least), shape))
    scratch.drop("blocks")
    texts = texts_of(docs, active.select(F.col("rep").alias("wanted")).distinct(), scratch)
    member = F.struct("side", "rep", "component", "text")
    groups = active.join(texts, F.col("rep") == F.col("id")).groupBy(*keys).agg(F.collect_list(member).alias("members"))
    same = (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2"))
    groups = groups.select("band", same.alias("same"), "nr", "members")
    more = scratch.keep("more", groups.mapInArrow(_link_blocks(width, percent, least), "a long, b long").distinct())
    scratch.drop("active", "wanted")
    found = components(links.union(more), scratch, "all")
    scratch.drop("stars", "more")

    homes = classes.join(found, F.col("rep") == F.col("node"), "left")
    homes = homes.select(F.col("digest").alias("of"), F.coalesce("component", "rep").alias("component"))
    result = sketches.join(homes, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept")
    )
