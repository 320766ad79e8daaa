"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source size`` times in the mix. The
documents of a source are lined up by size; with one offset drawn for the source, a document
is emitted once for every integer its stretch of the running sum of expectations crosses.
Neighbours in that line have nearly equal sizes, so the words a source gives stay within
about one document of its target.

Running sums are taken per cell of (source, size class, part of the class): a source with a
third of all rows is spread over its cells, and only cell counts meet in one place. Parts are
ranges of the line, between rows of the class picked by hash, so the line is the same however
it is cut. Beyond ``MOST_BOUNDS`` times a quarter of ``CELL_ROWS`` the parts grow instead of their
number, so what is broadcast stays within some megabytes; a row finds its part in two steps, among
every so many bounds and then between two of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.llm.frames import packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 1 << 20
MOST_BOUNDS = 1 << 16


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 without text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of every source: by weight, at most ``most`` times its size, the excess reshared.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, take
    ``weights`` in turn. The fixed point of resharing is one level per unit of weight, found
    from running sums over the sources in the order in which they reach their limit. If the
    limits together hold less than the shared total, every source gets its limit.
    Returns source, source_size, n_docs, weight, target; one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.element_at(wheel, (turn % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.row_number().over(by_limit).alias("nth"),
        (
            (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    holds = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("nth", "level"))
    level = F.min(holds).over(everything)["level"]
    target = F.coalesce(F.least(F.col("limit"), level * F.col("weight")), F.col("limit"))
    return rows.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source and seed, the same in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """The leading four bits of a size with their position: at most 8 classes per doubling."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 4, F.lit(0))
    return shift * 16 + F.call_function("shiftright", size, shift.cast("int"))


def part_of(place: Column, steps: Column) -> Column:
    """How many of the sorted bounds, dealt out in ``steps`` of equal length, are below ``place``."""
    below = F.size(F.filter(steps, lambda step: step[0] < place))
    inside = F.size(F.filter(F.element_at(steps, F.greatest(below, F.lit(1))), lambda x: x < place))
    return F.when(steps.isNull() | (below == 0), 0).otherwise((below - 1) * F.size(F.element_at(steps, 1)) + inside)


def mix(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``docs`` with mix_size, source_size, target and copies (how often the mix takes a row).

    Nulls: a null source is a source of its own, a null key is a key like any other, a null
    size counts 0. Empty documents cost nothing and are taken like their neighbours; a source
    of only empty documents has target 0 and takes nothing. Equal rows stand next to each
    other in the line and are sampled singly. An empty table gives an empty table. Input
    columns of the four result names are replaced. ``cell_rows`` bounds what is lined up in one
    task, but for rows of one size and key that are equal throughout, and in tables so large that
    ``MOST_BOUNDS`` decides; results don't depend on it. The rows are counted once beforehand.
    """
    columns = docs.columns
    size = F.coalesce(size, F.lit(0)).cast("long")
    rows = packed(docs, key=F.col(f"`{key}`"), source=F.col(f"`{source}`"), size=size)
    targets = source_targets(rows.select("source", "size"), weights, share, most).withColumnRenamed("source", "of")
    # null keys come first among structs as they do in the line
    place = F.struct("size", "key", F.xxhash64("row").alias("tie"))
    rows = rows.withColumns({"class": size_class(F.col("size")), "place": place})
    every = max(cell_rows // 4, -(-docs.count() // MOST_BOUNDS), 1)
    picked = rows.filter(F.pmod(F.xxhash64("place"), F.lit(every)) == 0)
    bounds = picked.groupBy(F.col("source").alias("b"), F.col("class").alias("k")).agg(F.sort_array(F.collect_set("place")).alias("bounds"))
    length = F.ceil(F.sqrt(F.size("bounds"))).cast("int")
    firsts = F.sequence(F.lit(1), F.size("bounds"), length)
    bounds = bounds.select("b", "k", F.transform(firsts, lambda first: F.slice("bounds", first, length)).alias("steps"))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["of"]), "left")
    rows = rows.join(F.broadcast(bounds), rows["source"].eqNullSafe(F.col("b")) & (rows["class"] == F.col("k")), "left")
    part = part_of(F.col("place"), F.col("steps"))
    rows = rows.select("row", "key", "source", "size", "source_size", "target", "class", part.alias("part"))
    cells = rows.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    up_to = Window.unboundedPreceding
    classes = classes.select(
        F.col("source").alias("s"),
        F.col("class").alias("c"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(up_to, -1)), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy("source", "class").orderBy("part").rowsBetween(up_to, -1)
    cells = cells.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    cells = cells.join(classes, cells["source"].eqNullSafe(classes["s"]) & (cells["class"] == classes["c"])).select(
        F.col("source").alias("s"), F.col("class").alias("c"), F.col("part").alias("p"), (F.col("base") + F.col("inner")).alias("start")
    )
    line = Window.partitionBy("source", "class", "part").orderBy("size", F.col("key").asc_nulls_first(), F.xxhash64("row"))
    rows = rows.withColumn("nth", F.row_number().over(line))
    at_home = rows["source"].eqNullSafe(cells["s"]) & (rows["class"] == cells["c"]) & (rows["part"] == cells["p"])
    rows = rows.join(cells, at_home)
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    last = F.col("start") + F.col("nth")
    shift = offset(F.col("source"), seed)
    copies = F.floor(last * expected + shift) - F.floor((last - 1) * expected + shift)
    return unpacked(
        rows,
        columns,
        mix_size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        copies=copies.cast("long"),
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
