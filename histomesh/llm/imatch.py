"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame operations only.

A term is a run of letters and digits in lower case, identified by its 64-bit hash. The
lexicon keeps terms whose document frequency lies inside a band of inverse document
frequency. Its size is bounded by (mean distinct terms of a document) / (lowest share of
documents), however many documents there are.

A lexicon subset is one slice of one of three random partitions of the lexicon: all 32 slices
of the coarse one, 64 of 256 and 64 of 2048 slices of the finer ones, so that short and long
documents both find slices holding a few of their terms. For every subset a document has
terms of, its distinct terms are sorted and hashed with the subset's number. The fingerprint
is the sorted list of these hashes; two fingerprints are as alike as the share of subsets, of
those that either has terms in, on which they agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import cut

#: (slices of the partition, slices used)
PARTITIONS = ((32, 32), (256, 64), (2048, 64))
BROADCAST_TERMS = 2_000_000
SPAN = 1024


def terms(text: Column) -> Column:
    """Distinct terms of a text, and the empty term, which is in every text."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def lexicon(texts: DataFrame, column: str, low: float = 0.001, high: float = 0.05) -> DataFrame:
    """Ids of the terms that ``low`` to ``high`` of all texts hold: column ``term``.

    Every text counts, copies too. The bounds are shares of documents, that is, the band of
    inverse document frequency from -log(high) to -log(low).
    """
    held = texts.select(F.explode(terms(F.col(column))).alias("t")).filter("t <> ''").select(F.xxhash64("t").alias("term"))
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total), (F.col("n") >= low * F.col("total")) & (F.col("n") <= high * F.col("total"))).select("term")


def slots(term: Column) -> Column:
    """Numbers of the subsets that hold a term."""
    parts, first = [], 0
    for k, (slices, used) in enumerate(PARTITIONS):
        place = F.pmod(F.xxhash64(term, F.lit(k)), F.lit(slices))
        parts.append(F.when(place < used, place + first))
        first += used
    return F.array_compact(F.array(*parts))


def fingerprints(rows: DataFrame, texts: dict[str, str], facts: Column, words: DataFrame, home: str, nth: str) -> DataFrame:
    """Fingerprint arrays of several text columns of every row.

    ``rows`` is dealt out by ``home``, and ``home`` with ``nth`` names a row; ``texts`` gives the
    result column for each text column. Rows stay where they are: only ``words`` travels, and
    ``facts`` goes along in one entry of the row. A text without lexicon terms has the one hash
    of all its terms, marked by slot -1; a text without terms that of no terms.
    Returns home, nth, facts and the result columns.
    """
    names = list(texts)
    entries = [F.struct(F.lit(k).alias("v"), F.col(name).alias("text"), F.lit(None).cast("string").alias("facts")) for k, name in enumerate(names)]
    entries.append(F.struct(F.lit(len(names)).alias("v"), F.lit("").alias("text"), facts.alias("facts")))
    spread = rows.select(home, nth, F.explode(F.array(*entries)).alias("e"))
    found = terms(F.col("e.text"))
    whole = F.xxhash64(F.lit(-1).cast("long"), F.array_sort(found))  # once a text: before the terms are spread
    spread = spread.select(home, nth, "e.v", "e.facts", found.alias("found"), whole.alias("whole"))
    spread = spread.select(home, nth, "v", "facts", "whole", F.explode("found").alias("t"))
    spread = spread.withColumn("term", F.when(F.col("t") != "", F.xxhash64("t")).otherwise(F.lit(0).cast("long")))
    known = cut(words.select("term").union(words.sparkSession.sql("SELECT 0L AS term")).distinct())
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    spread = spread.join(known, "term")
    slot = F.explode(F.when(F.col("term") == 0, F.array(F.lit(-1).cast("long"))).otherwise(slots(F.col("term"))))
    spread = spread.select(home, nth, "v", "facts", "whole", "term", slot.alias("slot"))
    keys = [home, nth, "v"]
    sets = spread.groupBy(*keys, "slot").agg(F.max("whole").alias("whole"), F.max("facts").alias("facts"), F.array_sort(F.collect_list("term")).alias("set"))
    sets = sets.select(*keys, "whole", "facts", F.when(F.col("slot") >= 0, F.struct("slot", F.xxhash64("slot", "set").alias("h"))).alias("e"))
    prints = sets.groupBy(home, nth).agg(
        F.max("facts").alias("facts"),
        *[F.collect_list(F.when(F.col("v") == k, F.col("e"))).alias(f"p{k}") for k in range(len(names))],
        *[F.max(F.when(F.col("v") == k, F.col("whole"))).alias(f"w{k}") for k in range(len(names))],
    )
    picked = []
    for k, name in enumerate(names):
        alone = F.array(F.struct(F.lit(-1).cast("long").alias("slot"), F.col(f"w{k}").alias("h")))
        picked.append(F.when(F.size(f"p{k}") > 0, F.array_sort(f"p{k}")).otherwise(alone).alias(texts[name]))
    return prints.select(home, nth, "facts", *picked)


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets, of those that either fingerprint has, with equal hashes: 0 to 1."""
    slots_of = lambda x: F.transform(x, lambda e: e["slot"])
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(slots_of(a), slots_of(b)))
    return shared.cast("double") / either


def shown(a: Column) -> Column:
    """A fingerprint as text: slot:hash in order."""
    return F.array_join(F.transform(a, lambda e: F.concat_ws(":", e["slot"].cast("string"), F.lower(F.hex(e["h"])))), ",")


def successors(keys: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the next larger one (``after``, null for the largest).

    Keys are dealt out by range and kept, so only one key of each part meets the others.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.select(F.col(key).alias("key")).distinct().repartitionByRange(parts, "key")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("key").alias("head"))
    heads = heads.withColumn("next_head", F.lead("head").over(Window.orderBy("part"))).select("part", "next_head")
    within = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("within", within).join(F.broadcast(heads), "part").select("key", F.coalesce("within", "next_head").alias("after"))


def with_next(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """Rows (home, nth, key, text, carried) in which the next document stands behind each one.

    Documents are dealt out by stretches of ``span`` keys. The first document of a stretch
    is carried, as a marked copy, behind the last of the stretch before; the very first goes
    behind the very last. ``nth`` orders a stretch: nulls first, equal keys by their text.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    home = F.coalesce(F.floor(F.col("key") / span), F.lit(-(1 << 62))).cast("long")
    rows = rows.select(home.alias("home"), "key", F.xxhash64("text").alias("tie"), "text")
    order = F.struct(F.coalesce(F.col("key"), F.lit(-(1 << 63))).alias("k"), F.col("tie").alias("t"))
    heads = cut(rows.groupBy("home").agg(F.min(order).alias("head")))
    ways = heads.join(successors(heads, "home"), heads["home"] == F.col("key")).select(F.col("after"), heads["home"].alias("to"))
    edge = heads.agg(F.min("home").alias("first"), F.max("home").alias("last"))
    back = heads.join(ways, heads["home"] == ways["after"], "left").join(F.broadcast(edge)).select(
        heads["home"].alias("from"),
        "head",
        F.coalesce("to", F.when(F.col("home") == F.col("first"), F.col("last"))).alias("to"),
        (F.col("home") == F.col("first")).alias("wraps"),
    )
    back = cut(back)
    if back.count() <= 100_000:
        back = F.broadcast(back)
    placed = rows.join(back, rows["home"] == F.col("from"), "left")
    own = F.struct(F.col("home"), F.lit(0).alias("late"))
    copy = F.when(order == F.col("head"), F.struct(F.col("to").alias("home"), F.lit(1).alias("late")))
    placed = placed.select("key", "tie", "text", F.explode(F.array_compact(F.array(own, copy))).alias("at"))
    return placed.select(F.col("at.home").alias("home"), "key", "tie", "text", (F.col("at.late") == 1).alias("carried"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = 0.001, high: float = 0.05) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness to each other.

    The edited text has its last half replaced by as many first characters of the next
    document by ``key`` (all, if it has fewer); the last document is followed by the first, a
    single one by itself. Null texts are empty, null keys come first, rows with equal keys
    follow each other by the hash of their text. An empty table gives an empty table.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = cut(lexicon(docs, "text", low, high))
    rows = with_next(docs, "key", "text").repartition("home")
    line = Window.partitionBy("home").orderBy(F.col("carried"), F.col("key").asc_nulls_first(), "tie")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select(
        "home",
        F.row_number().over(line).alias("nth"),
        "key",
        "carried",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.when(
            ~F.col("carried"),
            F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(line), F.lit(1), half)),
        ).alias("edited"),
    )
    facts = F.concat_ws(":", F.col("carried").cast("string"), F.col("n_chars").cast("string"), F.sha2("edited", 256), F.col("key").cast("string"))
    prints = fingerprints(rows, {"text": "print", "edited": "edited_print"}, facts, words, "home", "nth")
    follow = F.lead("print").over(Window.partitionBy("home").orderBy("nth"))
    fact = F.split("facts", ":", 4)
    prints = prints.withColumn("next_print", follow).filter(fact[0] == "false")
    return prints.select(
        F.try_element_at(fact, F.lit(4)).cast(docs.schema["key"].dataType).alias(key),
        fact[1].cast("long").alias("n_chars"),
        fact[2].alias("edited_sha256"),
        shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
