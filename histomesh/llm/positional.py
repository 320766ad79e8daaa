"""Benchmark passages in a corpus by a positional inverted index, in DataFrame operations only.

Texts become words once, in a written table. One pass counts the benchmark's terms in the
corpus. Every window of consecutive item words is led by the two places that hold its rarest
terms; the postings (term, row, position) of such leading terms are the index that is stored.
A posting of the rarest term puts the item on one diagonal of the document (position less
offset in the item); the second term's offset-adjusted list must meet that diagonal. What is
left meets the postings of all the item's terms in the documents concerned, and runs of
neighbouring offsets as long as a window are exact matches. With some slack instead, lists
meet on diagonals close by: proximity matches.

Nothing is gathered by term: lists are rows, and joins are on (row, position), so a word or
passage in a third of all documents is spread like the documents are. The terms of the
benchmark are broadcast only if a count proves them few.

A row is a document. Null texts have no words, and null items take no part; rows with equal or
null ids are told apart by a number of their own. Items without an id still count, and are named by the
empty string. Empty tables give no matches; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import cut, small
from histomesh.llm.frames import pick

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text: Column) -> Column:
    """A-Z lower-cased and words parted by one space; no words for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.trim(F.regexp_replace(lowered, BETWEEN, " "))


def word_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every row of ``df`` once as (row, key, words, n_words), written down."""
    read = pick(df, key, text).toDF("key", "text").select("key", plain_words(F.col("text")).alias("words"))
    n = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).cast("long")
    return cut(read.select(F.monotonically_increasing_id().alias("row"), "key", "words", n.alias("n_words")))


def postings(words: DataFrame) -> DataFrame:
    """(row, pos, term) of every word, positions from 0."""
    return words.filter("n_words > 0").select("row", F.posexplode(F.split("words", " ")).alias("pos", "term"))


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (distinct) stands in the corpus; absent ones give no row."""
    return postings(words).select("term").join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def leaders(listed: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The rarest two places of each window that can occur, each pair once.

    ``listed`` holds (item, pos, term, length) of distinct item texts. Returns (item, term, pos,
    term_2, pos_2, length); the second place is null in windows of one word. A window with a
    term that the corpus lacks can't occur and has no leaders.
    """
    frame = Window.partitionBy("item").orderBy("pos").rowsBetween(0, width - 1)
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "pos")
    seen = listed.join(counts, "term", "left").withColumn("places", F.array_sort(F.collect_list(place).over(frame)))
    whole = F.size("places") == F.least(F.col("length"), F.lit(width))
    first, second = F.get("places", F.lit(0)), F.get("places", F.lit(1))
    return (
        seen.filter(whole & (first["n"] > 0))
        .select("item", first["term"].alias("term"), first["pos"].alias("pos"), second["term"].alias("term_2"), second["pos"].alias("pos_2"), "length")
        .distinct()
    )


def meetings(index: DataFrame, led: DataFrame, slack: int = 0) -> DataFrame:
    """Where both leading terms of a window stand: (row, item, diagonal, off).

    ``off`` is how far the second term's diagonal is from the first's, at most ``slack``.
    """
    led = small(led)
    diagonal = (index["pos"] - led["pos"]).alias("diagonal")
    first = index.join(led, "term").select("row", "item", diagonal, "term_2", "pos_2")
    single = first.filter("term_2 IS NULL").select("row", "item", "diagonal", F.lit(0).alias("off"))
    wanted = first.filter("term_2 IS NOT NULL")
    after = index.select(F.col("row").alias("row_2"), F.col("term").alias("found"), F.col("pos").alias("place"))
    same = (wanted["row"] == after["row_2"]) & (wanted["term_2"] == after["found"])
    if slack == 0:
        both = wanted.join(after, same & (wanted["diagonal"] + wanted["pos_2"] == after["place"])).withColumn("off", F.lit(0))
    else:
        cell = F.floor((F.col("diagonal") + F.col("pos_2")) / (slack + 1))
        wanted = wanted.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        after = after.withColumn("cell_2", F.floor(F.col("place") / (slack + 1)))
        both = wanted.join(after, same & (wanted["cell"] == after["cell_2"]))
        both = both.withColumn("off", F.col("place") - F.col("pos_2") - F.col("diagonal")).filter(F.abs("off") <= slack)
    return both.select("row", "item", "diagonal", "off").union(single)


def confirmed(words: DataFrame, listed: DataFrame, met: DataFrame, width: int) -> DataFrame:
    """Exact matches as maximal runs (row, item, diagonal, pos, length): words of the item in the
    document's order, at least a window long; ``pos`` is the first word's place in the document."""
    asked = met.join(small(listed), "item").select(
        "row", (F.col("diagonal") + F.col("pos")).alias("pos"), "term", "item", "diagonal", F.col("pos").alias("offset"), "length"
    )
    asked = asked.filter("pos >= 0")
    concerned = words.join(small(met.select("row").distinct()), "row", "left_semi")
    held = asked.join(postings(concerned), ["row", "pos", "term"])
    line = Window.partitionBy("row", "item", "diagonal").orderBy("offset")
    runs = held.withColumn("run", F.col("offset") - F.row_number().over(line))
    return (
        runs.groupBy("row", "item", "diagonal", "run", "length")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.least(F.col("length"), F.lit(width)))
        .select("row", "item", "diagonal", "pos", F.col("n").alias("length"))
    )


def indexed(docs: DataFrame, items: DataFrame, width: int, doc_key: str, item_key: str, text: str):
    """Words of both tables, the distinct item texts' places, their leaders and the stored index."""
    words = word_table(docs, doc_key, text)
    asked = word_table(items, item_key, text).filter("n_words > 0")
    distinct = asked.groupBy("words").agg(F.min("row").alias("item"), F.max("n_words").alias("length"))
    ids = cut(asked.join(distinct.drop("length"), "words").select("item", "key").distinct())
    listed = cut(distinct.select("item", F.posexplode(F.split("words", " ")).alias("pos", "term"), "length"))
    counts = term_counts(words, listed.select("term").distinct())
    led = cut(leaders(listed, counts, width))
    terms = led.select("term").union(led.select("term_2").filter("term_2 IS NOT NULL")).distinct()
    index = cut(postings(words).join(small(terms), "term").select("term", "row", "pos"))
    return words, ids, listed, led, index


def exact_matches(docs: DataFrame, items: DataFrame, width: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text"):
    """``(words, ids, matches)``: document words, ids of item texts, and maximal runs of exact matches.

    A window is ``width`` consecutive item words, or all words of a shorter item.
    """
    words, ids, listed, led, index = indexed(docs, items, width, doc_key, item_key, text)
    met = cut(meetings(index, led).select("row", "item", "diagonal").distinct())
    return words, ids, cut(confirmed(words, listed, met, width))


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slack: int = 3, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Where the two rarest terms of a window stand within ``slack`` words of their distance in it.

    Returns row, the ids of document and item, ``pos`` (where the item's first word would be) and
    ``off`` (words by which the distance is too long), each once. Windows of one word match exactly.
    """
    words, ids, _, led, index = indexed(docs, items, width, doc_key, item_key, text)
    met = meetings(index, led, slack).distinct()
    named = met.join(ids.withColumnRenamed("key", item_key), "item").join(words.select("row", F.col("key").alias(doc_key)), "row")
    return named.select("row", doc_key, item_key, F.col("diagonal").alias("pos"), "off")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Every document with its words, those inside matches, and the items matched.

    Returns the document's key, n_words, n_hit, n_items, items (ids as text, sorted), contaminated.
    """
    words, ids, matches = exact_matches(docs, items, width, doc_key, item_key, text)
    places = matches.select("row", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("place"))
    hit = places.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.select("row", "item").distinct().join(ids, "item")
    named = named.select("row", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name")).distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("name")).alias("items"))
    found = words.drop("words").join(hit.join(named, "row"), "row", "left")
    none = F.array().cast("array<string>")
    return found.select(
        F.col("key").alias(doc_key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
