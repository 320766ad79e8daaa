"""A training-corpus pipeline over ``documents``: five stages, each one an operator of histomesh.llm.

1. language: documents whose language can't be told are rejected, and only those.
2. near_dedup: one document of each near-duplicate group stays (five-word shingles, 80 %).
3. personal: personal data and secrets are replaced by their kind, texts change.
4. mixing: every document is repeated or left out as the target weights of its source say.
5. packing: token sequences of 4096; the last stage, so its columns are its own.

Every stage works on all rows that the one before it kept. Null or clashing columns are the
operators' business; a document without text or letters ends at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.lineage import Scratch, cut
from histomesh.llm import langid, minhash, mixing, packing, personal
from histomesh.llm.frames import pick
from histomesh.llm.queries import prepare, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def few(rows: DataFrame) -> DataFrame:
    """``rows``, kept, and broadcast where they are joined if a count proves them few."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= minhash.BROADCAST_IDS else rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in which every language is about as unlikely."""
    prepare(spark)
    docs = pick(docs, *COLUMNS)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = langid.fit(docs.filter(fold != 1))
    found = langid.identify(docs, net)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, and of repeated rows one.

    Different texts under one id stay together; rows without an id all stay.
    """
    prepare(spark)
    docs = pick(docs, *COLUMNS)
    found = cut(minhash.near_duplicates(docs, width=5).select("doc_id", "kept"))
    gone = found.filter("NOT kept").select("doc_id").distinct()
    kept = docs.join(few(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = cut(found.filter("kept").groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if again.isEmpty():
        return kept
    repeated = kept.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(few(again), "doc_id", "left_anti").union(repeated.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the spans found; n_chars follows the text."""
    prepare(spark)
    docs = pick(docs, *COLUMNS)
    field = personal.train(personal.stretches(docs))
    found = personal.find_personal(docs, field)
    text = F.coalesce("redacted", "text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them.

    Decided on small rows and joined with the texts; if rows are repeated, with the texts at hand.
    """
    docs = pick(docs, *COLUMNS)
    text = F.xxhash64("text")
    sizes = cut(docs.select("doc_id", "source", text.alias("tie"), mixing.word_count(F.col("text")).alias("size")))
    mixed = cut(mixing.mix(sizes, F.col("size")).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    if not mixed.filter("rows > 1").isEmpty():
        return mixing.emitted(mixing.mix(docs, mixing.word_count(F.col("text")))).select(*COLUMNS)
    taken = few(mixed.filter("copies > 0").select(F.col("doc_id").alias("id"), "tie", "copies"))
    once = docs.join(taken, docs["doc_id"].eqNullSafe(taken["id"]) & (text == taken["tie"]))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their token ids."""
    prepare(spark)
    return packing.pack(pick(docs, *COLUMNS), tokenizer_file())


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL: a trained network, sampled signatures, a trained field and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept in the shared folder until the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.keep("stage", stage(spark, docs, sf_dir))
    return docs
