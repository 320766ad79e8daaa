"""One query per operator over the whole of its table, and SQL twins where SQL can say it."""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.lineage import cut
from histomesh.llm import audit, covertree, imatch, langid, licenses, minhash, mixing, packing, personal, positional, ring, suffix, turns
from histomesh.llm.frames import pick

QUERIES = {}
SQL = {}


#: What Python workers are started with: memory that is freed goes back to the machine.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "8388608"}
BATCH = "8m"


def prepare(spark: SparkSession) -> None:
    """Settings for Python workers that read texts: small batches, and this library on their path.

    Texts are long, so batches are bounded by bytes. The library is found where the driver
    found it, if it isn't installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    environment.update(WORKERS)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def query(function):
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    vectors = cut(vectors.filter(finite).select(F.col("vec_id").cast("long").alias("id"), whole.alias("vector")))
    found = covertree.top_k(vectors.filter(F.col("id") % 100 == 0), vectors, k=10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


SQL["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 10
"""


@query
def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = personal.train(personal.stretches(docs))
    found = personal.find_personal(docs, field)
    counts = [f"n_{kind}" for kind in personal.BASE]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    packed = packing.pack(docs, tokenizer_file(), remembered=400_000, step=8 << 20)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = cut(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sizes, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim FROM w
), o AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source ASC NULLS LAST) AS nth,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER p, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM l WINDOW p AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    coalesce(least(lim, weight * (SELECT arg_min(level, nth) FROM o WHERE level <= lim / weight)), lim) AS target
  FROM o
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS nth,
    coalesce(t.target / nullif(t.source_size, 0), 0) AS e,
    ('0x' || substr(md5('0:' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(nth * e + u) - floor((nth - 1) * e + u)) * size)::BIGINT AS taken
FROM r
"""


@query
def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = ring.ring_shards(cut(docs), F.col("doc_id"), F.col("text_crc32"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = langid.fit(docs.filter(fold != 1))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


@query
def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return audit.audit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL["op11_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), h AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), x AS (SELECT unnest([0, 1, 2, 3, 4]) AS k), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', k + 1, 1)), '') AS filter_order, step::INT AS step, ks[step] AS k,
    coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0)::BIGINT AS before
  FROM o, range(1, 6) r(step)
), p AS (
  SELECT part, filter_order, step, k,
    coalesce(sum(n) FILTER (mask & (before | (1 << k)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & (1 << k) > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & (1 << k) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = 1 << k), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & (1 << k) > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & (1 << k) > 0), 0) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM p
"""


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = positional.contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL["op12_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, range(1, 100000) t(p) WHERE len(w) > 0 AND p <= greatest(len(w) - 9, 1)
), g AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT n FROM q) WHERE p + n - 1 <= len(w)
), m AS (SELECT r, p, n, item_id FROM g JOIN q USING (n, phrase)
), h AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM m) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS name FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


@query
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turns.repaired_digests(turns.damaged(talks), talks)
