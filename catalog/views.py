"""Cohort-shaped views over the given tables, in Spark and as SQL.

The tables hold no tissue data. These views give existing columns the roles the
operators need: orders become cells, nations samples, regions conditions, line
items transcript counts; the vectors of ``embeddings`` give a second cohort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.lineage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells; 25 samples in 5 conditions."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"
    )
    place = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .select("c_custkey", "n_name", "r_name")
    )
    return orders.join(place, F.expr("o_custkey = c_custkey")).select(
        F.col("n_name").alias("sample_id"),
        F.col("o_orderkey").cast("string").alias("cell_id"),
        F.col("r_name").alias("condition"),
        F.col("o_orderpriority").alias("cell_type"),
        F.col("o_orderstatus").alias("compartment"),
        F.expr("((o_orderkey * 7919) % 10007) / 10.0D").alias("x"),
        F.expr("((o_orderkey * 104729) % 10009) / 10.0D").alias("y"),
    )


CELLS_O = """cells_o AS (
  SELECT n_name AS sample_id, CAST(o_orderkey AS VARCHAR) AS cell_id, r_name AS condition,
         o_orderpriority AS cell_type, o_orderstatus AS compartment,
         CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / CAST(10 AS DOUBLE) AS x,
         CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / CAST(10 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey)"""


def cells_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cells; 6 samples in 2 conditions."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("concat('s', vec_id % 6)").alias("sample_id"),
        F.col("vec_id").cast("string").alias("cell_id"),
        F.expr("CASE WHEN vec_id % 6 < 3 THEN 'control' ELSE 'treated' END").alias("condition"),
        F.expr("concat('ct', label % 4)").alias("cell_type"),
        F.expr("concat('d', (vec_id div 7) % 3)").alias("compartment"),
        F.expr("1000.0D * CAST(embedding[0] AS DOUBLE)").alias("x"),
        F.expr("1000.0D * CAST(embedding[1] AS DOUBLE)").alias("y"),
        F.expr("transform(embedding, v -> CAST(v AS DOUBLE))").alias("embedding"),
    )


CELLS_E = """cells_e AS (
  SELECT 's' || CAST(vec_id % 6 AS VARCHAR) AS sample_id, CAST(vec_id AS VARCHAR) AS cell_id,
         CASE WHEN vec_id % 6 < 3 THEN 'control' ELSE 'treated' END AS condition,
         'ct' || CAST(label % 4 AS VARCHAR) AS cell_type,
         'd' || CAST((vec_id // 7) % 3 AS VARCHAR) AS compartment,
         CAST(1000 AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS x,
         CAST(1000 AS DOUBLE) * CAST(embedding[2] AS DOUBLE) AS y,
         embedding
  FROM embeddings)"""


def entries_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw count triplets, repeats included; brands are genes.

    They lie dealt out by cell in parts of bounded size, in which what groups cells goes on.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    cells = cells_o(spark, sf_dir).select("sample_id", "cell_id")
    named = items.join(part, F.expr("l_partkey = p_partkey")).withColumn("cell_id", F.col("l_orderkey").cast("string"))
    return (
        spread(named, items.count(), "cell_id")
        .join(cells, "cell_id")
        .select(
            "sample_id",
            "cell_id",
            F.col("p_brand").alias("gene"),
            F.expr("concat(p_brand, '/', p_size)").alias("sized_gene"),
            F.col("l_partkey").cast("string").alias("part"),
            F.col("l_quantity").cast("bigint").alias("n"),
            "l_discount",
            "l_tax",
        )
    )


ONLY_ENTRIES = """entries_l AS (
  SELECT c.sample_id, c.cell_id, p_brand AS gene, p_brand || '/' || CAST(p_size AS VARCHAR) AS sized_gene,
         CAST(l_partkey AS VARCHAR) AS part, CAST(l_quantity AS BIGINT) AS n, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey
                JOIN cells_o c ON c.cell_id = CAST(l_orderkey AS VARCHAR))"""

ENTRIES_L = f"{CELLS_O}, {ONLY_ENTRIES}"


def counts_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per cell and brand."""
    return (
        entries_l(spark, sf_dir)
        .groupBy("sample_id", "cell_id", "gene")
        .agg(F.sum("n").alias("n"))
    )


COUNTS_L = f"""{ENTRIES_L}, counts_l AS (
  SELECT sample_id, cell_id, gene, CAST(sum(n) AS BIGINT) AS n FROM entries_l GROUP BY ALL)"""


def counts_bs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per cell and brand/size; many genes are absent from some samples."""
    return (
        entries_l(spark, sf_dir)
        .groupBy("sample_id", "cell_id", F.col("sized_gene").alias("gene"))
        .agg(F.sum("n").alias("n"))
    )


COUNTS_BS = f"""{ENTRIES_L}, counts_bs AS (
  SELECT sample_id, cell_id, sized_gene AS gene, CAST(sum(n) AS BIGINT) AS n
  FROM entries_l GROUP BY ALL)"""


def listed_genes(counts: DataFrame) -> DataFrame:
    """The feature table implied by counts."""
    return counts.select("sample_id", "gene").distinct()


def features_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features; the part type is the feature type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("gene"),
        F.expr("CASE WHEN p_size > 10 THEN p_name END").alias("feature_id"),
        F.col("p_type").alias("feature_type"),
    )


FEATURES_P = """features_p AS (
  SELECT CAST(p_partkey AS VARCHAR) AS gene, CASE WHEN p_size > 10 THEN p_name END AS feature_id,
         p_type AS feature_type FROM part)"""


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative annotations: three label levels and centroids per cell."""
    return cells_o(spark, sf_dir).select(
        "sample_id",
        "cell_id",
        "condition",
        F.concat_ws("-", "cell_type", "compartment").alias("cluster_sub"),
        F.col("cell_type").alias("celltype_short"),
        F.concat_ws(" in ", "cell_type", "compartment").alias("celltype_full"),
        F.col("x").alias("centroid_x"),
        F.col("y").alias("centroid_y"),
        "x",
        "y",
    )


CURATED = f"""{CELLS_O}, curated AS (
  SELECT sample_id, cell_id, condition, cell_type || '-' || compartment AS cluster_sub,
         cell_type AS celltype_short, cell_type || ' in ' || compartment AS celltype_full,
         x AS centroid_x, y AS centroid_y, x, y FROM cells_o)"""


def merged_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells as a merge left them: suffixed ids and provisional labels.

    The number of suffixes follows the order status, as if samples had been
    merged one after the other.
    """
    return cells_o(spark, sf_dir).select(
        "sample_id",
        F.expr(
            "concat(cell_id, CASE compartment WHEN 'F' THEN '_1' WHEN 'O' THEN '_1_2' ELSE '_2_1_1' END)"
        ).alias("cell_id"),
        F.lit("unknown").alias("condition"),
        F.lit("none").alias("cluster_sub"),
        (F.col("x") + F.col("y")).alias("quality"),
    )


MERGED_BASE = f"""{CURATED}, merged_base AS (
  SELECT sample_id, cell_id || CASE compartment WHEN 'F' THEN '_1' WHEN 'O' THEN '_1_2' ELSE '_2_1_1' END AS cell_id,
         'unknown' AS condition, 'none' AS cluster_sub, x + y AS quality FROM cells_o)"""


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated cells as another pipeline returned them.

    Urgent orders lost their condition, low-priority ones moved by a millimetre,
    and open orders of medium priority are spelled differently.
    """
    return curated(spark, sf_dir).select(
        "sample_id",
        "cell_id",
        F.expr("CASE WHEN celltype_short = '1-URGENT' THEN '' ELSE condition END").alias("condition"),
        F.expr("CASE WHEN cluster_sub = '3-MEDIUM-O' THEN lower(cluster_sub) ELSE cluster_sub END").alias("cluster_sub"),
        F.expr("CASE WHEN celltype_short = '2-HIGH' THEN NULL ELSE celltype_short END").alias("celltype_short"),
        "celltype_full",
        F.expr("centroid_x + CASE WHEN celltype_short = '5-LOW' THEN 0.001D ELSE 0.0D END").alias("centroid_x"),
        "centroid_y",
        F.expr("CASE WHEN celltype_full = '2-HIGH in P' THEN CAST('NaN' AS DOUBLE) ELSE x END").alias("x"),
        "y",
    )


ONLY_REVISED = """revised AS (
  SELECT sample_id, cell_id, CASE WHEN celltype_short = '1-URGENT' THEN '' ELSE condition END AS condition,
         CASE WHEN cluster_sub = '3-MEDIUM-O' THEN lower(cluster_sub) ELSE cluster_sub END AS cluster_sub,
         CASE WHEN celltype_short = '2-HIGH' THEN NULL ELSE celltype_short END AS celltype_short, celltype_full,
         centroid_x + CASE WHEN celltype_short = '5-LOW' THEN CAST(0.001 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS centroid_x,
         centroid_y, CASE WHEN celltype_full = '2-HIGH in P' THEN CAST('NaN' AS DOUBLE) ELSE x END AS x, y
  FROM curated)"""

REVISED = f"{CURATED}, {ONLY_REVISED}"


def revised_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw triplets with differences: top discounts counted once more, untaxed ones lost."""
    return entries_l(spark, sf_dir).where("l_tax > 0").withColumn(
        "n", F.expr("n + CASE WHEN l_discount = 0.1D THEN 1 ELSE 0 END")
    )


ONLY_REVISED_ENTRIES = """revised_entries AS (
  SELECT sample_id, cell_id, gene, n + CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS n
  FROM entries_l WHERE l_tax > 0)"""

REVISED_ENTRIES = f"{ENTRIES_L}, {ONLY_REVISED_ENTRIES}"


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelings of the vectors for k = 1..6, two runs each, from their labels."""
    variants = {
        (1, 0): "0",
        (1, 1): "0",
        (2, 0): "label % 2",
        (2, 1): "(label + 1) div 3 % 2",
        (3, 0): "label div 4",
        (3, 1): "(label + 1) div 4",
        (4, 0): "label div 3",
        (4, 1): "(label + 2) div 3",
        (5, 0): "label div 2",
        (5, 1): "(label + 1) div 3 + label div 8",
        (6, 0): "label % 6",
        (6, 1): "(label * 3) % 7",
    }
    rows = ", ".join(
        f"named_struct('k', {k}, 'run', {run}, 'label', CAST({rule} AS STRING))"
        for (k, run), rule in variants.items()
    )
    return table(spark, sf_dir, "embeddings").select(
        F.lit("s").alias("sample_id"),
        F.col("vec_id").cast("string").alias("cell_id"),
        F.expr(f"inline(array({rows}))"),
    )


LABEL_RUNS = """label_runs AS (
  SELECT CAST(vec_id AS VARCHAR) AS cell_id, v.k AS k, v.run AS run, CAST(v.label AS VARCHAR) AS label
  FROM (SELECT vec_id, unnest([
    {'k': 1, 'run': 0, 'label': 0}, {'k': 1, 'run': 1, 'label': 0},
    {'k': 2, 'run': 0, 'label': label % 2}, {'k': 2, 'run': 1, 'label': (label + 1) // 3 % 2},
    {'k': 3, 'run': 0, 'label': label // 4}, {'k': 3, 'run': 1, 'label': (label + 1) // 4},
    {'k': 4, 'run': 0, 'label': label // 3}, {'k': 4, 'run': 1, 'label': (label + 2) // 3},
    {'k': 5, 'run': 0, 'label': label // 2}, {'k': 5, 'run': 1, 'label': (label + 1) // 3 + label // 8},
    {'k': 6, 'run': 0, 'label': label % 6}, {'k': 6, 'run': 1, 'label': (label * 3) % 7}]) AS v
  FROM embeddings))"""


# Brute-force twins of the graphs.
PAIRS_O = f"""{CELLS_O}, pairs AS (
  SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst,
         (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2
  FROM cells_o a JOIN cells_o b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id)"""

EDGES_KR = f"""{PAIRS_O}, edges AS (
  SELECT sample_id, src, dst, sqrt(d2) AS dist FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY d2, dst) AS place
    FROM pairs WHERE d2 <= 900) WHERE place <= 6)"""
