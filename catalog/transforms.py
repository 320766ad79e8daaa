"""Normalisation and representation (M1-M3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import COUNTS_L, cells_o, counts_l
from histomesh.lineage import cut
from histomesh.operators import normalize as m


@query(
    "m01_log_norm",
    f"""WITH {COUNTS_L} SELECT sample_id, cell_id, gene, n,
        round(ln(1 + n * CAST(10000 AS DOUBLE) / sum(n) OVER (PARTITION BY sample_id, cell_id)), 6) AS x FROM counts_l""",
)
def m01(spark, sf_dir):
    return rounded(m.log_normalize(counts_l(spark, sf_dir), 1e4).select("sample_id", "cell_id", "gene", "n", "x"))


@query(
    "m01_raw",
    f"WITH {COUNTS_L} SELECT sample_id, cell_id, gene, n, CAST(n AS DOUBLE) AS x FROM counts_l",
)
def m01_raw(spark, sf_dir):
    return rounded(m.log_normalize(counts_l(spark, sf_dir), None))


@query(
    "m02_cell_totals",
    f"WITH {COUNTS_L} SELECT sample_id, cell_id, CAST(sum(n) AS BIGINT) AS total FROM counts_l GROUP BY ALL",
)
def m02(spark, sf_dir):
    return rounded(m.cell_totals(counts_l(spark, sf_dir)))


@query("m03_representation")
def m03(spark, sf_dir):
    expression = m.log_normalize(counts_l(spark, sf_dir))
    scores = m.pca_representation(expression, cells_o(spark, sf_dir), k=5)
    return scores.select(
        "sample_id", "cell_id", *[F.round(F.abs(F.col("embedding")[i]), 4).alias(f"pc{i + 1}") for i in range(5)]
    )


@query(
    "m03_component_lengths",
    f"""WITH {COUNTS_L}, x AS (
          SELECT sample_id, cell_id, gene, ln(1 + n * CAST(10000 AS DOUBLE) / sum(n) OVER (PARTITION BY sample_id, cell_id)) AS x FROM counts_l
        ), size AS (SELECT sample_id, count(*) AS members FROM cells_o GROUP BY 1),
        mean AS (SELECT sample_id, gene, sum(x) / any_value(members) AS m FROM x JOIN size USING (sample_id) GROUP BY ALL),
        base AS (SELECT sample_id, sum(m * m) AS m2 FROM mean GROUP BY 1),
        own AS (SELECT sample_id, cell_id, sum(x * x - 2 * x * m) AS part FROM x JOIN mean USING (sample_id, gene) GROUP BY ALL)
        SELECT c.sample_id, c.cell_id, round(coalesce(part, 0) + coalesce(m2, 0), 5) AS length2,
          round(sum(coalesce(part, 0) + coalesce(m2, 0)) OVER () / (count(*) OVER () - 1), 5) AS variance
        FROM cells_o c LEFT JOIN own USING (sample_id, cell_id) LEFT JOIN base USING (sample_id)""",
)
def m03_lengths(spark, sf_dir):
    """All components keep the length of every centred cell, and together the variance of all genes."""
    expression = cut(m.log_normalize(counts_l(spark, sf_dir)))
    panel = expression.select("gene").distinct().count()
    scores = cut(m.pca_representation(expression, cells_o(spark, sf_dir), panel))
    length = F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v * v).alias("length2")
    squared = scores.select("sample_id", "cell_id", length)
    along = [F.var_samp(F.col("embedding")[i]) for i in range(panel)]
    return rounded(squared.withColumn("variance", scores.select(reduce(Column.__add__, along)).scalar()), 5)


@query(
    "m03_expression_itself",
    f"""WITH {COUNTS_L}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS ix FROM (SELECT DISTINCT gene FROM counts_l))
        SELECT c.sample_id, c.cell_id, CAST(coalesce(max(n) FILTER (ix = 1), 0) AS DOUBLE) AS first,
          CAST(coalesce(max(n) FILTER (ix = (SELECT max(ix) FROM g)), 0) AS DOUBLE) AS last,
          CAST(coalesce(sum(n), 0) AS DOUBLE) AS total
        FROM cells_o c LEFT JOIN (SELECT * FROM counts_l JOIN g USING (gene)) x USING (sample_id, cell_id) GROUP BY ALL""",
)
def m03_expression(spark, sf_dir):
    expression = m.log_normalize(counts_l(spark, sf_dir), None)
    vectors = m.cell_representation(cells_o(spark, sf_dir), expression, "X")
    return vectors.select(
        "sample_id",
        "cell_id",
        F.element_at("embedding", 1).alias("first"),
        F.element_at("embedding", -1).alias("last"),
        F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v).alias("total"),
    )
