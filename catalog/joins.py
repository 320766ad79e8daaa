"""Alignment, curation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import (
    CELLS_O, COUNTS_BS, COUNTS_L, CURATED, ENTRIES_L, MERGED_BASE, cells_o, counts_bs, counts_l, curated,
    entries_l, listed_genes, merged_base, table,
)
from histomesh.functions.ids import without_merge_suffix
from histomesh.operators import align as a
from histomesh.operators.labels import label_difference
from histomesh.operators.parity import identity_diff


@query(
    "j01_align",
    f"""WITH {COUNTS_L} SELECT m.sample_id, m.cell_id, t.total, m.cell_type, m.condition
        FROM (SELECT sample_id, cell_id, CAST(sum(n) AS BIGINT) AS total FROM counts_l GROUP BY ALL) t
        JOIN cells_o m USING (sample_id, cell_id)""",
)
def j01(spark, sf_dir):
    matrix = counts_l(spark, sf_dir).groupBy("sample_id", "cell_id").agg(F.sum("n").alias("total"))
    metadata = cells_o(spark, sf_dir).select("sample_id", "cell_id", "cell_type", "condition")
    return rounded(a.align(matrix, metadata))


@query(
    "j01_missing",
    f"""WITH {COUNTS_L} SELECT sample_id, cell_id FROM cells_o EXCEPT SELECT sample_id, cell_id FROM counts_l""",
)
def j01_missing(spark, sf_dir):
    return a.unmatched(cells_o(spark, sf_dir), counts_l(spark, sf_dir))


@query(
    "j02_annotations",
    f"""WITH {CELLS_O} SELECT c.sample_id, c.cell_id, c.cell_type, round(o_totalprice, 6) AS price
        FROM cells_o c JOIN orders ON CAST(o_orderkey AS VARCHAR) = c.cell_id""",
)
def j02(spark, sf_dir):
    annotations = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("cell_id"), F.col("o_totalprice").alias("price")
    )
    cells = cells_o(spark, sf_dir).select("sample_id", "cell_id", "cell_type")
    return rounded(a.attach_annotations(cells, annotations, ["cell_id"]))


@query(
    "j03_cohort_genes",
    f"""WITH {COUNTS_BS}, shared AS (SELECT gene FROM counts_bs GROUP BY gene
          HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM counts_bs))
        SELECT sample_id, cell_id, gene, n FROM counts_bs WHERE gene IN (SELECT gene FROM shared)""",
)
def j03(spark, sf_dir):
    counts = counts_bs(spark, sf_dir)
    return rounded(a.cohort_genes(counts, listed_genes(counts), "inner").select("sample_id", "cell_id", "gene", "n"))


@query(
    "j03_cohort_genes_outer",
    f"""WITH {COUNTS_BS} SELECT sample_id, count(*) AS stored, count(DISTINCT gene) AS genes_present,
        (SELECT count(DISTINCT gene) FROM counts_bs) AS genes_in_cohort FROM counts_bs GROUP BY sample_id""",
)
def j03_outer(spark, sf_dir):
    counts = counts_bs(spark, sf_dir)
    features = listed_genes(counts)
    kept = a.cohort_genes(counts, features, "outer")
    axis = a.genes_in_any(features).select(F.count(F.lit(1))).scalar()
    return rounded(
        kept.groupBy("sample_id").agg(
            F.count(F.lit(1)).alias("stored"), F.count_distinct("gene").alias("genes_present")
        ).withColumn("genes_in_cohort", axis)
    )


@query(
    "j03_feature_columns",
    """SELECT p_brand AS gene, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS kind,
       CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand FROM part GROUP BY p_brand""",
)
def j03_features(spark, sf_dir):
    features = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("sample_id"),
        F.col("p_brand").alias("gene"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("brand"),
    )
    return a.agreeing_feature_columns(features, ["kind", "brand"])




@query(
    "j04_bijection",
    f"""WITH {ENTRIES_L}, l AS (SELECT sample_id, cell_id, count(*) AS n FROM cells_o GROUP BY ALL),
      r AS (SELECT sample_id, cell_id, count(*) AS n FROM entries_l WHERE l_tax > 0 GROUP BY ALL),
      j AS (SELECT coalesce(l.n, 0) AS a, coalesce(r.n, 0) AS b FROM l FULL JOIN r USING (sample_id, cell_id))
    SELECT CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right,
           CAST(coalesce(sum(a) FILTER (b = 0), 0) AS BIGINT) AS unmatched_left,
           CAST(coalesce(sum(b) FILTER (a = 0), 0) AS BIGINT) AS unmatched_right,
           count(*) FILTER (a > 1) AS repeated_left, count(*) FILTER (b > 1) AS repeated_right,
           (count(*) FILTER (a <> 1 OR b <> 1)) = 0 AS bijection FROM j""",
)
def j04(spark, sf_dir):
    return rounded(a.bijection_report(cells_o(spark, sf_dir), entries_l(spark, sf_dir).where("l_tax > 0")))


@query(
    "j05_recovery",
    f"""WITH {MERGED_BASE}, s AS (SELECT *, regexp_replace(cell_id, '(_[0-9]+)+$', '') AS stripped FROM merged_base)
    SELECT false AS exact, (SELECT count(*) FROM merged_base) AS unmatched_left, (SELECT count(*) FROM curated) AS unmatched_right,
           (SELECT count(*) FROM s JOIN curated c ON c.sample_id = s.sample_id AND c.cell_id = s.stripped) = (SELECT count(*) FROM s)
             AS after_recovery,
           count(*) FILTER (stripped <> cell_id) AS ids_changed,
           max(len(string_split(regexp_extract(cell_id, '(_[0-9]+)+$'), '_')) - 1) AS max_depth FROM s""",
)
def j05(spark, sf_dir):
    return rounded(a.recovery_report(merged_base(spark, sf_dir), curated(spark, sf_dir)))


@query(
    "j05_recovered_ids",
    f"WITH {CURATED} SELECT sample_id, cell_id FROM curated",
)
def j05_ids(spark, sf_dir):
    fixed = a.recover_ids(merged_base(spark, sf_dir), curated(spark, sf_dir), allow=True)
    return fixed.select("sample_id", "cell_id")


@query(
    "j06_patch",
    f"""WITH {CURATED} SELECT sample_id, cell_id, condition, cluster_sub, celltype_short, celltype_full,
        round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, round(x + y, 6) AS quality FROM curated""",
)
def j06(spark, sf_dir):
    base = merged_base(spark, sf_dir).withColumn("cell_id", without_merge_suffix("cell_id"))
    return rounded(a.patch_annotations(base, curated(spark, sf_dir)))


@query(
    "j09_coordinate_fallback",
    f"""WITH {CELLS_O} SELECT sample_id, cell_id, x + 1 AS x, y + 1 AS y FROM cells_o""",
)
def j09(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    bare = cells.select("sample_id", "cell_id", F.col("cell_id").alias("cell_name"))
    incomplete = entries_l(spark, sf_dir).groupBy("sample_id", "cell_id").agg(
        F.avg("n").alias("x_centroid"), F.max("n").alias("y_centroid")
    )
    infinite = cells.select(
        "sample_id", "cell_id", "x", F.expr("y / nullif(CASE WHEN compartment = 'P' THEN 0 ELSE 1 END, 0)").alias("y")
    )
    complete = cells.select(
        "sample_id", "cell_id", (F.col("x") + 1).alias("imagecol"), (F.col("y") + 1).alias("imagerow")
    )
    placed = a.first_complete_coordinates(bare, [incomplete, infinite, complete])
    return placed.select("sample_id", "cell_id", "x", "y")


@query(
    "j10_identity",
    f"""WITH {COUNTS_L}, n AS (SELECT sample_id, cell_id, count(*) AS n FROM cells_o GROUP BY ALL),
      r AS (SELECT sample_id, cell_id, count(*) AS m FROM counts_l WHERE gene < 'Brand#3' GROUP BY ALL),
      j AS (SELECT sample_id || ':' || cell_id AS name, n, m FROM n FULL JOIN r USING (sample_id, cell_id))
    SELECT max(n) <= 1 AS new_unique, max(m) <= 1 AS reference_unique, count(*) FILTER (m IS NULL) AS extra_in_new,
           count(*) FILTER (n IS NULL) AS missing_from_new, min(name) FILTER (m IS NULL) AS first_extra,
           min(name) FILTER (n IS NULL) AS first_missing,
           (max(n) <= 1 AND max(m) <= 1 AND count(*) FILTER (m IS NULL OR n IS NULL) = 0) AS passed FROM j""",
)
def j10(spark, sf_dir):
    reference = counts_l(spark, sf_dir).where("gene < 'Brand#3'")
    return rounded(identity_diff(cells_o(spark, sf_dir), reference).drop("same_order"))


@query(
    "u01_row_union",
    f"""WITH {CELLS_O} SELECT sample_id, cell_id, cell_type AS label FROM cells_o UNION ALL
        SELECT sample_id, cell_id, compartment FROM cells_o""",
)
def u01(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    return a.cohort_union(
        [
            cells.select("sample_id", "cell_id", F.col("cell_type").alias("label"), "x"),
            cells.select("sample_id", "cell_id", F.col("compartment").alias("label"), "y"),
        ]
    )


@query(
    "u01_row_union_outer",
    f"""WITH {CELLS_O} SELECT sample_id, cell_id, x, CAST(NULL AS DOUBLE) AS y FROM cells_o UNION ALL
        SELECT sample_id, cell_id, NULL, y FROM cells_o""",
)
def u01_outer(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    return a.cohort_union([cells.select("sample_id", "cell_id", "x"), cells.select("sample_id", "cell_id", "y")], "outer")


@query(
    "u02_label_difference",
    """SELECT "label", 'left' AS only_in FROM (SELECT c_name AS "label" FROM customer WHERE c_acctbal > 0 EXCEPT
         SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey) UNION ALL
       SELECT "label", 'right' FROM (SELECT c_name AS "label" FROM customer JOIN orders ON c_custkey = o_custkey EXCEPT
         SELECT c_name FROM customer WHERE c_acctbal > 0)""",
)
def u02(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    buying = customers.join(table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left_semi")
    name = F.col("c_name").alias("label")
    return label_difference(customers.where("c_acctbal > 0").select(name), buying.select(name), "label")


@query(
    "u03_gene_sets",
    f"""WITH {COUNTS_BS}, g AS (SELECT gene, count(DISTINCT sample_id) AS n FROM counts_bs GROUP BY gene)
        SELECT gene, n = (SELECT count(DISTINCT sample_id) FROM counts_bs) AS in_all FROM g""",
)
def u03(spark, sf_dir):
    features = listed_genes(counts_bs(spark, sf_dir))
    shared = a.genes_in_all(features).withColumn("in_all", F.lit(True))
    return a.genes_in_any(features).join(shared, "gene", "left").na.fill(False, ["in_all"])
