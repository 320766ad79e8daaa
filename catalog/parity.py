"""Cohort comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import (
    CELLS_O, ENTRIES_L, ONLY_ENTRIES, ONLY_REVISED_ENTRIES, REVISED, REVISED_ENTRIES, cells_o, counts_l, curated, entries_l, revised,
    revised_entries, table,
)
from histomesh.operators import parity as p
from histomesh.operators.normalize import canonical_counts


def gene_list(spark, sf_dir):
    """Brands in name order, with positions."""
    order = Window.orderBy("gene")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
    return brands.select((F.row_number().over(order) - 1).alias("position"), "gene")


def revised_genes(spark, sf_dir):
    """The same list after one brand was renamed."""
    renamed = F.expr("CASE WHEN gene = 'Brand#3' THEN 'brand#3' ELSE gene END")
    return gene_list(spark, sf_dir).withColumn("gene", renamed)


@query(
    "d01_shape",
    f"""WITH {REVISED_ENTRIES} SELECT 'cells' AS fact, (SELECT count(*) FROM (SELECT DISTINCT sample_id, cell_id FROM revised_entries)) AS "new",
          (SELECT count(*) FROM cells_o) AS reference,
          (SELECT count(*) FROM (SELECT DISTINCT sample_id, cell_id FROM revised_entries)) = (SELECT count(*) FROM cells_o) AS passed
        UNION ALL SELECT 'genes', count(DISTINCT p_brand), count(DISTINCT p_brand), true FROM part""",
)
def d01(spark, sf_dir):
    genes = gene_list(spark, sf_dir)
    cells = revised_entries(spark, sf_dir).select("sample_id", "cell_id").distinct()
    return rounded(p.shape_diff(cells, genes, cells_o(spark, sf_dir), genes))


@query(
    "d02_feature_order",
    """WITH g AS (SELECT p_brand AS gene, row_number() OVER (ORDER BY p_brand) - 1 AS pos FROM (SELECT DISTINCT p_brand FROM part)),
        d AS (SELECT pos, CASE WHEN gene = 'Brand#3' THEN 'brand#3' ELSE gene END AS a, gene AS b FROM g)
      SELECT count(*) = 0 AS passed, min(pos) AS position, arg_min(a, pos) AS "new", arg_min(b, pos) AS reference
      FROM d WHERE a <> b""",
)
def d02(spark, sf_dir):
    return rounded(p.feature_order_diff(revised_genes(spark, sf_dir), gene_list(spark, sf_dir)))


@query(
    "d03_sample_counts",
    f"""WITH {REVISED_ENTRIES}, a AS (SELECT sample_id, count(DISTINCT cell_id) AS n FROM revised_entries GROUP BY 1),
          b AS (SELECT sample_id, count(*) AS m FROM cells_o GROUP BY 1)
        SELECT sample_id, n AS "new", m AS reference, n IS NOT DISTINCT FROM m AS passed FROM a FULL JOIN b USING (sample_id)""",
)
def d03(spark, sf_dir):
    cells = revised_entries(spark, sf_dir).select("sample_id", "cell_id").distinct()
    return rounded(p.sample_count_diff(cells, cells_o(spark, sf_dir)))


@query(
    "d03_samples",
    f"""WITH {CELLS_O} SELECT count(DISTINCT sample_id) AS new_samples, count(DISTINCT sample_id) AS reference_samples,
        CAST(0 AS BIGINT) AS different, count(DISTINCT sample_id) = 25 AS passed FROM cells_o""",
)
def d03_samples(spark, sf_dir):
    return rounded(p.samples_check(revised(spark, sf_dir), curated(spark, sf_dir), 25))


@query(
    "d04_identity",
    f"""WITH {REVISED_ENTRIES}, n AS (SELECT sample_id, cell_id, count(*) AS n, min(pos) AS pos FROM
            (SELECT DISTINCT sample_id, cell_id, CAST(cell_id AS BIGINT) AS pos FROM revised_entries) GROUP BY ALL),
          r AS (SELECT sample_id, cell_id, count(*) AS m, min(CAST(cell_id AS BIGINT)) AS rpos FROM cells_o GROUP BY ALL),
          j AS (SELECT sample_id || ':' || cell_id AS name, * FROM n FULL JOIN r USING (sample_id, cell_id))
        SELECT max(n) <= 1 AS new_unique, max(m) <= 1 AS reference_unique, count(*) FILTER (m IS NULL) AS extra_in_new,
          count(*) FILTER (n IS NULL) AS missing_from_new, arg_min(name, pos) FILTER (m IS NULL) AS first_extra,
          arg_min(name, rpos) FILTER (n IS NULL) AS first_missing,
          (max(n) <= 1 AND max(m) <= 1 AND count(*) FILTER (m IS NULL OR n IS NULL) = 0) AS passed,
          (max(n) <= 1 AND max(m) <= 1 AND count(*) FILTER (m IS NULL OR n IS NULL) = 0
            AND count(*) FILTER (pos IS DISTINCT FROM rpos) = 0) AS same_order FROM j""",
)
def d04(spark, sf_dir):
    place = F.col("cell_id").cast("bigint")
    new = revised_entries(spark, sf_dir).select("sample_id", "cell_id").distinct()
    return rounded(
        p.identity_diff(new.withColumn("position", place), cells_o(spark, sf_dir).withColumn("position", place))
    )


@query(
    "d04_legacy_keys",
    f"WITH {CELLS_O} SELECT sample_id, cell_id, cell_type FROM cells_o",
)
def d04_legacy(spark, sf_dir):
    named = cells_o(spark, sf_dir).select(
        F.col("sample_id").alias("sample"), F.concat_ws(":", F.lit("merged"), "cell_id").alias("obs_name"), "cell_type"
    )
    return p.legacy_keys(named).select("sample_id", "cell_id", "cell_type")


@query(
    "d05_conditions",
    f"""WITH {REVISED}, j AS (SELECT r.sample_id, coalesce(r.condition, '') AS a, coalesce(c.condition, '') AS b
          FROM revised r JOIN curated c USING (sample_id, cell_id)),
        s AS (SELECT sample_id, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM j GROUP BY 1),
        m AS (SELECT count(*) FILTER (a = '') AS new_missing, count(*) FILTER (b = '') AS reference_missing,
                     count(*) FILTER (a <> b) AS mismatched FROM j)
      SELECT m.*, (SELECT count(*) FROM s WHERE na > 1) AS new_conflicts, (SELECT count(*) FROM s WHERE nb > 1) AS reference_conflicts,
             (new_missing + reference_missing + mismatched = 0) AS passed FROM m""",
)
def d05(spark, sf_dir):
    return rounded(p.condition_diff(revised(spark, sf_dir), curated(spark, sf_dir)))


@query(
    "d05_conditions_by_sample",
    f"WITH {REVISED} SELECT sample_id, condition, count(*) AS n_cells FROM revised GROUP BY ALL",
)
def d05_map(spark, sf_dir):
    return rounded(p.conditions_by_sample(revised(spark, sf_dir)))


@query(
    "d06_labels",
    f"""WITH {REVISED}, j AS (SELECT coalesce(r.cluster_sub, '') AS a1, coalesce(c.cluster_sub, '') AS b1,
          coalesce(r.celltype_short, '') AS a2, coalesce(c.celltype_short, '') AS b2,
          coalesce(r.celltype_full, '') AS a3, coalesce(c.celltype_full, '') AS b3
          FROM revised r JOIN curated c USING (sample_id, cell_id)),
        m AS (SELECT 'cluster_sub' AS field, count(*) FILTER (a1 = '') AS missing_or_empty, count(*) FILTER (a1 <> b1) AS mismatched FROM j UNION ALL
              SELECT 'celltype_short', count(*) FILTER (a2 = ''), count(*) FILTER (a2 <> b2) FROM j UNION ALL
              SELECT 'celltype_full', count(*) FILTER (a3 = ''), count(*) FILTER (a3 <> b3) FROM j)
      SELECT *, (missing_or_empty = 0 AND mismatched = 0) AS passed FROM m""",
)
def d06(spark, sf_dir):
    return rounded(p.label_diff(revised(spark, sf_dir), curated(spark, sf_dir)))


def _pairing(name: str, a: tuple, b: tuple) -> str:
    gaps = [f"abs({x} - {y})" for x, y in zip(a, b)]
    finite = " AND ".join(f"isfinite({x})" for x in a)
    far = " OR ".join(f"(NOT isnan({g}) AND {g} > 0.000001)" for g in gaps)
    defined = ", ".join(f"CASE WHEN NOT isnan({g}) THEN {g} END" for g in gaps)
    return f"""SELECT '{name}' AS pairing, count(*) FILTER (NOT ({finite})) AS nonfinite_rows,
      count(*) FILTER (NOT ({finite}) OR {far}) AS mismatched_rows,
      round(coalesce(max(greatest({defined})), 0), 6) AS max_abs_difference FROM j"""


@query(
    "d07_coordinates",
    f"""WITH {REVISED}, j AS (SELECT r.centroid_x AS ncx, r.centroid_y AS ncy, r.x AS nx, r.y AS ny,
          c.centroid_x AS rcx, c.centroid_y AS rcy, c.x AS rx, c.y AS ry
          FROM revised r JOIN curated c USING (sample_id, cell_id)),
        m AS ({_pairing('centroids_vs_reference', ('ncx', 'ncy'), ('rcx', 'rcy'))} UNION ALL
              {_pairing('spatial_vs_reference', ('nx', 'ny'), ('rx', 'ry'))} UNION ALL
              {_pairing('new_spatial_vs_centroids', ('nx', 'ny'), ('ncx', 'ncy'))})
      SELECT *, mismatched_rows = 0 AS passed FROM m""",
)
def d07(spark, sf_dir):
    return rounded(p.coordinate_diff(revised(spark, sf_dir), curated(spark, sf_dir)))


@query(
    "d08_canonical_counts",
    f"""WITH {ENTRIES_L} SELECT sample_id, cell_id, gene, CAST(sum(n) AS BIGINT) AS n FROM entries_l
        GROUP BY ALL HAVING sum(n) <> 0""",
)
def d08(spark, sf_dir):
    return rounded(canonical_counts(entries_l(spark, sf_dir).select("sample_id", "cell_id", "gene", "n")))


COUNT_JOIN = f"""{REVISED_ENTRIES}, a AS (SELECT sample_id, cell_id, gene, sum(n) AS n FROM revised_entries GROUP BY ALL),
  b AS (SELECT sample_id, cell_id, gene, sum(n) AS m FROM entries_l GROUP BY ALL),
  differing AS (SELECT sample_id, cell_id, gene, CAST(coalesce(n, 0) AS BIGINT) AS "new", CAST(coalesce(m, 0) AS BIGINT) AS reference
    FROM a FULL JOIN b USING (sample_id, cell_id, gene) WHERE coalesce(n, 0) <> coalesce(m, 0))"""


@query("d09_count_entries", f"WITH {COUNT_JOIN} SELECT * FROM differing")
def d09_entries(spark, sf_dir):
    return rounded(p.count_entries(revised_entries(spark, sf_dir), entries_l(spark, sf_dir)))


@query(
    "d09_count_diff",
    f"""WITH {COUNT_JOIN}, f AS (SELECT sample_id, cell_id FROM differing ORDER BY 1, 2 LIMIT 1)
        SELECT count(*) = 0 AS passed, count(DISTINCT (sample_id, cell_id)) AS mismatched_rows, count(*) AS mismatched_entries,
          (SELECT sample_id FROM f) AS first_sample, (SELECT cell_id FROM f) AS first_cell FROM differing""",
)
def d09(spark, sf_dir):
    return rounded(p.count_diff(revised_entries(spark, sf_dir), entries_l(spark, sf_dir)))


@query("d10_row_digest", f"WITH {COUNT_JOIN} SELECT DISTINCT sample_id, cell_id FROM differing")
def d10(spark, sf_dir):
    return p.digest_diff(revised_entries(spark, sf_dir), entries_l(spark, sf_dir))


@query(
    "d09_count_diff_by_digest",
    f"""WITH {COUNT_JOIN}, f AS (SELECT sample_id, cell_id FROM differing ORDER BY 1, 2 LIMIT 1)
        SELECT count(*) = 0 AS passed, count(DISTINCT (sample_id, cell_id)) AS mismatched_rows, count(*) AS mismatched_entries,
          (SELECT sample_id FROM f) AS first_sample, (SELECT cell_id FROM f) AS first_cell FROM differing""",
)
def d09_by_digest(spark, sf_dir):
    return rounded(p.count_diff_by_digest(revised_entries(spark, sf_dir), entries_l(spark, sf_dir)))


@query(
    "d10_digest_levels",
    f"""WITH {COUNT_JOIN}, cells AS (
          SELECT sample_id, cell_id, max(new) AS new, max(ref) AS ref FROM (
            SELECT DISTINCT sample_id, cell_id, 1 AS new, 0 AS ref FROM revised_entries GROUP BY sample_id, cell_id, gene HAVING sum(n) <> 0
            UNION ALL SELECT DISTINCT sample_id, cell_id, 0, 1 FROM entries_l GROUP BY sample_id, cell_id, gene HAVING sum(n) <> 0)
          GROUP BY ALL), marked AS (
          SELECT c.*, substr(md5(cell_id), 1, 2) AS block, d.cell_id IS NULL AS same
          FROM cells c LEFT JOIN (SELECT DISTINCT sample_id, cell_id FROM differing) d USING (sample_id, cell_id))
        SELECT 'block' AS level, sample_id, block, CAST(sum(new) AS BIGINT) AS new_cells, CAST(sum(ref) AS BIGINT) AS reference_cells, bool_and(same) AS equal
        FROM marked GROUP BY sample_id, block UNION ALL
        SELECT 'sample', sample_id, '', CAST(sum(new) AS BIGINT), CAST(sum(ref) AS BIGINT), bool_and(same) FROM marked GROUP BY sample_id""",
)
def d10_levels(spark, sf_dir):
    return rounded(p.digest_levels(revised_entries(spark, sf_dir), entries_l(spark, sf_dir)))


# Every check of the report, from the differences between the two cohorts.
REPORT_DIFFERENCES = f"""{REVISED}, {ONLY_ENTRIES}, {ONLY_REVISED_ENTRIES},
  aligned AS (SELECT r.*, c.condition AS rc, c.cluster_sub AS r1, c.celltype_short AS r2, c.celltype_full AS r3,
      c.centroid_x AS rcx, c.centroid_y AS rcy, c.x AS rx, c.y AS ry FROM revised r JOIN curated c USING (sample_id, cell_id)),
  size AS (SELECT (SELECT count(*) FROM aligned) AS both_sides, (SELECT count(*) FROM revised) AS n_new, (SELECT count(*) FROM curated) AS n_ref),
  a AS (SELECT sample_id, cell_id, gene, sum(n) AS n FROM revised_entries GROUP BY ALL),
  b AS (SELECT sample_id, cell_id, gene, sum(n) AS m FROM entries_l GROUP BY ALL)"""


@query(
    "d11_report",
    f"""WITH {REPORT_DIFFERENCES}
    SELECT 'shape' AS "check", n_new = n_ref AS passed FROM size UNION ALL
    SELECT 'gene_order', count(DISTINCT p_brand) = count(DISTINCT p_brand) FROM part UNION ALL
    SELECT 'samples', count(DISTINCT sample_id) = 25 FROM revised UNION ALL
    SELECT 'cell_identity', both_sides = n_new AND both_sides = n_ref FROM size UNION ALL
    SELECT 'conditions', count(*) FILTER (condition = '' OR condition <> rc) = 0 FROM aligned UNION ALL
    SELECT 'metadata', count(*) FILTER (coalesce(cluster_sub, '') <> r1 OR coalesce(celltype_short, '') <> r2
       OR coalesce(celltype_full, '') <> r3) = 0 FROM aligned UNION ALL
    SELECT 'coordinates', count(*) FILTER (isnan(x) OR abs(centroid_x - rcx) > 0.000001 OR abs(x - centroid_x) > 0.000001) = 0 FROM aligned UNION ALL
    SELECT 'raw_counts', count(*) FILTER (coalesce(n, 0) <> coalesce(m, 0)) = 0 FROM a FULL JOIN b USING (sample_id, cell_id, gene)""",
)
def d11(spark, sf_dir):
    genes = gene_list(spark, sf_dir)
    new = {"cells": revised(spark, sf_dir), "genes": genes, "counts": revised_entries(spark, sf_dir)}
    reference = {"cells": curated(spark, sf_dir), "genes": genes, "counts": entries_l(spark, sf_dir)}
    return p.parity_report(new, reference, expected_samples=25).select("check", "passed")


@query(
    "d11_report_skips",
    f"""WITH {REVISED_ENTRIES}, size AS (SELECT (SELECT count(*) FROM cells_o) AS n_ref,
          (SELECT count(*) FROM (SELECT DISTINCT sample_id, cell_id FROM revised_entries)) AS n_new)
    SELECT 'shape' AS "check", n_new = n_ref AS passed FROM size UNION ALL
    SELECT 'gene_order', count(*) FILTER (p_brand = 'Brand#3') = 0 FROM part UNION ALL
    SELECT unnest(['samples', 'cell_identity', 'conditions', 'metadata', 'coordinates', 'raw_counts']), n_new = n_ref FROM size""",
)
def d11_skips(spark, sf_dir):
    taxed = revised_entries(spark, sf_dir).select("sample_id", "cell_id").distinct()
    new = {
        "cells": revised(spark, sf_dir).join(taxed, ["sample_id", "cell_id"], "left_semi"),
        "genes": revised_genes(spark, sf_dir),
        "counts": revised_entries(spark, sf_dir),
    }
    reference = {
        "cells": curated(spark, sf_dir), "genes": gene_list(spark, sf_dir), "counts": counts_l(spark, sf_dir)
    }
    return p.parity_report(new, reference, expected_samples=25).select("check", "passed")
