"""Abundance, neighbour composition and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import CELLS_E, CELLS_O, CURATED, EDGES_KR, MERGED_BASE, cells_e, cells_o, curated, merged_base
from histomesh.operators import composition as c
from histomesh.operators.neighbors import knn_radius_edges

DETAIL = """observed AS (
  SELECT condition, sample_id AS sample, compartment, cell_type, count(*) AS n_cells FROM cells_o GROUP BY ALL
), detail AS (
  SELECT s.condition, s.sample, k.compartment, t.cell_type, coalesce(o.n_cells, 0) AS n_cells
  FROM (SELECT DISTINCT condition, sample FROM observed) s
  CROSS JOIN (SELECT DISTINCT compartment FROM observed) k
  CROSS JOIN (SELECT DISTINCT cell_type FROM observed) t
  LEFT JOIN observed o ON o.condition = s.condition AND o.sample = s.sample
       AND o.compartment = k.compartment AND o.cell_type = t.cell_type
), with_all AS (
  SELECT * FROM detail UNION ALL
  SELECT condition, sample, 'all' AS compartment, cell_type, sum(n_cells) AS n_cells FROM detail GROUP BY ALL
), abundance AS (
  SELECT *, coalesce(n_cells / nullif(compartment_total_cells, 0), 0) AS cell_type_fraction,
         compartment_total_cells / sample_total_cells AS compartment_fraction
  FROM (SELECT *, sum(n_cells) OVER (PARTITION BY condition, sample, compartment) AS compartment_total_cells,
               sum(CASE WHEN compartment <> 'all' THEN n_cells END) OVER (PARTITION BY condition, sample) AS sample_total_cells
        FROM with_all))"""

ABUNDANCE = f"{CELLS_O}, {DETAIL}"

ABUNDANCE_COLUMNS = """condition, sample, compartment, cell_type, CAST(n_cells AS BIGINT) AS n_cells,
  CAST(compartment_total_cells AS BIGINT) AS compartment_total_cells,
  CAST(sample_total_cells AS BIGINT) AS sample_total_cells,
  round(cell_type_fraction, 6) AS cell_type_fraction, round(compartment_fraction, 6) AS compartment_fraction"""

NEIGHBORS = f"""{EDGES_KR}, {DETAIL}, per_cell AS (
  SELECT s.condition, e.sample_id AS sample, s.compartment, s.cell_type AS source_cell_type,
         t.cell_type AS neighbor_cell_type, e.src, count(*) AS links
  FROM edges e JOIN cells_o s ON s.sample_id = e.sample_id AND s.cell_id = e.src
               JOIN cells_o t ON t.sample_id = e.sample_id AND t.cell_id = e.dst
  GROUP BY ALL
), linked AS (
  SELECT condition, sample, compartment, source_cell_type, neighbor_cell_type,
         sum(links) AS links, count(*) AS linked_cells FROM per_cell GROUP BY ALL
), neighbors AS (
  SELECT d.condition, d.sample, d.compartment, d.cell_type AS source_cell_type,
         CAST(d.n_cells AS BIGINT) AS source_n_cells, t.cell_type AS neighbor_cell_type,
         CAST(coalesce(l.links, 0) AS DOUBLE) AS neighbor_count,
         coalesce(l.links / sum(l.links) OVER (PARTITION BY d.condition, d.sample, d.compartment, d.cell_type), 0) AS neighbor_fraction,
         coalesce(l.linked_cells / nullif(d.n_cells, 0), 0) AS neighbor_presence
  FROM detail d CROSS JOIN (SELECT DISTINCT cell_type FROM observed) t
  LEFT JOIN linked l ON l.condition = d.condition AND l.sample = d.sample AND l.compartment = d.compartment
       AND l.source_cell_type = d.cell_type AND l.neighbor_cell_type = t.cell_type
), summary AS (
  SELECT condition, compartment, source_cell_type, neighbor_cell_type,
         count(DISTINCT sample) AS n_samples, count(*) FILTER (source_n_cells > 0) AS n_supporting_samples,
         CAST(sum(source_n_cells) AS BIGINT) AS total_source_cells, avg(neighbor_count) AS mean_neighbor_count,
         avg(neighbor_fraction) AS mean_neighbor_fraction, stddev_samp(neighbor_fraction) AS sd_neighbor_fraction,
         avg(neighbor_presence) AS mean_neighbor_presence, stddev_samp(neighbor_presence) AS sd_neighbor_presence
  FROM neighbors GROUP BY ALL)"""

NEIGHBOR_COLUMNS = """condition, sample, compartment, source_cell_type, source_n_cells, neighbor_cell_type,
  neighbor_count, round(neighbor_fraction, 6) AS neighbor_fraction, round(neighbor_presence, 6) AS neighbor_presence"""


def neighbors(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    return c.neighbor_composition(knn_radius_edges(cells, 6, 30.0), cells)


def summary(spark, sf_dir):
    return c.neighbor_summary(neighbors(spark, sf_dir))


@query(
    "a01_domain_abundance",
    f"""WITH {CELLS_O} SELECT *, round(n_cells / sample_cells, 6) AS fraction FROM (
      SELECT sample_id, condition, compartment AS domain, count(*) AS n_cells,
             CAST(sum(count(*)) OVER (PARTITION BY sample_id) AS BIGINT) AS sample_cells
      FROM cells_o GROUP BY sample_id, condition, compartment)""",
)
def a01(spark, sf_dir):
    return rounded(c.domain_abundance(cells_o(spark, sf_dir)))


@query(
    "a02_design",
    f"WITH {CELLS_O} SELECT sample_id, condition, count(*) AS n_cells FROM cells_o GROUP BY ALL",
)
def a02(spark, sf_dir):
    return rounded(c.design_table(cells_o(spark, sf_dir)))


@query(
    "a04_observed_abundance",
    f"""WITH {CELLS_O} SELECT condition, sample_id AS sample, compartment, cell_type, count(*) AS n_cells
        FROM cells_o GROUP BY ALL""",
)
def a04(spark, sf_dir):
    return rounded(c.observed_counts(cells_o(spark, sf_dir)))


@query(
    "a05_zero_filled_abundance",
    f"""WITH {CELLS_E}, cells_o AS (SELECT * FROM cells_e), {DETAIL}
        SELECT condition, sample, compartment, cell_type, CAST(n_cells AS BIGINT) AS n_cells FROM detail""",
)
def a05(spark, sf_dir):
    return rounded(c.zero_filled_counts(c.observed_counts(cells_e(spark, sf_dir))))


@query(
    "j08_zero_fill",
    f"""WITH {ABUNDANCE} SELECT condition, sample, compartment, cell_type, CAST(n_cells AS BIGINT) AS n_cells FROM detail""",
)
def j08(spark, sf_dir):
    return rounded(c.zero_filled_counts(c.observed_counts(cells_o(spark, sf_dir))))


@query(
    "u04_label_product",
    f"""WITH {CELLS_O} SELECT * FROM (SELECT DISTINCT compartment FROM cells_o), (SELECT DISTINCT cell_type FROM cells_o)""",
)
def u04(spark, sf_dir):
    from histomesh.operators.labels import with_every_label

    cells = cells_o(spark, sf_dir)
    return with_every_label(cells.select("compartment").distinct(), cells, "cell_type")


@query("u05_distinct_rows", f"WITH {CELLS_O} SELECT DISTINCT condition, sample_id FROM cells_o")
def u05(spark, sf_dir):
    return cells_o(spark, sf_dir).select("condition", "sample_id").distinct()


@query(
    "a06_whole_sample",
    f"""WITH {ABUNDANCE} SELECT condition, sample, compartment, cell_type, CAST(n_cells AS BIGINT) AS n_cells FROM with_all""",
)
def a06(spark, sf_dir):
    observed = c.observed_counts(cells_o(spark, sf_dir))
    return rounded(c.with_whole_sample(c.zero_filled_counts(observed)))


@query("a07_abundance", f"WITH {ABUNDANCE} SELECT {ABUNDANCE_COLUMNS} FROM abundance")
def a07(spark, sf_dir):
    return rounded(c.compartment_abundance(cells_o(spark, sf_dir)))


@query(
    "a09_source_audit",
    f"""WITH {CURATED} SELECT sample_id, count(*) AS n_cells, count(DISTINCT cluster_sub) AS n_cluster_sub,
        count(DISTINCT celltype_short) AS n_celltype_short, count(DISTINCT celltype_full) AS n_celltype_full
        FROM curated GROUP BY sample_id""",
)
def a09(spark, sf_dir):
    return rounded(c.source_audit(curated(spark, sf_dir)))


@query(
    "a10_audit_against_base",
    f"""WITH {MERGED_BASE}, urgent AS (
          SELECT sample_id, count(*) AS n_cells, count(DISTINCT cluster_sub) AS n_cluster_sub,
                 count(DISTINCT celltype_short) AS n_celltype_short, count(DISTINCT celltype_full) AS n_celltype_full
          FROM curated GROUP BY sample_id),
        base AS (SELECT sample_id, count(*) AS n_cells_in_base FROM merged_base WHERE quality > 500 GROUP BY sample_id)
        SELECT u.*, b.n_cells_in_base, (u.n_cells IS NOT DISTINCT FROM b.n_cells_in_base) AS counts_agree
        FROM urgent u LEFT JOIN base b USING (sample_id)""",
)
def a10(spark, sf_dir):
    base = merged_base(spark, sf_dir).where("quality > 500")
    return rounded(c.audit_against_base(c.source_audit(curated(spark, sf_dir)), base))


@query(
    "a11_neighbor_counts",
    f"""WITH {NEIGHBORS} SELECT condition, sample, compartment, source_cell_type, neighbor_cell_type,
        CAST(links AS BIGINT) AS links, linked_cells FROM linked""",
)
def a11(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    return rounded(c.neighbor_counts(knn_radius_edges(cells, 6, 30.0), cells))


@query("a12_neighbor_composition", f"WITH {NEIGHBORS} SELECT {NEIGHBOR_COLUMNS} FROM neighbors")
def a12(spark, sf_dir):
    return rounded(neighbors(spark, sf_dir))


def _wide(long, value):
    keys = ["condition", "sample", "compartment", "source_cell_type"]
    return long.groupBy(*keys).pivot("neighbor_cell_type").agg(F.max(value))


@query(
    "a13_matrices_to_long",
    f"""WITH {NEIGHBORS} SELECT condition, sample, compartment, source_cell_type, source_n_cells, neighbor_cell_type,
        neighbor_count, round(neighbor_fraction, 6) AS neighbor_fraction,
        CASE WHEN neighbor_cell_type <> '5-LOW' THEN round(neighbor_presence, 6) END AS neighbor_presence FROM neighbors""",
)
def a13(spark, sf_dir):
    from histomesh.lineage import cut

    long = cut(neighbors(spark, sf_dir))
    presence = _wide(long, "neighbor_presence").drop("5-LOW")
    observed = c.observed_counts(cells_o(spark, sf_dir))
    return rounded(
        c.matrices_to_long(
            _wide(long, "neighbor_fraction"), _wide(long, "neighbor_count"), presence, observed
        )
    )


@query(
    "j07_support",
    f"""WITH {ABUNDANCE} SELECT d.condition, d.sample, d.compartment, d.cell_type AS source_cell_type,
        CAST(coalesce(o.n_cells, 0) AS BIGINT) AS source_n_cells
        FROM with_all d LEFT JOIN observed o ON o.condition = d.condition AND o.sample = d.sample
             AND o.compartment = d.compartment AND o.cell_type = d.cell_type""",
)
def j07(spark, sf_dir):
    observed = c.observed_counts(cells_o(spark, sf_dir))
    rows = c.with_whole_sample(c.zero_filled_counts(observed)).select(
        "condition", "sample", "compartment", F.col("cell_type").alias("source_cell_type")
    )
    return rounded(c.with_support(rows, observed))


SUMMARY_COLUMNS = """condition, compartment, source_cell_type, neighbor_cell_type, n_samples,
  n_supporting_samples, total_source_cells, round(mean_neighbor_count, 6) AS mean_neighbor_count,
  round(mean_neighbor_fraction, 6) AS mean_neighbor_fraction, round(sd_neighbor_fraction, 6) AS sd_neighbor_fraction,
  round(mean_neighbor_presence, 6) AS mean_neighbor_presence, round(sd_neighbor_presence, 6) AS sd_neighbor_presence"""


@query("a14_neighbor_summary", f"WITH {NEIGHBORS} SELECT {SUMMARY_COLUMNS} FROM summary")
def a14(spark, sf_dir):
    return rounded(summary(spark, sf_dir))


@query(
    "a11_compartment_scope",
    f"""WITH {EDGES_KR}, per_cell AS (
      SELECT s.condition, e.sample_id AS sample, k.compartment,
             s.cell_type AS source_cell_type, t.cell_type AS neighbor_cell_type, e.src, count(*) AS links
      FROM edges e JOIN cells_o s ON s.sample_id = e.sample_id AND s.cell_id = e.src
                   JOIN cells_o t ON t.sample_id = e.sample_id AND t.cell_id = e.dst
                   CROSS JOIN LATERAL (SELECT unnest([s.compartment, 'all']) AS compartment) k
      WHERE s.compartment = t.compartment GROUP BY ALL)
    SELECT condition, sample, compartment, source_cell_type, neighbor_cell_type,
           CAST(sum(links) AS BIGINT) AS links, count(*) AS linked_cells FROM per_cell GROUP BY ALL""",
)
def a11_scope(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    edges = knn_radius_edges(cells, 6, 30.0)
    return rounded(c.neighbor_counts(edges, cells, scope="compartment", include_all=True))
