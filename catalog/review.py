"""Review tables."""

from __future__ import annotations

from catalog.composition import ABUNDANCE, NEIGHBORS, summary
from catalog.registry import query, rounded
from catalog.views import CELLS_O, EDGES_KR, ONLY_ENTRIES, cells_o, counts_l
from histomesh.operators import review as r
from histomesh.operators.composition import compartment_abundance
from histomesh.operators.neighbors import knn_radius_edges


def abundance(spark, sf_dir):
    return compartment_abundance(cells_o(spark, sf_dir))


OVERVIEW = f"""{ABUNDANCE}, overview AS (
  SELECT condition, compartment, count(DISTINCT sample) AS n_samples, avg(compartment_total_cells) AS mean_cells,
         stddev_samp(compartment_total_cells) AS sd_cells, avg(compartment_fraction) AS mean_sample_fraction,
         stddev_samp(compartment_fraction) AS sd_sample_fraction
  FROM (SELECT DISTINCT condition, sample, compartment, compartment_total_cells, compartment_fraction
        FROM abundance WHERE compartment <> 'all') GROUP BY ALL)"""

COMPOSITION = f"""{ABUNDANCE}, composition AS (
  SELECT condition, cell_type, count(DISTINCT sample) AS n_samples, avg(cell_type_fraction) AS mean_fraction,
         stddev_samp(cell_type_fraction) AS sd_fraction, avg(n_cells) AS mean_cells
  FROM abundance WHERE compartment = 'O' GROUP BY ALL)"""


@query(
    "a08_cohort_profile",
    f"""WITH {EDGES_KR}, {ONLY_ENTRIES}
      SELECT 'cells' AS fact, '' AS label, count(*) AS n FROM cells_o
      UNION ALL SELECT 'sample', sample_id, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'condition', condition, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'compartment', compartment, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'cell_type', cell_type, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'genes', '', count(DISTINCT gene) FROM entries_l
      UNION ALL SELECT 'edges', '', count(*) FROM edges""",
)
def a08(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    edges = knn_radius_edges(cells, 6, 30.0)
    return rounded(r.cohort_profile(cells, counts_l(spark, sf_dir), edges))


@query(
    "a15_domain_overview",
    f"""WITH {OVERVIEW} SELECT condition, compartment, n_samples, round(mean_cells, 6) AS mean_cells,
        round(sd_cells, 6) AS sd_cells, round(mean_sample_fraction, 6) AS mean_sample_fraction,
        round(sd_sample_fraction, 6) AS sd_sample_fraction FROM overview""",
)
def a15(spark, sf_dir):
    return rounded(r.domain_overview(abundance(spark, sf_dir)))


@query(
    "a16_domain_composition",
    f"""WITH {COMPOSITION} SELECT condition, cell_type, n_samples, round(mean_fraction, 6) AS mean_fraction,
        round(sd_fraction, 6) AS sd_fraction, round(mean_cells, 6) AS mean_cells FROM composition""",
)
def a16(spark, sf_dir):
    return rounded(r.domain_composition(abundance(spark, sf_dir), "O"))


@query("a17_compartments", f"WITH {CELLS_O} SELECT DISTINCT compartment FROM cells_o")
def a17(spark, sf_dir):
    return r.compartments(abundance(spark, sf_dir))


def _columns(label: str, value: str, labels: tuple[str, ...]) -> str:
    """One column per label, 0 where there is no row for it."""
    return ", ".join(f"""coalesce(max(round({value}, 6)) FILTER ({label} = '{x}'), 0) AS "{x}\"""" for x in labels)


TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CONDITIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
BY_TYPE = _columns("neighbor_cell_type", "mean_neighbor_fraction", TYPES)


@query(
    "a18_fraction_matrix",
    f"""WITH {NEIGHBORS} SELECT condition, source_cell_type, {BY_TYPE}
        FROM summary WHERE compartment = 'O' GROUP BY condition, source_cell_type""",
)
def a18(spark, sf_dir):
    return rounded(r.fraction_matrix(summary(spark, sf_dir), "O", columns=TYPES))


@query(
    "a18_fraction_matrix_one_source",
    f"""WITH {NEIGHBORS} SELECT condition, {BY_TYPE}
        FROM summary WHERE compartment = 'O' AND source_cell_type = '1-URGENT' GROUP BY condition""",
)
def a18_one(spark, sf_dir):
    return rounded(r.fraction_matrix(summary(spark, sf_dir), "O", "1-URGENT", columns=TYPES))


@query(
    "a19_overview_matrix",
    f"""WITH {OVERVIEW} SELECT compartment, {_columns("condition", "mean_sample_fraction", CONDITIONS)}
        FROM overview GROUP BY compartment""",
)
def a19(spark, sf_dir):
    return rounded(r.overview_matrix(r.domain_overview(abundance(spark, sf_dir)), columns=CONDITIONS))


@query(
    "a20_composition_matrix",
    f"""WITH {COMPOSITION} SELECT cell_type, {_columns("condition", "mean_fraction", CONDITIONS)}
        FROM composition GROUP BY cell_type""",
)
def a20(spark, sf_dir):
    return rounded(r.composition_matrix(r.domain_composition(abundance(spark, sf_dir), "O"), columns=CONDITIONS))


@query(
    "a21_support_table",
    f"""WITH {NEIGHBORS} SELECT DISTINCT condition, source_cell_type, n_samples, n_supporting_samples, total_source_cells
        FROM summary WHERE compartment = 'O' AND source_cell_type = '1-URGENT'""",
)
def a21(spark, sf_dir):
    return rounded(r.support_table(summary(spark, sf_dir), "O", "1-URGENT"))


@query(
    "a22_source_types",
    f"WITH {NEIGHBORS} SELECT DISTINCT source_cell_type FROM summary WHERE compartment = 'O'",
)
def a22(spark, sf_dir):
    return r.source_types(summary(spark, sf_dir), "O")


@query(
    "a24_run_overview",
    f"""WITH {CELLS_O} SELECT count(*) AS cells, count(DISTINCT sample_id) AS samples,
        (SELECT string_agg(condition, ', ' ORDER BY condition) FROM (SELECT DISTINCT condition FROM cells_o)) AS conditions,
        count(DISTINCT compartment) AS domains, count(DISTINCT cell_type) AS cell_types FROM cells_o""",
)
def a24(spark, sf_dir):
    return rounded(r.run_overview(cells_o(spark, sf_dir)))


@query(
    "p15_point_slice",
    f"""WITH {CELLS_O} SELECT x, y, compartment AS label FROM cells_o
        WHERE sample_id = (SELECT min(sample_id) FROM cells_o)""",
)
def p15(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    first = cells.selectExpr("min(sample_id)").first()[0]
    return r.point_slice(cells, first)
