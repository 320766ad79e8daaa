"""Abundance, neighbour composition, summaries and review tables on tiny cohorts."""

import pytest
from pyspark.sql import functions as F

from histomesh.operators import composition as c
from histomesh.operators import review as r
from histomesh.operators.labels import label_slots, with_every_label

CELL = "sample_id string, cell_id string, condition string, cell_type string, compartment string"


MAKE_UP = [("u1", "young", "K", "p", 3), ("u1", "young", "M", "p", 1), ("u1", "young", "M", "q", 2), ("u2", "old", "K", "q", 1), ("u2", "old", "N", "q", 2), ("u3", "old", "M", "p", 1), ("u3", "old", "N", "q", 1)]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(s, f"{t}{d}{k}", c, t, d) for s, c, t, d, n in MAKE_UP for k in range(n)]
    return spark.createDataFrame(rows, CELL)


@pytest.fixture(scope="module")
def abundance(cells):
    return c.compartment_abundance(cells).cache()


def test_abundance_is_zero_filled_with_whole_sample_rows(abundance):
    rows = {(x["sample"], x["compartment"], x["cell_type"]): x for x in abundance.collect()}
    assert len(rows) == 3 * 3 * 3
    assert {key[1] for key in rows} == {"p", "q", "all"}
    assert rows["u1", "p", "K"]["compartment_total_cells"] == 4
    assert rows["u1", "p", "K"]["compartment_fraction"] == pytest.approx(4 / 6)
    assert [rows["u1", "p", t]["cell_type_fraction"] for t in "KMN"] == [0.75, 0.25, 0.0]
    assert rows["u1", "all", "M"]["n_cells"] == 3 and rows["u1", "all", "M"]["compartment_fraction"] == 1
    assert rows["u2", "p", "K"]["n_cells"] == 0 and rows["u2", "p", "K"]["cell_type_fraction"] == 0


def test_fractions_add_up_to_one_or_zero(abundance):
    sums = abundance.groupBy("sample", "compartment").agg(F.round(F.sum("cell_type_fraction"), 9).alias("s"))
    assert {row["s"] for row in sums.collect()} <= {0.0, 1.0}


def test_reserved_compartment_is_refused(cells):
    with pytest.raises(Exception, match="reserved"):
        c.compartment_abundance(cells.withColumn("compartment", F.lit("all")))


def test_neighbor_composition_counts_support_and_presence(spark):
    rows = [("u1", str(i), "young", "K" if i < 5 else "M", "p") for i in range(8)]
    rows += [("u2", str(i), "young", "M" if i < 2 else "K", "p") for i in range(3)]
    cells = spark.createDataFrame(rows, CELL)
    links = [("u1", a, b) for a, b in ("05", "06", "15", "27", "30", "51", "67")] + [("u2", "0", "1")]
    edges = spark.createDataFrame(links, "sample_id string, src string, dst string")
    long = c.neighbor_composition(edges, cells).cache()
    assert long.columns == c.NEIGHBOR_COLUMNS
    got = {(x["sample"], x["source_cell_type"], x["neighbor_cell_type"]): x for x in long.collect()}
    assert len(got) == 8
    k_m = got["u1", "K", "M"]
    assert (k_m["neighbor_count"], k_m["source_n_cells"], k_m["neighbor_presence"], k_m["neighbor_fraction"]) == (4.0, 5, 0.6, 0.8)
    assert got["u2", "K", "M"]["neighbor_count"] == 0 and got["u2", "K", "M"]["source_n_cells"] == 1
    assert got["u1", "M", "K"]["neighbor_presence"] == pytest.approx(1 / 3) and got["u2", "M", "M"]["neighbor_presence"] == 0.5

    summary = c.neighbor_summary(long).where("source_cell_type = 'K' and neighbor_cell_type = 'M'").first()
    assert (summary["n_samples"], summary["n_supporting_samples"], summary["total_source_cells"]) == (2, 2, 6)
    assert summary["mean_neighbor_count"] == 2.0
    assert summary["mean_neighbor_fraction"] == pytest.approx(0.4) and summary["mean_neighbor_presence"] == pytest.approx(0.3)

    inside = c.neighbor_counts(edges, cells, scope="compartment", include_all=True)
    assert {x["compartment"] for x in inside.collect()} == {"p", "all"}
    with pytest.raises(ValueError):
        c.neighbor_counts(edges, cells, scope="cohort")


def test_wide_tables_become_long_rows(spark, abundance):
    keys = "condition string, sample string, compartment string, source_cell_type string"
    fractions = spark.createDataFrame([("young", "u1", "p", "K", 0.1, 0.3, 0.6)], keys + ", M double, K double, `N.x``y` double")
    counts = spark.createDataFrame([("young", "u1", "p", "K", 9)], keys + ", K int")
    rows = {x["neighbor_cell_type"]: x for x in c.matrices_to_long(fractions, counts, fractions, abundance).collect()}
    assert rows["K"]["neighbor_count"] == 9.0 and rows["M"]["neighbor_count"] is None
    assert rows["K"]["source_n_cells"] == 3 and rows["N.x`y"]["neighbor_fraction"] == 0.6
    empty = c.matrices_to_long(fractions.limit(0), counts, fractions, abundance)
    assert empty.columns == c.NEIGHBOR_COLUMNS and empty.count() == 0


def test_label_slots_stay_unique_over_many_buckets(spark):
    labels = spark.range(5000).select(F.concat(F.lit("g"), "id").alias("gene"))
    slots = label_slots(labels, "gene")
    assert slots.select("slot").distinct().count() == 5000
    groups = spark.createDataFrame([("a",), ("b",)], "sample string")
    assert with_every_label(groups, labels, "gene").distinct().count() == 10_000
    assert with_every_label(groups, labels.limit(0), "gene").count() == 0


def test_domain_abundance_lists_only_what_occurs(cells):
    rows = {(x["sample_id"], x["domain"]): x for x in c.domain_abundance(cells).collect()}
    assert set(rows) == {("u1", "p"), ("u1", "q"), ("u2", "q"), ("u3", "p"), ("u3", "q")}
    assert rows["u1", "p"]["fraction"] == pytest.approx(4 / 6) and rows["u1", "p"]["sample_cells"] == 6


def test_review_tables(spark, abundance):
    assert [x["compartment"] for x in r.compartments(abundance).collect()] == ["p", "q"]
    overview = r.domain_overview(abundance)
    row = overview.where("condition = 'young' and compartment = 'p'").first()
    assert row["n_samples"] == 1 and row["mean_cells"] == 4 and row["sd_cells"] is None
    row = overview.where("condition = 'old' and compartment = 'q'").first()
    assert row["mean_cells"] == 2 and row["sd_cells"] == pytest.approx(2**0.5)
    matrix = {x["compartment"]: x.asDict() for x in r.overview_matrix(overview).collect()}
    assert matrix["p"]["old"] == 0.25 and matrix["p"]["young"] == pytest.approx(4 / 6)
    parts = r.domain_composition(abundance, "q").collect()
    assert [(x["condition"], x["cell_type"]) for x in parts] == [("old", t) for t in "NKM"] + [("young", t) for t in "MKN"]
    assert parts[0]["mean_fraction"] == pytest.approx(5 / 6) and parts[3]["mean_fraction"] == 1.0
    ordered = r.composition_matrix(r.domain_composition(abundance, "q")).collect()
    assert [x["cell_type"] for x in ordered] == ["M", "N", "K"]


FRACTIONS = "condition string, compartment string, source_cell_type string, neighbor_cell_type string, n_samples int, n_supporting_samples int, total_source_cells int, mean_neighbor_fraction double"


def test_fraction_tables(spark):
    rows = [("old", "q", "K", "N", 5, 2, 11, 0.875), ("young", "q", "K", "K", 3, 3, 7, 0.125)]
    summary = spark.createDataFrame(rows, FRACTIONS)
    wide = {x["condition"]: x.asDict() for x in r.fraction_matrix(summary, "q", "K").collect()}
    assert wide["old"] == {"condition": "old", "N": 0.875, "K": 0.0}
    assert "source_cell_type" in r.fraction_matrix(summary, "q").columns
    with pytest.raises(Exception, match="duplicate"):
        r.fraction_matrix(summary.union(summary), "q").collect()
    assert r.support_table(summary, "q", "K").count() == 2
    assert [x[0] for x in r.source_types(summary, "q").collect()] == ["K"]


def test_columns_of_a_pivot_may_be_any_label(spark):
    rows = [("a.b", "q", "K", name, 1, 1, 1, 0.5) for name in ("T.reg", "odd`tick", None)] + [(None, "q", "K", "T.reg", 1, 1, 1, 1.0)]
    summary = spark.createDataFrame(rows, FRACTIONS)
    wide = {x["condition"]: x.asDict() for x in r.fraction_matrix(summary, "q", "K").collect()}
    assert wide["a.b"] == {"condition": "a.b", "T.reg": 0.5, "odd`tick": 0.5, "null": 0.5}
    assert wide[None]["odd`tick"] == 0.0
    chosen = r.fraction_matrix(summary, "q", "K", columns=["T.reg", "never"]).where("condition is not null").first()
    assert chosen.asDict() == {"condition": "a.b", "T.reg": 0.5, "never": 0.0}
    over = spark.createDataFrame([("a.b", "q", 0.25), (None, "p", 0.75)], "condition string, compartment string, mean_sample_fraction double")
    assert {x["compartment"]: x["a.b"] for x in r.overview_matrix(over).collect()} == {"q": 0.25, "p": 0.0}
    parts = spark.createDataFrame([("a.b", "K", 0.25), ("c`d", "M", 0.75)], "condition string, cell_type string, mean_fraction double")
    assert [x["cell_type"] for x in r.composition_matrix(parts).collect()] == ["M", "K"]


def test_run_overview_and_slice(cells):
    row = r.run_overview(cells).first()
    assert (row["cells"], row["samples"], row["conditions"], row["domains"], row["cell_types"]) == (11, 3, "old, young", 2, 3)
    placed = cells.withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    assert r.point_slice(placed, "u1").count() == 6
