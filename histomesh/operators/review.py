"""Tables for looking at one cohort, one compartment or one sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.composition import WHOLE_SAMPLE


def compartments(abundance: DataFrame) -> DataFrame:
    """Real compartment labels, sorted."""
    return (
        abundance.where(F.col("compartment") != WHOLE_SAMPLE)
        .select("compartment")
        .distinct()
        .orderBy("compartment")
    )


def domain_overview(abundance: DataFrame) -> DataFrame:
    """Size and share of every domain over the samples of each condition."""
    per_sample = (
        abundance.where(F.col("compartment") != WHOLE_SAMPLE)
        .groupBy("condition", "sample", "compartment")
        .agg(
            F.max("compartment_total_cells").alias("cells"),
            F.max("compartment_fraction").alias("share"),
        )
    )
    return per_sample.groupBy("condition", "compartment").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("cells").alias("mean_cells"),
        F.stddev_samp("cells").alias("sd_cells"),
        F.avg("share").alias("mean_sample_fraction"),
        F.stddev_samp("share").alias("sd_sample_fraction"),
    )


def domain_composition(abundance: DataFrame, compartment: str) -> DataFrame:
    """Cell-type make-up of one compartment, most frequent types first."""
    return (
        abundance.where(F.col("compartment") == str(compartment))
        .groupBy("condition", "cell_type")
        .agg(
            F.count_distinct("sample").alias("n_samples"),
            F.avg("cell_type_fraction").alias("mean_fraction"),
            F.stddev_samp("cell_type_fraction").alias("sd_fraction"),
            F.avg("n_cells").alias("mean_cells"),
        )
        .orderBy("condition", F.desc("mean_fraction"), "cell_type")
    )


def _wide(table: DataFrame, keys: list[str], label: str, value: Column, columns: list | None) -> DataFrame:
    """One column per label; where a key has no row for it, 0.

    Labels become the schema, so unless the caller names them they are read from the
    table: one row per label, which is as many as the result has columns. A null label
    makes the column ``null``.
    """
    if columns is None:
        found = [row[0] for row in table.select(label).distinct().collect()]
        columns = sorted((x for x in found if x is not None)) + [None] * (None in found)
    own = F.col(label)
    cells = [F.coalesce(F.max(F.when(own.eqNullSafe(F.lit(x)), value)), F.lit(0.0)).alias("null" if x is None else x) for x in columns]
    return table.groupBy(*keys).agg(*cells) if cells else table.select(*keys).distinct()


def _single(name: str, keys: list[str]):
    """The only value of a pivot cell; several rows for one cell are an error."""
    explain = F.concat(F.lit("duplicate entries for "), F.concat_ws(", ", *keys))
    return F.when(F.count(name) > 1, F.raise_error(explain)).otherwise(F.max(name))


def fraction_matrix(summary: DataFrame, compartment: str, source: str | None = None, columns: list | None = None) -> DataFrame:
    """Mean neighbour fractions with one column per neighbour type (``columns``, or all there are)."""
    chosen = summary.where(F.col("compartment") == str(compartment))
    keys = ["condition", "source_cell_type"]
    if source is not None:
        chosen = chosen.where(F.col("source_cell_type") == str(source))
        keys = ["condition"]
    checked = chosen.groupBy(*keys, "neighbor_cell_type").agg(
        _single("mean_neighbor_fraction", [*keys, "neighbor_cell_type"]).alias("value")
    )
    return _wide(checked, keys, "neighbor_cell_type", F.col("value"), columns)


def overview_matrix(overview: DataFrame, columns: list | None = None) -> DataFrame:
    """Mean share of every compartment with one column per condition."""
    return _wide(overview, ["compartment"], "condition", F.col("mean_sample_fraction"), columns)


def composition_matrix(composition: DataFrame, columns: list | None = None) -> DataFrame:
    """Mean fraction of every cell type per condition, largest maximum first."""
    largest = composition.groupBy(F.col("cell_type").alias("of")).agg(F.max("mean_fraction").alias("largest"))
    wide = _wide(composition, ["cell_type"], "condition", F.col("mean_fraction"), columns)
    ranked = wide.join(largest, F.col("cell_type").eqNullSafe(F.col("of")))
    return ranked.orderBy(F.desc("largest"), "cell_type").drop("of", "largest")


def support_table(summary: DataFrame, compartment: str, source: str) -> DataFrame:
    """How many samples and cells stand behind one source type."""
    return (
        summary.where(
            (F.col("compartment") == str(compartment)) & (F.col("source_cell_type") == str(source))
        )
        .select(
            "condition",
            "source_cell_type",
            "n_samples",
            "n_supporting_samples",
            "total_source_cells",
        )
        .dropDuplicates(["condition", "source_cell_type"])
        .orderBy("condition", "source_cell_type")
    )


def source_types(summary: DataFrame, compartment: str) -> DataFrame:
    """Source cell types that occur in a compartment, sorted."""
    return (
        summary.where(F.col("compartment") == str(compartment))
        .select("source_cell_type")
        .distinct()
        .orderBy("source_cell_type")
    )


def cohort_profile(cells: DataFrame, features: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Long table of cohort facts: totals, and the cell count of every label."""
    roles = {"sample_id": "sample", "condition": "condition", "compartment": "compartment", "cell_type": "cell_type"}
    pairs = F.array(
        F.struct(F.lit("cells").alias("fact"), F.lit("").alias("label")),
        *[
            F.struct(F.lit(fact).alias("fact"), F.col(column).alias("label"))
            for column, fact in roles.items()
        ],
    )
    profile = (
        cells.groupBy(*roles)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.inline(pairs), "n")
        .groupBy("fact", "label")
        .agg(F.sum("n").alias("n"))
    )
    for fact, table in (("genes", features), ("edges", edges)):
        if table is not None:
            rows = table.select("gene").distinct() if fact == "genes" else table
            total = rows.agg(F.count(F.lit(1)).alias("n"))
            profile = profile.unionByName(
                total.select(F.lit(fact).alias("fact"), F.lit("").alias("label"), "n")
            )
    return profile


def run_overview(cells: DataFrame) -> DataFrame:
    """One line about the run: cells, samples, conditions, domains and types."""
    profile = cohort_profile(cells)

    def labels(fact: str):
        return F.count_if(F.col("fact") == fact)

    return profile.agg(
        F.max(F.when(F.col("fact") == "cells", F.col("n"))).alias("cells"),
        labels("sample").alias("samples"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("fact") == "condition", F.col("label")))), ", "
        ).alias("conditions"),
        labels("compartment").alias("domains"),
        labels("cell_type").alias("cell_types"),
    )


def point_slice(cells: DataFrame, sample: str, label: str = "compartment") -> DataFrame:
    """Coordinates and label of the cells of one sample."""
    return cells.where(F.col("sample_id") == str(sample)).select("x", "y", F.col(label).alias("label"))
