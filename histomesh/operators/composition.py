"""Abundance and neighbour composition per sample and compartment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import cut
from histomesh.operators.labels import with_every_label
from histomesh.operators.roles import column

# Fixed value: the compartment name of whole-sample rows.
WHOLE_SAMPLE = "all"
GROUP = ["condition", "sample", "compartment"]
NEIGHBOR_COLUMNS = [
    *GROUP,
    "source_cell_type",
    "source_n_cells",
    "neighbor_cell_type",
    "neighbor_count",
    "neighbor_fraction",
    "neighbor_presence",
]


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and zero where there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def observed_counts(cells: DataFrame) -> DataFrame:
    """Cells per condition, sample, compartment and cell type, as they occur."""
    real = F.when(
        F.col("compartment") == WHOLE_SAMPLE,
        F.raise_error(F.lit(f"'{WHOLE_SAMPLE}' is reserved and cannot be a compartment")),
    ).otherwise(F.col("compartment"))
    return (
        cells.groupBy("condition", F.col("sample_id").alias("sample"), "compartment", "cell_type")
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .withColumn("compartment", real)
    )


def zero_filled_counts(observed: DataFrame) -> DataFrame:
    """Every sample with every compartment and cell type, absent ones as zero."""
    every = observed.select("condition", "sample").distinct()
    every = with_every_label(every, observed, "compartment")
    every = with_every_label(every, observed, "cell_type")
    return every.join(observed, [*GROUP, "cell_type"], "left").select(
        *GROUP, "cell_type", F.coalesce("n_cells", F.lit(0)).alias("n_cells")
    )


def with_whole_sample(detail: DataFrame) -> DataFrame:
    """Add rows that sum each cell type over the compartments of a sample."""
    whole = (
        detail.groupBy("condition", "sample", "cell_type")
        .agg(F.sum("n_cells").alias("n_cells"))
        .withColumn("compartment", F.lit(WHOLE_SAMPLE))
    )
    return detail.unionByName(whole)


def with_shares(abundance: DataFrame) -> DataFrame:
    """Add compartment and sample totals and the two fractions.

    The windows run over the counted table, whose groups are one row per label.
    """
    in_compartment = Window.partitionBy(*GROUP)
    in_sample = Window.partitionBy("condition", "sample")
    detail_only = F.when(F.col("compartment") != WHOLE_SAMPLE, F.col("n_cells"))
    return (
        abundance.withColumn("compartment_total_cells", F.sum("n_cells").over(in_compartment))
        .withColumn("sample_total_cells", F.sum(detail_only).over(in_sample))
        .withColumn(
            "cell_type_fraction", _share(F.col("n_cells"), F.col("compartment_total_cells"))
        )
        .withColumn(
            "compartment_fraction",
            F.try_divide(F.col("compartment_total_cells"), F.col("sample_total_cells")),
        )
    )


def compartment_abundance(cells: DataFrame) -> DataFrame:
    """Zero-filled cell-type abundance with whole-sample rows and fractions."""
    observed = cut(observed_counts(cells))
    return with_shares(with_whole_sample(zero_filled_counts(observed)))


def with_support(rows: DataFrame, abundance: DataFrame) -> DataFrame:
    """Look up how many source cells stand behind each row; none counts as zero."""
    support = abundance.select(
        *GROUP,
        F.col("cell_type").alias("source_cell_type"),
        F.col("n_cells").alias("source_n_cells"),
    )
    joined = rows.join(support, [*GROUP, "source_cell_type"], "left")
    return joined.withColumn("source_n_cells", F.coalesce("source_n_cells", F.lit(0)))


def neighbor_counts(
    edges: DataFrame, cells: DataFrame, scope: str = "sample", include_all: bool = False
) -> DataFrame:
    """Edges, and source cells having such an edge, per group and directed type pair.

    Edges are first added up per source cell. That step reuses the partitioning
    of the label join, makes the distinct count a plain count, and leaves only
    one row per cell and neighbour type for the final aggregation.
    """
    if scope not in ("sample", "compartment"):
        raise ValueError("scope must be 'sample' or 'compartment'")
    labels = cells.select("sample_id", "cell_id", "condition", "compartment", "cell_type")
    far = labels.select(
        "sample_id",
        F.col("cell_id").alias("dst"),
        F.col("cell_type").alias("neighbor_cell_type"),
        F.col("compartment").alias("neighbor_compartment"),
    )
    near = labels.withColumnRenamed("cell_id", "src").withColumnRenamed(
        "cell_type", "source_cell_type"
    )
    typed = edges.select("sample_id", "src", "dst").join(far, ["sample_id", "dst"])
    typed = typed.join(near, ["sample_id", "src"])
    if scope == "compartment":
        typed = typed.where("compartment = neighbor_compartment")
    pair = ["condition", "compartment", "source_cell_type", "neighbor_cell_type"]
    per_cell = typed.groupBy("sample_id", "src", *pair).agg(F.count(F.lit(1)).alias("links"))
    if include_all:
        per_cell = per_cell.withColumn(
            "compartment", F.explode(F.array(F.col("compartment"), F.lit(WHOLE_SAMPLE)))
        )
    return per_cell.groupBy(F.col("sample_id").alias("sample"), *pair).agg(
        F.sum("links").alias("links"), F.count(F.lit(1)).alias("linked_cells")
    )


def neighbor_composition(
    edges: DataFrame, cells: DataFrame, scope: str = "sample", include_all: bool = False
) -> DataFrame:
    """Zero-filled long table: one row per group and directed cell-type pair."""
    observed = cut(observed_counts(cells))
    support = zero_filled_counts(observed)
    if include_all:
        support = with_whole_sample(support)
    types = observed.select(F.col("cell_type").alias("neighbor_cell_type"))
    every = with_every_label(
        support.withColumnRenamed("cell_type", "source_cell_type").withColumnRenamed(
            "n_cells", "source_n_cells"
        ),
        types,
        "neighbor_cell_type",
    )
    pairs = neighbor_counts(edges, cells, scope, include_all)
    keys = [*GROUP, "source_cell_type", "neighbor_cell_type"]
    links = F.coalesce("links", F.lit(0))
    row = Window.partitionBy(*GROUP, "source_cell_type")
    return (
        every.join(pairs, keys, "left")
        .withColumn("neighbor_count", links.cast("double"))
        .withColumn("neighbor_fraction", _share(links, F.sum(links).over(row)))
        .withColumn(
            "neighbor_presence",
            _share(F.coalesce("linked_cells", F.lit(0)), F.col("source_n_cells")),
        )
        .select(*NEIGHBOR_COLUMNS)
    )


def unpivot_types(matrix: DataFrame, value: str) -> DataFrame:
    """A wide table with one column per neighbour type as directed-pair rows."""
    keys = [*GROUP, "source_cell_type"]
    types = [name for name in matrix.columns if name not in keys]
    pairs = [F.struct(F.lit(t).alias("neighbor_cell_type"), column(t).cast("double").alias(value)) for t in types]
    if not pairs:
        return matrix.select(*keys, F.lit("").alias("neighbor_cell_type"), F.lit(0.0).alias(value)).limit(0)
    return matrix.select(*keys, F.inline(F.array(*pairs)))


def matrices_to_long(
    fractions: DataFrame, counts: DataFrame, presence: DataFrame, abundance: DataFrame
) -> DataFrame:
    """Wide fraction, count and presence tables as the long neighbour table.

    Rows and columns follow the fractions; what the other two lack becomes null.
    """
    keys = [*GROUP, "source_cell_type", "neighbor_cell_type"]
    others = [unpivot_types(counts, "neighbor_count"), unpivot_types(presence, "neighbor_presence")]
    rows = reduce(
        lambda left, right: left.join(right, keys, "left"),
        others,
        unpivot_types(fractions, "neighbor_fraction"),
    )
    return with_support(rows, abundance).select(*NEIGHBOR_COLUMNS)


def neighbor_summary(neighbors: DataFrame) -> DataFrame:
    """Means and sample deviations over the samples of a condition.

    Zero-filled rows take part in every mean; ``n_supporting_samples`` counts
    only rows with source cells behind them.
    """
    return neighbors.groupBy(
        "condition", "compartment", "source_cell_type", "neighbor_cell_type"
    ).agg(
        F.count_distinct("sample").alias("n_samples"),
        F.count_if(F.col("source_n_cells") > 0).alias("n_supporting_samples"),
        F.sum("source_n_cells").alias("total_source_cells"),
        F.avg("neighbor_count").alias("mean_neighbor_count"),
        F.avg("neighbor_fraction").alias("mean_neighbor_fraction"),
        F.stddev_samp("neighbor_fraction").alias("sd_neighbor_fraction"),
        F.avg("neighbor_presence").alias("mean_neighbor_presence"),
        F.stddev_samp("neighbor_presence").alias("sd_neighbor_presence"),
    )


def domain_abundance(cells: DataFrame) -> DataFrame:
    """Cells per sample and domain with their share; only what occurs.

    Sample totals are added up from the counted table, so no task ever holds the
    cells of a whole sample.
    """
    counted = cells.groupBy("sample_id", "condition", F.col("compartment").alias("domain")).agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    in_sample = Window.partitionBy("sample_id")
    return counted.withColumn("sample_cells", F.sum("n_cells").over(in_sample)).withColumn(
        "fraction", F.try_divide(F.col("n_cells"), F.col("sample_cells"))
    )


def design_table(cells: DataFrame) -> DataFrame:
    """Samples with their condition and number of cells."""
    return cells.groupBy("sample_id", "condition").agg(F.count(F.lit(1)).alias("n_cells"))


def source_audit(annotations: DataFrame, levels=("cluster_sub", "celltype_short", "celltype_full")) -> DataFrame:
    """Per sample: cells and the number of different labels at each level."""
    return annotations.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.count_distinct(level).alias(f"n_{level}") for level in levels],
    )


def audit_against_base(audit: DataFrame, base: DataFrame) -> DataFrame:
    """The audit with the base object's own cell counts beside it."""
    counted = base.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_cells_in_base"))
    return audit.join(counted, "sample_id", "left").withColumn(
        "counts_agree", F.col("n_cells").eqNullSafe(F.col("n_cells_in_base"))
    )
