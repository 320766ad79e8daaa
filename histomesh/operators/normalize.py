"""Feature filter, depth normalisation and a linear cell representation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import cut, small
from histomesh.operators.checks import CheckFailed
from histomesh.operators.gram import principal_axes, projected, sparse_rows

# Fixed value: the feature type that is expression.
EXPRESSION = "Gene Expression"


def select_features(features: DataFrame, kind: str = EXPRESSION, check: bool = True) -> DataFrame:
    """Features of one kind; an absent feature id falls back to the name."""
    chosen = features.where(F.col("feature_type") == kind)
    if check and chosen.isEmpty():
        raise CheckFailed(f"there are no {kind!r} features")
    named = F.col("gene")
    given = F.coalesce("feature_id", named) if "feature_id" in features.columns else named
    keys = ["sample_id"] if "sample_id" in features.columns else []
    return chosen.select(*keys, "gene", given.alias("feature_id"), "feature_type")


def filter_features(counts: DataFrame, features: DataFrame, kind: str = EXPRESSION, check: bool = True) -> DataFrame:
    """Counts of the features of one kind."""
    chosen = select_features(features, kind, check)
    keys = [key for key in ("sample_id", "gene") if key in chosen.columns]
    return counts.join(small(chosen), keys)


def canonical_counts(triplets: DataFrame) -> DataFrame:
    """Add up repeated entries and drop zeros."""
    return (
        triplets.groupBy("sample_id", "cell_id", "gene")
        .agg(F.sum("n").alias("n"))
        .where("n <> 0")
    )


CELL = ("sample_id", "cell_id")


def cell_totals(counts: DataFrame, keys=CELL) -> DataFrame:
    """Total count of every cell."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"))


def log_normalize(counts: DataFrame, target: float | None = 1e4, keys=CELL) -> DataFrame:
    """Add ``x = log1p(n * target / total)``; without a target, the raw count.

    ``keys`` are the columns that tell cells apart. A cell's entries, at most one a gene, meet
    once; if the counts lie dealt out by ``keys`` (see ``lineage.dealt``), nothing is moved.
    """
    if target is None:
        return counts.withColumn("x", F.col("n").cast("double"))
    if target <= 0:
        raise ValueError("the normalisation target must be positive or None")
    total = F.sum("n").over(Window.partitionBy(*keys))
    scaled = F.try_divide(F.col("n") * F.lit(float(target)), total)
    return counts.withColumn("x", F.log1p(F.coalesce(scaled, F.lit(0.0))))


# The widest panel whose square the driver is asked to hold for a component fit.
WIDEST_PANEL = 65_535


def gene_index(genes: DataFrame) -> DataFrame:
    """Genes in name order, numbered from zero."""
    listed = genes.select("gene").distinct()
    return listed.agg(F.posexplode(F.sort_array(F.collect_list("gene"))).alias("ix", "gene"))


def indexed_entries(expression: DataFrame) -> tuple[DataFrame, int]:
    """``(sample_id, cell_id, ix, x)`` of expression, genes by their number, and the panel's size."""
    index = cut(gene_index(expression))
    return expression.join(small(index), "gene").select("sample_id", "cell_id", "ix", "x"), index.count()


def expression_vectors(expression: DataFrame, cells: DataFrame) -> DataFrame:
    """One array per cell over the gene panel, however wide the panel is.

    ``expression(sample_id, cell_id, gene, x)`` holds non-zero entries only;
    cells without any still get a row. Cells travel as sparse pairs; the zeros between two
    entries are put in where the row is made.
    """
    keys = ["sample_id", "cell_id"]
    entries, size = indexed_entries(expression)
    joined = cells.select(*keys).join(sparse_rows(entries, keys), keys, "left")
    ix, x = F.coalesce("ix", F.array().cast("array<int>")), F.coalesce("x", F.array().cast("array<double>"))
    before = F.concat(F.array(F.lit(-1)), ix)
    after = F.concat(ix, F.array(F.lit(size)))
    gaps = F.zip_with(before, after, lambda a, b: F.array_repeat(F.lit(0.0), b - a - 1))
    values = F.concat(F.transform(x, lambda v: F.array(v)), F.array(F.array().cast("array<double>")))
    vector = F.flatten(F.zip_with(gaps, values, lambda gap, v: F.concat(gap, v)))
    return joined.select(*keys, vector.alias("embedding"))


def pca_representation(expression: DataFrame, cells: DataFrame, k: int = 30) -> DataFrame:
    """Principal components of expression after centring each sample.

    From sparse sums (see ``gram``); the square of the panel is bounded by ``WIDEST_PANEL``.
    Entries of cells that are not listed take no part.
    """
    keys = ["sample_id", "cell_id"]
    entries, size = indexed_entries(expression)
    if not 1 <= k <= size:
        raise ValueError(f"k must lie between 1 and the number of genes, {size}")
    if size > WIDEST_PANEL:
        raise ValueError(f"{size} genes; a component fit takes at most {WIDEST_PANEL}")
    entries = cut(entries.join(cells.select(*keys), keys, "left_semi"))
    members = cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("members"))
    axes, _ = principal_axes(entries, members, size, k)
    return projected(entries, cells, axes)


def cell_representation(cells: DataFrame, expression: DataFrame, use: str | None = "X_pca", k: int = 30) -> DataFrame:
    """The named array column if the cells have it, ``X`` itself, or components.

    ``None`` and ``"X"`` mean expression; any other name that is absent is made.
    """
    if use in (None, "X"):
        return expression_vectors(expression, cells)
    if use in cells.columns:
        return cells.select("sample_id", "cell_id", F.col(use).alias("embedding"))
    return pca_representation(expression, cells, k)
