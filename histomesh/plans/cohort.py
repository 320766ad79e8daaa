"""From per-sample bundles to one checked, normalised cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.lineage import cut, dealt, small
from histomesh.operators import align, checks, normalize, review
from histomesh.operators.roles import coordinate_pair, with_coordinates
from histomesh.sources import scans, sinks

KEY = ["sample_id", "cell_id"]
CELL_IX = ["bundle", "cell_ix"]


def read_bundles(spark: SparkSession, files: dict) -> dict[str, DataFrame]:
    """Tables of all bundles: ``cells``, ``counts``, ``features`` and what checks need.

    Entries outside the dictionaries have no names and are not among the counts; they and
    cut-off files are what ``check_cohort`` reports, which ``build_cohort`` requires to be empty.
    ``files`` holds globs for ``counts``, ``genes``, ``barcodes`` and ``obs``, and
    optionally ``spatial``, ``pca`` and ``umap``. Without ``spatial``, coordinates come from the
    metadata; if it is a list, from the first of these tables, or else the metadata, that has them
    for all cells. Components become the array columns ``X_pca`` and ``X_umap``. Matrix text is
    parsed once; the entries lie dealt out by cell, so that totals and names move none of them.
    """
    triplets, sizes = scans.read_triplets(spark, files["counts"])
    triplets, sizes = dealt(triplets, CELL_IX), cut(sizes)
    genes = cut(scans.read_features(spark, files["genes"]))
    barcodes = cut(scans.read_dictionary(spark, files["barcodes"]))
    metadata = scans.read_sample_metadata(spark, files["obs"])
    listed = barcodes.select("sample_id", F.col("name").alias("cell_id"))
    cells = align.align(listed, metadata, KEY)
    spatial = files.get("spatial")
    if isinstance(spatial, (list, tuple)):
        tables = [scans.read_sample_metadata(spark, path) for path in spatial]
        cells = align.first_complete_coordinates(cells, [*tables, metadata])
    elif spatial is not None:
        table = scans.read_sample_metadata(spark, spatial)
        if coordinate_pair(table.columns) is None:
            raise ValueError("the spatial table has no complete pair of coordinate columns")
        placed = with_coordinates(table).select(*KEY, "x", "y")
        cells = align.align(cells.drop("x", "y"), placed, KEY)
    else:
        cells = with_coordinates(cells)
    for table in ("pca", "umap"):
        if table in files:
            name = f"X_{table}"
            cells = align.align(cells.drop(name), scans.read_sample_embedding(spark, files[table], name), KEY)
    return {
        "cells": cells,
        "counts": scans.named_counts(triplets, genes, barcodes),
        "features": genes.select("sample_id", F.col("name").alias("gene"), "feature_id", "feature_type").distinct(),
        "triplets": triplets,
        "sizes": sizes,
        "genes": genes,
        "barcodes": barcodes,
    }


def check_cohort(tables: dict[str, DataFrame], manifest: DataFrame | None = None) -> DataFrame:
    """Violations of all rules a cohort must satisfy, in one table.

    With a ``manifest(sample_id, condition, n_cells)`` every sample must hold the cells and the one
    condition that it states, and no sample may be there or lacking that it does not know of.
    """
    cells = tables["cells"]
    found = [
        checks.duplicate_keys(cells, KEY),
        checks.coordinate_violations(cells),
        checks.label_violations(cells, ["sample_id", "condition"]),
        checks.condition_conflicts(cells),
        checks.count_violations(tables["counts"]),
    ]
    if manifest is not None:
        found.append(checks.manifest_violations(manifest) if "bundle_dir" in manifest.columns else checks.duplicate_keys(manifest, ["sample_id"]))
        named = [table.withColumn("source_id", F.col("sample_id")) for table in (cells, manifest)]
        found.append(checks.source_mismatches(*named))
    if "stated_sample" in cells.columns:
        found.append(checks.sample_contradictions(cells))
    if "sizes" in tables:
        dictionary = [tables["genes"], tables["barcodes"]]
        found.append(checks.dimension_violations(tables["triplets"], *dictionary, tables["sizes"]))
        found.append(checks.duplicate_keys(tables["genes"], ["bundle", "name"]))
    return checks.together(*found)


def build_cohort(
    spark: SparkSession,
    files: dict[str, str],
    sheet: DataFrame | None = None,
    annotations: DataFrame | None = None,
    annotate_on=KEY,
    target: float | None = 1e4,
    join: str = "inner",
    manifest: DataFrame | None = None,
    kind: str | None = None,
) -> dict[str, DataFrame]:
    """Read, stamp, check, annotate, normalise and merge all samples in one plan.

    Normalisation comes before the gene join, so dropping genes does not rescale; features of
    another ``kind``, if one is asked for, are dropped before. With a sheet its conditions are
    used; without, the metadata must have them. ``features`` keeps ids and types that agree in all samples, ``facts``
    tell how the cohort was put together.
    """
    tables = read_bundles(spark, files)
    if sheet is not None:
        checks.require(checks.duplicate_keys(sheet, ["sample_id"]))
        stray = align.unmatched(tables["cells"], sheet, ["sample_id"])
        if not stray.isEmpty():
            raise checks.CheckFailed("the sample sheet does not list every sample")
        conditions = sheet.select("sample_id", "condition")
        tables["cells"] = tables["cells"].drop("condition").join(conditions, "sample_id")
    tables["cells"] = cut(tables["cells"])
    checks.require(check_cohort(tables, manifest))
    cells = tables["cells"].drop("stated_sample")
    if annotations is not None:
        cells = align.attach_annotations(cells, annotations, annotate_on)
    triplets, genes, features = tables["triplets"], tables["genes"], tables["features"]
    if kind is not None:
        features = cut(normalize.select_features(features, kind))
        genes = genes.where(F.col("feature_type") == kind)
        triplets = triplets.join(small(genes.select("bundle", (F.col("position") + 1).alias("gene_ix"))), ["bundle", "gene_ix"], "left_semi")
    normal = normalize.log_normalize(triplets, target, CELL_IX)
    expression = scans.named_counts(normal, genes, tables["barcodes"], ["x"]).withColumn("n", F.col("n").cast("int"))
    listed = align.genes_in_all(features) if join == "inner" else align.genes_in_any(features)
    sources = tables["barcodes"].groupBy(F.lit("source").alias("fact"), F.col("bundle").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    joined = tables["barcodes"].agg(F.lit("join").alias("fact"), F.lit(join).alias("label"), F.count_distinct("sample_id").alias("n"))
    return {
        "cells": cells,
        "expression": align.cohort_genes(expression, features, join),
        "genes": listed,
        "features": align.agreeing_feature_columns(features, ["feature_id", "feature_type"]).join(small(listed), "gene", "left_semi"),
        "facts": sources.unionByName(joined),
    }


def write_cohort(cohort: dict[str, DataFrame], path: str) -> None:
    """Parquet tables by sample, the gene list, and a manifest of cohort facts.

    Cells and genes of the manifest are the cohort's shape; with its sources and how genes were joined.
    """
    sinks.write_by_sample(cohort["cells"], f"{path}/cells")
    sinks.write_by_sample(cohort["expression"], f"{path}/expression")
    cohort["genes"].write.mode("errorifexists").parquet(f"{path}/genes")
    known = [c for c in ("compartment", "cell_type") if c not in cohort["cells"].columns]
    cells = cohort["cells"].withColumns({c: F.lit(None).cast("string") for c in known})
    profile = review.cohort_profile(cells, cohort["genes"]).where("label is not null")
    if "facts" in cohort:
        profile = profile.unionByName(cohort["facts"])
    sinks.write_manifest(profile, f"{path}/manifest")
