"""The analysis stages: domains, composition, curation and the review page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut
from histomesh.operators import align, checks, composition, domains, neighbors, normalize, review
from histomesh.operators.delaunay import delaunay_edges
from histomesh.operators.hops import aggregate_entries, aggregate_hops, hop_rings
from histomesh.sources import sinks

KEY = ["sample_id", "cell_id"]


def require_labelled(cells: DataFrame, labels=("sample_id", "condition", "cell_type")) -> None:
    """What every analysis stage asks of its cells before any long work."""
    checks.require(
        checks.together(
            checks.label_violations(cells, list(labels)), checks.condition_conflicts(cells)
        )
    )


def spatial_graph(cells: DataFrame, mode: str = "delaunay", k: int = 6, radius: float | None = None) -> DataFrame:
    """Edges in one of the three graph modes."""
    mode = mode.lower()
    if mode == "delaunay":
        return delaunay_edges(cells)
    if mode == "knn":
        return neighbors.knn_edges(cells, k)
    if mode == "radius":
        if radius is None:
            raise ValueError("the radius must be positive in radius mode")
        return neighbors.radius_edges(cells, radius)
    raise ValueError("the graph mode must be delaunay, knn or radius")


def run_domains(
    cells: DataFrame,
    vec: str | None = "embedding",
    mode: str = "delaunay",
    k: int = 6,
    radius: float | None = None,
    percentile: float | None = 99.0,
    layers: int = 3,
    funcs=("mean",),
    reduce_to: int | None = None,
    expression: DataFrame | None = None,
    components: int = 30,
    **clustering,
) -> dict[str, object]:
    """Representation, graph, pruning, hop features, mixture fits over k, and labels.

    ``vec`` names an array column of the cells. If they don't have it, it is made of
    ``expression``: ``components`` principal components. ``None`` and ``"X"`` mean expression itself; its
    surroundings stay sparse, and their ``reduce_to`` components, or ``components``, are clustered.
    """
    require_labelled(cells)
    checks.require(checks.coordinate_violations(cells))
    itself = vec in (None, "X")
    if expression is None and (itself or vec not in cells.columns):
        raise KeyError(f"the cells have no representation {vec!r}, and there is no expression to make it of")
    edges = cut(neighbors.prune_long(spatial_graph(cells, mode, k, radius), percentile))
    rings = hop_rings(edges, layers)
    if itself:
        around = aggregate_entries(expression, cut(rings), funcs)
        named = F.concat_ws("/", F.col("hop").cast("string"), "stat", "gene").alias("gene")
        long = cut(around.select(*KEY, named, F.col("value").alias("x")))
        made = normalize.pca_representation(long, cells, min(reduce_to or components, long.select("gene").distinct().count()))
        vectors = domains.as_vectors(made, "embedding")
    else:
        own = cells
        if vec not in cells.columns:
            made = normalize.cell_representation(cells, expression, vec, components)
            own = cells.join(made.withColumnRenamed("embedding", vec), KEY)
        vectors = domains.as_vectors(aggregate_hops(own, rings, vec, layers, funcs), "features", reduce_to)
    assigned, stability, best = domains.find_domains(vectors, **clustering)
    labelled = cells.drop("compartment").join(assigned, KEY)
    return {
        "cells": labelled,
        "edges": edges,
        "stability": stability,
        "peaks": domains.stability_peaks(stability),
        "best_k": best,
        "abundance": composition.domain_abundance(labelled),
    }


def run_composition(cells: DataFrame, k: int = 6, radius: float = 30.0, path: str | None = None) -> dict[str, DataFrame]:
    """Abundance, neighbour composition and its summary; optionally written."""
    require_labelled(cells, ("sample_id", "condition", "cell_type", "compartment"))
    edges = cut(neighbors.knn_radius_edges(cells, k, radius))
    abundance = composition.compartment_abundance(cells)
    pairs = cut(composition.neighbor_composition(edges, cells))
    tables = {
        "compartment_abundance": abundance,
        "neighbor_composition": pairs,
        "neighbor_composition_summary": composition.neighbor_summary(pairs),
    }
    if path is not None:
        for name, table in tables.items():
            sinks.write_results(table, f"{path}/{name}")
        sinks.write_manifest(review.cohort_profile(cells, edges=edges), f"{path}/manifest")
    return tables


def run_curation(
    base: DataFrame, sources: DataFrame, sheet: DataFrame, allow_merge_suffix: bool = False
) -> dict[str, DataFrame]:
    """Put authoritative annotations onto a merged object, or refuse.

    ``sources`` holds all per-sample annotation tables with the ``source_id`` of
    each row; the sheet states the sample and condition of every source.
    """
    checks.require(checks.sheet_violations(sheet))
    trimmed = sheet.select(*[F.trim(F.col(c)).alias(c) for c in ("sample_id", "condition", "input_path")])
    sizes = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_cells"))
    manifest = trimmed.withColumnRenamed("input_path", "source_id").join(sizes, "source_id", "left")
    labels = ("cluster_sub", "celltype_short", "celltype_full")
    checks.require(
        checks.together(
            checks.source_mismatches(sources, manifest),
            checks.label_violations(sources, [*KEY, *labels], blank=True),
            checks.coordinate_violations(sources, "centroid_x", "centroid_y"),
            checks.duplicate_keys(sources, KEY),
        )
    )
    fixed = cut(align.recover_ids(base, sources, allow_merge_suffix))
    patched = align.patch_annotations(fixed, sources)
    audit = composition.audit_against_base(composition.source_audit(sources), patched)
    if not audit.where("not counts_agree").isEmpty():
        raise checks.CheckFailed("some sample keeps another number of cells once ids are matched")
    return {
        "cells": patched,
        "audit": audit,
        "identity": align.recovery_report(base, sources),
    }


def review_page(tables: dict[str, DataFrame], compartment: str | None = None, source: str | None = None) -> dict[str, DataFrame]:
    """All tables of one review page; by default for the first domain and type."""
    abundance = tables["compartment_abundance"]
    summary = tables["neighbor_composition_summary"]
    if compartment is None:
        compartment = review.compartments(abundance).first()["compartment"]
    if source is None:
        source = review.source_types(summary, compartment).first()["source_cell_type"]
    overview = review.domain_overview(abundance)
    parts = review.domain_composition(abundance, compartment)
    return {
        "overview": overview,
        "overview_matrix": review.overview_matrix(overview),
        "composition": parts,
        "composition_matrix": review.composition_matrix(parts),
        "support": review.support_table(summary, compartment, source),
        "fraction_matrix": review.fraction_matrix(summary, compartment, source),
    }
