"""Joining metadata, annotations and cohorts by exact identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.functions.geometry import is_finite
from histomesh.functions.ids import is_blank, merge_depth, without_merge_suffix
from histomesh.lineage import cut, small
from histomesh.operators.checks import CheckFailed, duplicate_keys, require, row_set_changes
from histomesh.operators.roles import coordinate_pair

KEY = ["sample_id", "cell_id"]
# The columns that curation overwrites or creates.
CURATED_COLUMNS = (
    "condition",
    "cluster_sub",
    "celltype_short",
    "celltype_full",
    "centroid_x",
    "centroid_y",
)


def unmatched(left: DataFrame, right: DataFrame, on=KEY) -> DataFrame:
    """Left keys that the right table does not have."""
    return left.select(*on).join(right.select(*on), list(on), "left_anti")


def align(left: DataFrame, right: DataFrame, on=KEY, check: bool = True) -> DataFrame:
    """Give every left row its one right row; extra right rows are dropped.

    With ``check`` the right keys must be unique and cover the left ones.
    """
    on = list(on)
    if check:
        require(duplicate_keys(right, on))
        missing = unmatched(left, right, on).count()
        if missing:
            raise CheckFailed(f"missing {missing} of the cells asked for in the right table")
    return left.join(right, on)


def attach_annotations(cells: DataFrame, annotations: DataFrame, on=KEY, check: bool = True) -> DataFrame:
    """:func:`align`, refusing annotation columns that the cells already have.

    With ``on=["cell_id"]`` one table serves all samples: the same row goes to
    the same raw id of each.
    """
    clash = sorted((set(annotations.columns) & set(cells.columns)) - set(on))
    if clash:
        raise CheckFailed(f"the cells have these columns, they already exist: {', '.join(clash)}")
    return align(cells, annotations, on, check)


def genes_in_all(features: DataFrame) -> DataFrame:
    """Genes that the feature tables of all samples list."""
    listed = features.select("sample_id", "gene").distinct()
    samples = listed.select(F.count_distinct("sample_id")).scalar()
    return listed.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == samples).select("gene")


def genes_in_any(features: DataFrame) -> DataFrame:
    return features.select("gene").distinct()


def cohort_genes(counts: DataFrame, features: DataFrame, how: str = "inner") -> DataFrame:
    """Restrict long counts to the gene axis of the cohort.

    ``inner`` keeps genes listed for every sample. ``outer`` keeps everything;
    absent entries are zero simply by not being stored. The gene list is broadcast if a
    count proves it small, so the counts stay where they are.
    """
    if how not in ("inner", "outer"):
        raise ValueError("how must be 'inner' or 'outer'")
    if how == "outer":
        return counts
    return counts.join(small(genes_in_all(features)), "gene", "left_semi")


def cohort_union(tables, how: str = "inner") -> DataFrame:
    """Stack per-source tables; columns follow the same inner/outer rule."""
    tables = list(tables)
    if how == "outer":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*shared) for t in tables])


def agreeing_feature_columns(features: DataFrame, columns) -> DataFrame:
    """Per gene, the feature columns whose value is the same in all samples."""
    same = [
        F.when(
            F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))),
            F.min(c),
        ).alias(c)
        for c in columns
    ]
    return features.groupBy("gene").agg(*same)


def bijection_report(left: DataFrame, right: DataFrame, on=KEY) -> DataFrame:
    """One row telling whether the keys of both sides match one to one."""
    on = list(on)
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n_right"))
    n_left, n_right = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    report = a.join(b, on, "full").agg(
        F.coalesce(F.sum(n_left), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum(n_right), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(F.when(n_right == 0, n_left)), F.lit(0)).alias("unmatched_left"),
        F.coalesce(F.sum(F.when(n_left == 0, n_right)), F.lit(0)).alias("unmatched_right"),
        F.count_if(n_left > 1).alias("repeated_left"),
        F.count_if(n_right > 1).alias("repeated_right"),
    )
    clean = [F.col(c) == 0 for c in ("unmatched_left", "unmatched_right", "repeated_left", "repeated_right")]
    return report.withColumn("bijection", reduce(lambda p, q: p & q, clean))


def recovery_report(base: DataFrame, source: DataFrame) -> DataFrame:
    """Would dropping merge suffixes from base ids make a complete match?"""
    stripped = base.select("sample_id", without_merge_suffix("cell_id").alias("cell_id"))
    exact = bijection_report(base, source).select(
        F.col("bijection").alias("exact"), "unmatched_left", "unmatched_right"
    )
    after = bijection_report(stripped, source).select(F.col("bijection").alias("after_recovery"))
    depth = merge_depth("cell_id")
    changes = base.agg(
        F.count_if(depth > 0).alias("ids_changed"), F.coalesce(F.max(depth), F.lit(0)).alias("max_depth")
    )
    one = F.lit(1).alias("report")
    return (
        exact.withColumn("report", one)
        .join(after.withColumn("report", one), "report")
        .join(changes.withColumn("report", one), "report")
        .drop("report")
    )


def recover_ids(base: DataFrame, source: DataFrame, allow: bool = False) -> DataFrame:
    """Base with ids that match the source exactly; never a partial or implicit fix."""
    report = recovery_report(base, source).first()
    if report["exact"]:
        return base
    if allow and report["after_recovery"]:
        return base.withColumn("cell_id", without_merge_suffix("cell_id"))
    hint = "; dropping merge suffixes would match completely" if report["after_recovery"] else ""
    raise CheckFailed(
        f"cell identities differ: {report['unmatched_left']} base and "
        f"{report['unmatched_right']} source keys unmatched{hint}"
    )


def patch_annotations(base: DataFrame, authority: DataFrame, columns=CURATED_COLUMNS, check: bool = True) -> DataFrame:
    """Overwrite or create the curated columns; other columns and rows stay."""
    kept = base.drop(*columns)
    patched = kept.join(authority.select(*KEY, *columns), KEY)
    if check:
        patched = cut(patched)
        require(row_set_changes(base, patched))
    return patched


def cell_ids(metadata: DataFrame, object_name: str = "cell_name") -> DataFrame:
    """Use the metadata's own cell id if there is one, else the object's name."""
    if "cell_id" in metadata.columns:
        named = metadata.withColumn("cell_id", F.col("cell_id").cast("string"))
    else:
        named = metadata.withColumn("cell_id", F.col(object_name).cast("string"))
    refuse = F.raise_error(F.lit("cell ids contain missing or empty values"))
    return named.withColumn("cell_id", F.when(is_blank("cell_id"), refuse).otherwise(F.col("cell_id")))


def first_complete_coordinates(cells: DataFrame, sources) -> DataFrame:
    """Coordinates from the first source that has them, finite, for all cells.

    ``sources`` is an ordered list of tables keyed by ``(sample_id, cell_name)``
    or, if any name is missing there, by ``(sample_id, cell_id)``. A source is
    used for all cells or not at all. What every source and key would give is counted by
    one job, before any is chosen.
    """
    tried = []
    for place, source in enumerate(sources):
        pair = coordinate_pair(source.columns, images=True)
        for key in ("cell_name", "cell_id") if pair else ():
            if key in source.columns and key in cells.columns:
                point = F.struct(F.col(pair[0]).cast("double").alias("px"), F.col(pair[1]).cast("double").alias("py"))
                once = source.select("sample_id", key, point.alias("p")).groupBy("sample_id", key).agg(F.min("p").alias("p"))
                tried.append((place, cells.drop("x", "y").join(once, ["sample_id", key])))
    found = F.count(F.lit(1)).alias("found")
    facts = [cells.agg(F.lit(-1).alias("nth"), found, F.lit(0).cast("long").alias("finite"))]
    for nth, (_, joined) in enumerate(tried):
        facts.append(joined.agg(F.lit(nth).alias("nth"), found, F.count_if(is_finite("p.px") & is_finite("p.py")).alias("finite")))
    counted = {row["nth"]: row for row in reduce(DataFrame.unionByName, facts).collect()}
    total, given_up = counted[-1]["found"], set()
    for nth, (place, joined) in enumerate(tried):
        if place not in given_up and counted[nth]["found"] == total:
            if counted[nth]["finite"] == total:
                return joined.withColumn("x", F.col("p.px")).withColumn("y", F.col("p.py")).drop("p")
            given_up.add(place)
    raise CheckFailed("no source has finite coordinates for every cell")
