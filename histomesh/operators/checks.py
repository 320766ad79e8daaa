"""Rules a cohort must satisfy, as tables of violations.

Every check returns rows ``(check, key, detail)`` and is empty on success, so
checks can be queried, stored, and joined into one job with ``unionByName``.
:func:`require` turns violations into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.functions.ids import is_blank
from histomesh.functions.geometry import is_finite
from histomesh.operators.roles import missing_columns

# Fixed value: the largest count that is stored.
MAX_COUNT = 2_147_483_647


class CheckFailed(ValueError):
    """At least one violation was found."""


def _violations(df: DataFrame, check: str | Column, keys, detail: str | Column) -> DataFrame:
    named = F.lit(check) if isinstance(check, str) else check
    told = F.lit(detail) if isinstance(detail, str) else detail
    key = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.select(named.alias("check"), key.alias("key"), told.cast("string").alias("detail"))


def require(violations: DataFrame, examples: int = 5) -> None:
    """Raise if there is any violation, showing the first few."""
    found = violations.limit(examples).collect()
    if found:
        shown = "; ".join(f"{row['check']} [{row['key']}] {row['detail']}" for row in found)
        raise CheckFailed(shown)


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def count_violations(counts: DataFrame, keys=("sample_id", "cell_id", "gene"), value: str = "n", tol: float = 0.0) -> DataFrame:
    """Counts must be finite, not negative, storable and whole.

    The first rule broken, in that order, names the violation. ``tol`` allows
    for rounding in sources that keep counts as floating point.
    """
    v = F.col(value).cast("double")
    broken = (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), "finite_nonnegative")
        .when(v > MAX_COUNT, "storage_range")
        .when(F.abs(v - F.rint(v)) > tol, "whole_number")
    )
    bad = counts.withColumn("broken", broken).where(F.col("broken").isNotNull())
    return _violations(bad, F.col("broken"), keys, F.col(value))


def dimension_violations(
    triplets: DataFrame, genes: DataFrame, cells: DataFrame, sizes: DataFrame, key: str = "bundle"
) -> DataFrame:
    """Declared sizes, dictionaries and stored indices of each matrix must agree.

    Indices are one-based: ``triplets(key, gene_ix, cell_ix)``; the two
    dictionaries have one row per entry; ``sizes(key, n_genes, n_cells)``. If the sizes also
    tell ``n_entries`` and the ``n_lines`` found, a cut-off or overlong file is a violation.
    """

    def per_matrix(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    reach = triplets.groupBy(key).agg(
        F.min(F.least("gene_ix", "cell_ix")).alias("low"),
        F.max("gene_ix").alias("top_gene"),
        F.max("cell_ix").alias("top_cell"),
    )
    joined = (
        sizes.join(per_matrix(genes, "genes"), key, "full")
        .join(per_matrix(cells, "cells"), key, "full")
        .join(reach, key, "left")
    )
    rules = {
        "gene_dictionary": ~F.col("genes").eqNullSafe(F.col("n_genes")),
        "cell_dictionary": ~F.col("cells").eqNullSafe(F.col("n_cells")),
        "index_range": (F.col("low") < 1)
        | (F.col("top_gene") > F.col("n_genes"))
        | (F.col("top_cell") > F.col("n_cells")),
    }
    if {"n_entries", "n_lines"} <= set(sizes.columns):
        rules["entries"] = ~F.col("n_entries").eqNullSafe(F.col("n_lines"))
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    bad = joined.withColumn("broken", F.explode(broken))
    told = F.to_json(F.struct("n_genes", "n_cells", "genes", "cells", "top_gene", "top_cell"))
    return _violations(bad, F.col("broken"), [key], told)


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key combinations that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return _violations(repeated, "duplicate_key", keys, F.col("times"))


def label_violations(df: DataFrame, columns, blank: bool = False) -> DataFrame:
    """Columns must exist and hold a label in every row.

    One aggregation covers all columns; the detail is the number of bad rows.
    """
    absent = missing_columns(df, columns)
    if absent:
        raise KeyError(f"missing required columns: {', '.join(absent)}")
    bad = {c: (is_blank(c) if blank else F.col(c).isNull()) for c in columns}
    totals = df.agg(*[F.count_if(rule).alias(c) for c, rule in bad.items()])
    long = totals.unpivot([], list(columns), "column", "rows").where("rows > 0")
    return _violations(long, "missing_label", ["column"], F.col("rows"))


def coordinate_violations(df: DataFrame, x: str = "x", y: str = "y", keys=("sample_id", "cell_id")) -> DataFrame:
    """Every cell needs two finite coordinates."""
    bad = df.where(~(is_finite(x) & is_finite(y)))
    place = F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string"))
    return _violations(bad, "coordinates", keys, place)


def condition_conflicts(df: DataFrame) -> DataFrame:
    """Every sample must have exactly one condition."""
    counted = df.groupBy("sample_id").agg(F.count_distinct("condition").alias("conditions"))
    return _violations(counted.where("conditions <> 1"), "one_condition", ["sample_id"], F.col("conditions"))


def sample_contradictions(df: DataFrame, stated: str = "stated_sample") -> DataFrame:
    """Rows whose table names another sample than the place they come from."""
    bad = df.where(F.col(stated).isNotNull() & (F.col(stated) != F.col("sample_id")))
    return _violations(bad, "stated_sample", ["sample_id", "cell_id"], F.col(stated))


def source_mismatches(df: DataFrame, manifest: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows of a source must carry only what the manifest declares for it.

    ``df`` names the source of each row; ``manifest(source, sample_id, condition,
    n_cells)`` states what that source should hold.
    """
    seen = df.groupBy(source).agg(
        F.min("sample_id").alias("low_sample"),
        F.max("sample_id").alias("high_sample"),
        F.min("condition").alias("low_condition"),
        F.max("condition").alias("high_condition"),
        F.count_if(F.col("sample_id").isNull() | F.col("condition").isNull()).alias("unlabelled"),
        F.count(F.lit(1)).alias("rows"),
    )
    joined = manifest.join(seen, source, "full")

    def pure(low: str, high: str, declared: str) -> Column:
        return F.col(low).eqNullSafe(F.col(declared)) & F.col(high).eqNullSafe(F.col(declared))

    rules = {
        "source_labels": F.col("unlabelled") > 0,
        "source_sample": ~pure("low_sample", "high_sample", "sample_id"),
        "source_condition": ~pure("low_condition", "high_condition", "condition"),
        "source_cells": ~F.col("rows").eqNullSafe(F.col("n_cells")),
    }
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    bad = joined.withColumn("broken", F.explode(broken))
    told = F.concat_ws(
        "/", "low_sample", "high_sample", "low_condition", "high_condition", F.col("rows").cast("string")
    )
    return _violations(bad, F.col("broken"), [source], told)


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """A bundle manifest needs its columns, rows, unique samples and safe relative paths."""
    required = ("sample_id", "condition", "bundle_dir", "n_cells")
    absent = missing_columns(manifest, required)
    if absent:
        raise KeyError(f"the manifest is missing columns: {', '.join(absent)}")
    path = F.col("bundle_dir")
    unsafe = path.isNull() | F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    empty = manifest.agg(F.count(F.lit(1)).alias("rows")).where("rows = 0")
    return together(
        duplicate_keys(manifest, ["sample_id"]),
        _violations(manifest.where(unsafe), "bundle_path", ["sample_id"], path),
        _violations(empty, "empty_manifest", ["rows"], "no samples"),
    )


def sheet_violations(sheet: DataFrame, base_path: str | None = None) -> DataFrame:
    """A sample sheet needs filled fields, unique samples and unique paths.

    The base object cannot be one of its own annotation sources.
    """
    required = ("sample_id", "condition", "input_path")
    absent = missing_columns(sheet, required)
    if absent:
        raise KeyError(f"the sample sheet is missing columns: {', '.join(absent)}")
    trimmed = sheet.select(*[F.trim(F.col(c)).alias(c) for c in required])
    empty = trimmed.agg(F.count(F.lit(1)).alias("rows")).where("rows = 0")
    checks = [
        label_violations(trimmed, required, blank=True),
        duplicate_keys(trimmed, ["sample_id"]),
        duplicate_keys(trimmed, ["input_path"]),
        _violations(empty, "empty_sheet", ["rows"], "no samples"),
    ]
    if base_path is not None:
        own = trimmed.where(F.col("input_path") == base_path)
        checks.append(_violations(own, "base_among_sources", ["sample_id"], F.col("input_path")))
    return together(*checks)


# The source formats a cohort can be read from.
SOURCE_FORMATS = ("bundle", "bundles", "xenium", "raw_xenium")


def source_list_violations(sources: DataFrame, default_format: str | None = None) -> DataFrame:
    """Configured samples need their keys, unique ids and a known format."""
    required = ("input_path", "sample_id", "condition")
    absent = missing_columns(sources, required)
    if absent:
        raise KeyError(f"the source list is missing columns: {', '.join(absent)}")
    given = F.col("input_format") if "input_format" in sources.columns else F.lit(None)
    chosen = sources.withColumn("format", F.lower(F.coalesce(given, F.lit(default_format))))
    unknown = chosen.where(F.col("format").isNull() | ~F.col("format").isin(*SOURCE_FORMATS))
    return together(
        label_violations(sources, required),
        duplicate_keys(sources, ["sample_id"]),
        _violations(unknown, "source_format", ["sample_id"], F.col("format")),
    )


def cardinality_violations(left: DataFrame, right: DataFrame, keys, relation: str = "many_to_one") -> DataFrame:
    """Keys that would break a ``one_to_one`` or ``many_to_one`` join."""
    if relation not in ("one_to_one", "many_to_one"):
        raise ValueError("relation must be 'one_to_one' or 'many_to_one'")
    found = duplicate_keys(right, keys).withColumn("check", F.lit("right_not_unique"))
    if relation == "one_to_one":
        found = found.unionByName(
            duplicate_keys(left, keys).withColumn("check", F.lit("left_not_unique"))
        )
    return found


def row_set_changes(before: DataFrame, after: DataFrame, keys=("sample_id", "cell_id")) -> DataFrame:
    """Keys lost or gained between two versions of a table, with multiplicity."""
    count = F.count(F.lit(1))
    a = before.groupBy(*keys).agg(count.alias("n_before"))
    b = after.groupBy(*keys).agg(count.alias("n_after"))
    joined = a.join(b, list(keys), "full").na.fill(0, ["n_before", "n_after"])
    told = F.concat_ws(" -> ", F.col("n_before").cast("string"), F.col("n_after").cast("string"))
    return _violations(joined.where("n_before <> n_after"), "row_set", keys, told)


def sample_count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Samples whose number of cells changed."""
    return row_set_changes(before, after, ["sample_id"]).withColumn("check", F.lit("sample_cells"))
