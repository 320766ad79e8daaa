"""Writing cohorts, bundles, result tables and manifests.

Nothing here replaces existing output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import Scratch, few, spread
from histomesh.operators.composition import design_table

# Fixed value: first line of a matrix text file with whole numbers.
MATRIX_HEADER = "%%MatrixMarket matrix coordinate integer general"


def _dealt(df: DataFrame, key: str, rows_per_file: int = 2_000_000) -> DataFrame:
    """Rows dealt out so that a value of ``key`` fills as many files as its size asks for.

    A row's file follows from its cell, and gene if it has one, so a task that is run again
    deals the same rows to the same files.
    """
    files = df.groupBy(F.col(key).alias("of")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("files"))
    placed = df.join(files, F.col(key).eqNullSafe(F.col("of")))
    identity = [c for c in ("cell_id", "gene") if c in df.columns] or df.columns
    return placed.repartition(key, F.pmod(F.xxhash64(*identity), F.col("files"))).drop("of", "files")


def write_by_sample(df: DataFrame, path: str) -> None:
    """Parquet with one folder per sample, for pruning by sample."""
    _dealt(df, "sample_id").write.mode("errorifexists").partitionBy("sample_id").parquet(path)


def write_parts(df: DataFrame, manifest: DataFrame, path: str) -> None:
    """Parquet in the folders that the manifest names, one per sample."""
    part = F.regexp_replace("bundle_dir", "^part=", "").alias("part")
    placed = df.join(manifest.select("sample_id", part), "sample_id")
    _dealt(placed, "part").write.mode("errorifexists").partitionBy("part").parquet(path)


def part_manifest(cells: DataFrame) -> DataFrame:
    """Samples in order with deterministic part folders and their cell counts.

    The order is over one row per sample, as in a sample sheet, never over cells.
    """
    design = design_table(cells)
    place = F.row_number().over(Window.orderBy("sample_id", "condition"))
    return design.select(
        "sample_id",
        "condition",
        F.format_string("part=sample_%04d", place).alias("bundle_dir"),
        "n_cells",
    )


def write_results(df: DataFrame, path: str) -> None:
    """A tidy result table as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Facts about a run as JSON lines."""
    df.write.mode("errorifexists").json(path)


#: Opening and closing a file takes a task about as long as this many rows.
ROWS_A_FILE = 25_000


def _by_bundle(df: DataFrame, rows: int, bundles: int) -> DataFrame:
    """``df`` with each of its ``bundles`` in one part: parts are bounded by rows and by the files that a task opens."""
    keys = ["shard", "sample_id"]
    return spread(df.repartition(*keys), rows + ROWS_A_FILE * bundles, *keys)


def _write_lines(lines: DataFrame, rows: int, bundles: int, path: str) -> None:
    """Text files in line order, one per bundle; about ``rows`` lines in all."""
    folders = ["shard", "sample_id"]
    (
        _by_bundle(lines, rows, bundles)
        .sortWithinPartitions(*folders, "place")
        .select(*folders, "value")
        .write.mode("errorifexists")
        .partitionBy(*folders)
        .option("compression", "gzip")
        .text(path)
    )


def _numbered(names: DataFrame, name: str) -> DataFrame:
    """Names of each bundle, numbered from one in name order."""
    order = Window.partitionBy("shard", "sample_id").orderBy(name)
    return names.withColumn("place", F.row_number().over(order))


def write_bundles(cells: DataFrame, counts: DataFrame, genes: DataFrame, path: str, cells_per_bundle: int = 50_000) -> None:
    """Matrix text bundles: ``counts``, ``genes``, ``barcodes``, ``obs`` and ``spatial``.

    A sample becomes as many bundles as its size asks for, each with about
    ``cells_per_bundle`` cells and its own dictionaries, so neither numbering nor
    writing brings a whole sample into one task. Ids and types of genes are written beside their names.
    Cells and placed counts are computed once and kept in the shared folder until all is written.
    """
    scratch, keys = Scratch(cells.sparkSession), ["shard", "sample_id"]
    cells = scratch.keep("cells", cells)
    shards = cells.groupBy("sample_id").agg(
        F.ceil(F.count(F.lit(1)) / cells_per_bundle).alias("shards")
    )
    shard = F.pmod(F.xxhash64("cell_id"), F.col("shards")).alias("shard")
    members = cells.join(shards, "sample_id").select("*", shard).drop("shards")
    barcodes = scratch.keep("barcodes", _numbered(members.select(*keys, "cell_id"), "cell_id"))
    used = shards.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    told = [c for c in ("feature_id", "feature_type") if c in genes.columns]
    listed = genes.select("sample_id", "gene", *told).distinct()
    panel = scratch.keep("panel", _numbered(used.join(listed, "sample_id"), "gene"))

    n_cells, n_listed, bundles = barcodes.count(), panel.count(), used.count()
    named = spread(barcodes, n_cells, "sample_id", "cell_id").withColumnRenamed("place", "cell_ix")
    placed = scratch.keep(
        "placed", counts.where("n <> 0").join(named, ["sample_id", "cell_id"]).select(*keys, "gene", "cell_ix", "n")
    )
    entries = placed.join(few(panel.withColumnRenamed("place", "gene_ix"), n_listed), [*keys, "gene"])
    total = F.count(F.lit(1))
    sizes = (
        barcodes.groupBy(*keys)
        .agg(total.alias("cells"))
        .join(panel.groupBy(*keys).agg(total.alias("genes")), keys)
        .join(placed.groupBy(*keys).agg(total.alias("entries")), keys, "left")
    )
    size_line = F.concat_ws(" ", "genes", "cells", F.coalesce("entries", F.lit(0)))
    heads = sizes.select(
        *keys, F.posexplode(F.array(F.lit(MATRIX_HEADER), size_line)).alias("place", "value")
    )
    body = entries.select(
        *keys,
        F.lit(2).alias("place"),
        F.concat_ws(" ", "gene_ix", "cell_ix", F.col("n").cast("long")).alias("value"),
    )
    _write_lines(heads.unionByName(body), placed.count(), bundles, f"{path}/counts")
    fields = [F.coalesce(F.col(c), F.lit("")) for c in told]
    _write_lines(panel.withColumn("value", F.concat_ws("\t", "gene", *fields)), n_listed, bundles, f"{path}/genes")
    _write_lines(barcodes.withColumnRenamed("cell_id", "value"), n_cells, bundles, f"{path}/barcodes")

    options = {"header": True, "compression": "gzip", "escape": '"'}
    for table, folder in (
        (members.drop("x", "y"), "obs"),
        (members.select(*keys, "cell_id", "x", "y"), "spatial"),
    ):
        _by_bundle(table, n_cells, bundles).write.mode("errorifexists").partitionBy(*keys).options(**options).csv(f"{path}/{folder}")
    scratch.drop(*list(scratch.paths))
