"""Scans and sinks (S1-S10), each as a round trip through files Spark writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.composition import ABUNDANCE, ABUNDANCE_COLUMNS, SUMMARY_COLUMNS, NEIGHBORS, summary
from catalog.registry import query, rounded
from catalog.views import CELLS_O, COUNTS_L, cells_o, counts_l, listed_genes, table
from histomesh.lineage import Scratch, scratch_path
from histomesh.operators.checks import dimension_violations
from histomesh.operators.composition import compartment_abundance
from histomesh.operators.review import cohort_profile
from histomesh.operators.roles import with_coordinates
from histomesh.plans.cohort import build_cohort
from histomesh.sources import scans, sinks


def bundles(spark, sf_dir) -> str:
    """Counts and cells of the first cohort as text bundles."""
    path, scratch = scratch_path(spark, "bundles"), Scratch(spark)
    counts = scratch.keep("counts", counts_l(spark, sf_dir))
    sinks.write_bundles(cells_o(spark, sf_dir), counts, listed_genes(counts), path, cells_per_bundle=5_000)
    scratch.drop("counts")
    return path


LISTED = f"{COUNTS_L}, listed AS (SELECT DISTINCT sample_id, gene FROM counts_l)"


@query("s01_triplets", f"WITH {COUNTS_L} SELECT sample_id, cell_id, gene, n FROM counts_l")
def s01(spark, sf_dir):
    path = bundles(spark, sf_dir)
    triplets, sizes = scans.read_triplets(spark, f"{path}/counts")
    genes = scans.read_dictionary(spark, f"{path}/genes")
    cells = scans.read_dictionary(spark, f"{path}/barcodes")
    named = scans.named_counts(triplets, genes, cells)
    return named.select("sample_id", "cell_id", "gene", F.col("n").cast("bigint").alias("n"))


@query(
    "s01_sizes",
    f"""WITH {LISTED} SELECT sample_id, n_genes, n_cells, n_entries, CAST(0 AS BIGINT) AS violations
        FROM (SELECT sample_id, count(*) AS n_entries FROM counts_l GROUP BY 1)
        JOIN (SELECT sample_id, count(*) AS n_genes FROM listed GROUP BY 1) USING (sample_id)
        JOIN (SELECT sample_id, count(*) AS n_cells FROM cells_o GROUP BY 1) USING (sample_id)""",
)
def s01_sizes(spark, sf_dir):
    path = bundles(spark, sf_dir)
    entries, sizes = scans.read_entries(spark, f"{path}/counts")
    genes = scans.read_dictionary(spark, f"{path}/genes")
    cells = scans.read_dictionary(spark, f"{path}/barcodes")
    found = dimension_violations(entries, genes, cells, sizes).select(F.count(F.lit(1))).scalar()
    return rounded(
        sizes.groupBy("sample_id")
        .agg(
            F.max("n_genes").alias("n_genes"),
            F.sum("n_cells").alias("n_cells"),
            F.sum("n_entries").alias("n_entries"),
        )
        .withColumn("violations", found)
    )


@query(
    "s11_build_cohort",
    f"""WITH {LISTED}, totals AS (SELECT sample_id, cell_id, sum(n) AS total FROM counts_l GROUP BY ALL),
      kept AS (SELECT gene FROM listed GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM listed))
    SELECT sample_id, cell_id, gene, CAST(n AS BIGINT) AS n, round(ln(1 + n * 1e4 / total), 6) AS x
    FROM counts_l JOIN totals USING (sample_id, cell_id) WHERE gene IN (FROM kept)""",
)
def s11(spark, sf_dir):
    """The whole ingest: bundles read, checked, normalised and joined over their genes."""
    path = bundles(spark, sf_dir)
    files = {name: f"{path}/{name}" for name in ("counts", "genes", "barcodes", "obs", "spatial")}
    built = build_cohort(spark, files)
    return rounded(built["expression"].select("sample_id", "cell_id", "gene", "n", "x"))


@query(
    "s11_checked_cohort",
    f"""WITH {COUNTS_L}, typed AS (SELECT * FROM counts_l WHERE CAST(right(gene, 1) AS INTEGER) % 2 = 1),
      listed AS (SELECT DISTINCT sample_id, gene FROM typed),
      totals AS (SELECT sample_id, cell_id, sum(n) AS total FROM typed GROUP BY ALL)
    SELECT sample_id, cell_id, gene, CAST(n AS BIGINT) AS n, round(ln(1 + n * 1e4 / total), 6) AS x,
      'id of ' || gene AS feature_id, round(c.x, 6) AS cell_x, round(c.y, 6) AS cell_y
    FROM typed JOIN totals USING (sample_id, cell_id) JOIN cells_o c USING (sample_id, cell_id)""",
)
def s11_checked(spark, sf_dir):
    """The ingest with a manifest, features of one type, and coordinates from the first complete table."""
    path = scratch_path(spark, "bundles")
    cells, counts = cells_o(spark, sf_dir), counts_l(spark, sf_dir)
    odd = F.substring("gene", -1, 1).cast("int") % 2 == 1
    typed = listed_genes(counts).withColumns({
        "feature_id": F.concat(F.lit("id of "), "gene"),
        "feature_type": F.when(odd, "Gene Expression").otherwise("Control"),
    })
    sinks.write_bundles(cells, counts, typed, path, cells_per_bundle=5_000)
    files = {name: f"{path}/{name}" for name in ("counts", "genes", "barcodes", "obs")}
    built = build_cohort(
        spark, files | {"spatial": [f"{path}/obs", f"{path}/spatial"]}, join="outer",
        manifest=sinks.part_manifest(cells), kind="Gene Expression",
    )
    placed = built["cells"].select("sample_id", "cell_id", F.col("x").alias("cell_x"), F.col("y").alias("cell_y"))
    named = built["expression"].join(placed, ["sample_id", "cell_id"]).join(built["features"], "gene")
    return rounded(named.select("sample_id", "cell_id", "gene", "n", "x", "feature_id", "cell_x", "cell_y"))


@query(
    "s02_dictionary",
    f"""WITH {LISTED} SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY gene) - 1 AS BIGINT) AS position,
        gene AS name FROM listed""",
)
def s02(spark, sf_dir):
    genes = scans.read_dictionary(spark, f"{bundles(spark, sf_dir)}/genes")
    return rounded(genes.select("sample_id", "position", "name").distinct())


@query(
    "s03_metadata",
    f"""WITH {CELLS_O} SELECT sample_id, cell_id, condition, cell_type, compartment FROM cells_o UNION ALL
        SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), 'parquet', 'nation' FROM nation""",
)
def s03(spark, sf_dir):
    text = scans.read_sample_metadata(spark, f"{bundles(spark, sf_dir)}/obs")
    path = scratch_path(spark, "table") + ".parquet"
    table(spark, sf_dir, "nation").write.parquet(path)
    binary = scans.read_metadata(spark, path).select(
        F.col("n_nationkey").cast("string").alias("sample_id"),
        F.col("n_name").alias("cell_id"),
        F.col("n_regionkey").cast("string").alias("condition"),
        F.lit("parquet").alias("cell_type"),
        F.lit("nation").alias("compartment"),
    )
    return text.select("sample_id", "cell_id", "condition", "cell_type", "compartment").unionByName(binary)


@query("s03_coordinates", f"WITH {CELLS_O} SELECT sample_id, cell_id, round(x, 6) AS x, round(y, 6) AS y FROM cells_o")
def s03_coordinates(spark, sf_dir):
    placed = scans.read_sample_metadata(spark, f"{bundles(spark, sf_dir)}/spatial")
    return rounded(with_coordinates(placed).select("sample_id", "cell_id", "x", "y"))


@query(
    "s05_sample_sheet",
    f"""WITH {CELLS_O} SELECT DISTINCT sample_id, condition, '"' || sample_id || '"' AS input_path FROM cells_o""",
)
def s05(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    sheet = cells_o(spark, sf_dir).select("sample_id", "condition").distinct()
    quoted = sheet.withColumn("input_path", F.concat(F.lit('"'), "sample_id", F.lit('"')))
    quoted.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return scans.read_sheet(spark, path)


@query(
    "s06_split_by_sample",
    f"""WITH {CELLS_O}, m AS (SELECT sample_id, condition, printf('part=sample_%04d', row_number() OVER (ORDER BY sample_id)) AS bundle_dir,
          count(*) AS n_cells FROM cells_o GROUP BY sample_id, condition)
        SELECT m.*, n_cells AS stored FROM m""",
)
def s06(spark, sf_dir):
    path = scratch_path(spark, "by-sample")
    cells = cells_o(spark, sf_dir)
    manifest = sinks.part_manifest(cells)
    sinks.write_parts(cells, manifest, path)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("bundle_dir")
    stored = spark.read.parquet(path).groupBy("sample_id", folder).agg(F.count(F.lit(1)).alias("stored"))
    return rounded(manifest.join(stored, ["sample_id", "bundle_dir"]))


@query("s07_tidy_table", f"WITH {ABUNDANCE} SELECT {ABUNDANCE_COLUMNS} FROM abundance")
def s07(spark, sf_dir):
    path = scratch_path(spark, "abundance")
    sinks.write_results(compartment_abundance(cells_o(spark, sf_dir)), path)
    return rounded(scans.read_results(spark, path, scans.ABUNDANCE_SCHEMA))


@query("s09_typed_reload", f"WITH {NEIGHBORS} SELECT {SUMMARY_COLUMNS} FROM summary")
def s09(spark, sf_dir):
    path = scratch_path(spark, "summary")
    sinks.write_results(summary(spark, sf_dir), path)
    return rounded(scans.read_results(spark, path, scans.SUMMARY_SCHEMA))


@query(
    "s10_manifest",
    f"""WITH {COUNTS_L} SELECT 'cells' AS fact, '' AS label, count(*) AS n FROM cells_o
      UNION ALL SELECT 'sample', sample_id, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'condition', condition, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'compartment', compartment, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'cell_type', cell_type, count(*) FROM cells_o GROUP BY 2
      UNION ALL SELECT 'genes', '', count(DISTINCT gene) FROM counts_l""",
)
def s10(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(cohort_profile(cells_o(spark, sf_dir), counts_l(spark, sf_dir)), path)
    return spark.read.schema("fact string, label string, n bigint").json(path)
