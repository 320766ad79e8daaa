"""Validation rules (Q1-Q12) over data that breaks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import CELLS_O, MERGED_BASE, cells_o, table
from histomesh.operators import checks as q

Q1_VALUE = """CASE l_returnflag WHEN 'A' THEN l_quantity - 40 WHEN 'R' THEN l_quantity * 100000000
  ELSE l_extendedprice END"""


@query(
    "q01_counts",
    f"""WITH v AS (SELECT *, {Q1_VALUE} AS v FROM lineitem),
      b AS (SELECT *, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) OR v < 0 THEN 'finite_nonnegative'
                           WHEN v > 2147483647 THEN 'storage_range' WHEN v <> floor(v) THEN 'whole_number' END AS broken FROM v)
      SELECT broken AS "check", CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS "key"
      FROM b WHERE broken IS NOT NULL""",
)
def q01(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").withColumn("v", F.expr(Q1_VALUE))
    return q.count_violations(values, ["l_orderkey", "l_linenumber"], "v").select("check", "key")


@query(
    "q01_counts_tolerance",
    f"""WITH v AS (SELECT *, {Q1_VALUE} AS v FROM lineitem)
      SELECT count(*) FILTER (v < 0) AS negative, count(*) FILTER (v > 2147483647) AS too_large,
             count(*) FILTER (v BETWEEN 0 AND 2147483647 AND abs(v - round(v)) > 0.25) AS fractional FROM v""",
)
def q01_tolerance(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").withColumn("v", F.expr(Q1_VALUE))
    found = q.count_violations(values, ["l_orderkey", "l_linenumber"], "v", tol=0.25)
    return rounded(
        found.agg(
            F.count_if(F.col("check") == "finite_nonnegative").alias("negative"),
            F.count_if(F.col("check") == "storage_range").alias("too_large"),
            F.count_if(F.col("check") == "whole_number").alias("fractional"),
        )
    )


@query(
    "q02_dimensions",
    """WITH m AS (SELECT p_brand AS bundle, p_size AS gene_ix, CAST(l_quantity AS BIGINT) AS cell_ix
                  FROM lineitem JOIN part ON l_partkey = p_partkey),
      s AS (SELECT p_brand AS bundle, count(DISTINCT p_size) AS n_genes, count(*) AS n_cells FROM part GROUP BY 1),
      g AS (SELECT p_brand AS bundle, count(DISTINCT p_type) AS genes, count(*) AS cells FROM part GROUP BY 1),
      r AS (SELECT bundle, min(least(gene_ix, cell_ix)) AS low, max(gene_ix) AS tg, max(cell_ix) AS tc FROM m GROUP BY 1),
      j AS (SELECT * FROM s JOIN g USING (bundle) LEFT JOIN r USING (bundle))
    SELECT 'gene_dictionary' AS "check", bundle AS "key" FROM j WHERE genes <> n_genes UNION ALL
    SELECT 'cell_dictionary', bundle FROM j WHERE cells <> n_cells UNION ALL
    SELECT 'index_range', bundle FROM j WHERE low < 1 OR tg > n_genes OR tc > n_cells""",
)
def q02(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("bundle", F.col("p_brand"))
    items = table(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey"))
    triplets = items.select(
        "bundle", F.col("p_size").alias("gene_ix"), F.col("l_quantity").cast("bigint").alias("cell_ix")
    )
    sizes = part.groupBy("bundle").agg(
        F.count_distinct("p_size").alias("n_genes"), F.count(F.lit(1)).alias("n_cells")
    )
    genes = part.select("bundle", "p_type").distinct()
    return q.dimension_violations(triplets, genes, part.select("bundle", "p_name"), sizes).select("check", "key")


@query(
    "q03_duplicates",
    """SELECT 'duplicate_key' AS "check", CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS "key",
       CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
)
def q03(spark, sf_dir):
    return q.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "q04_labels",
    """WITH j AS (SELECT o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS priority,
                         CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE c_name END AS c_name
                  FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
      n AS (SELECT 'o_orderstatus' AS "key", count(*) FILTER (o_orderstatus IS NULL OR trim(o_orderstatus) = '') AS n FROM j UNION ALL
            SELECT 'priority', count(*) FILTER (priority IS NULL OR trim(priority) = '') FROM j UNION ALL
            SELECT 'c_name', count(*) FILTER (c_name IS NULL OR trim(c_name) = '') FROM j)
    SELECT 'missing_label' AS "check", "key", CAST(n AS VARCHAR) AS detail FROM n WHERE n > 0""",
)
def q04(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left"
    )
    labels = joined.select(
        "o_orderstatus",
        F.expr("nullif(o_orderpriority, '1-URGENT')").alias("priority"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE c_name END").alias("c_name"),
    )
    return q.label_violations(labels, ["o_orderstatus", "priority", "c_name"], blank=True)


@query(
    "q05_coordinates",
    """SELECT 'coordinates' AS "check", CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS "key"
       FROM lineitem WHERE l_discount = 0 OR l_tax = 0 OR l_returnflag = 'R'""",
)
def q05(spark, sf_dir):
    placed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.expr("CASE WHEN l_returnflag = 'R' THEN CAST('NaN' AS DOUBLE) ELSE l_quantity / nullif(l_discount, 0) END").alias("x"),
        F.expr("CASE WHEN l_tax = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END").alias("y"),
    )
    return q.coordinate_violations(placed, keys=["l_orderkey", "l_linenumber"]).select("check", "key")


@query(
    "q06_conditions",
    """SELECT 'one_condition' AS "check", c_mktsegment AS "key", CAST(count(DISTINCT r_name) AS VARCHAR) AS detail
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY c_mktsegment HAVING count(DISTINCT r_name) <> 1""",
)
def q06(spark, sf_dir):
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return q.condition_conflicts(
        customers.select(F.col("c_mktsegment").alias("sample_id"), F.col("r_name").alias("condition"))
    )


@query(
    "q07_source_purity",
    f"""WITH {CELLS_O}, m AS (
        SELECT n_name AS source_id, n_name AS sample_id, CASE WHEN r_name = 'ASIA' THEN 'EUROPE' ELSE r_name END AS condition,
               (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_cells
        FROM nation JOIN region ON n_regionkey = r_regionkey),
      s AS (SELECT sample_id AS source_id, min(condition) AS lc, max(condition) AS hc, count(*) AS n FROM cells_o GROUP BY 1),
      j AS (SELECT * FROM m FULL JOIN s USING (source_id))
    SELECT 'source_condition' AS "check", source_id AS "key" FROM j
      WHERE lc IS DISTINCT FROM condition OR hc IS DISTINCT FROM condition UNION ALL
    SELECT 'source_cells', source_id FROM j WHERE n IS DISTINCT FROM n_cells""",
)
def q07(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    )
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_cells"))
    manifest = nations.join(sizes, F.expr("c_nationkey = n_nationkey"), "left").select(
        F.col("n_name").alias("source_id"),
        F.col("n_name").alias("sample_id"),
        F.expr("CASE WHEN r_name = 'ASIA' THEN 'EUROPE' ELSE r_name END").alias("condition"),
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
    )
    cells = cells_o(spark, sf_dir).withColumn("source_id", F.col("sample_id"))
    return q.source_mismatches(cells, manifest).select("check", "key")


Q8_PATH = """CASE r_name WHEN 'ASIA' THEN concat('/data/', n_name) WHEN 'AFRICA' THEN concat('a/../', n_name)
  ELSE concat('parts/', n_name) END"""


@query(
    "q08_manifest",
    f"""WITH m AS (SELECT CASE WHEN r_name = 'EUROPE' THEN r_name ELSE n_name END AS sample_id, {Q8_PATH} AS bundle_dir
                   FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'duplicate_key' AS "check", sample_id AS "key", CAST(count(*) AS VARCHAR) AS detail
      FROM m GROUP BY sample_id HAVING count(*) > 1 UNION ALL
    SELECT 'bundle_path', sample_id, bundle_dir FROM m
      WHERE starts_with(bundle_dir, '/') OR list_contains(string_split(bundle_dir, '/'), '..')""",
)
def q08(spark, sf_dir):
    manifest = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .select(
            F.expr("CASE WHEN r_name = 'EUROPE' THEN r_name ELSE n_name END").alias("sample_id"),
            F.col("r_name").alias("condition"),
            F.expr(Q8_PATH).alias("bundle_dir"),
            F.col("n_nationkey").alias("n_cells"),
        )
    )
    return q.manifest_violations(manifest)


@query(
    "q09_sample_sheet",
    """WITH s AS (SELECT trim(c_mktsegment) AS sample_id, trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END) AS condition,
                         trim(c_name) AS input_path FROM customer)
    SELECT 'missing_label' AS "check", 'condition' AS "key", CAST(count(*) AS VARCHAR) AS detail
      FROM s WHERE condition = '' HAVING count(*) > 0 UNION ALL
    SELECT 'duplicate_key', sample_id, CAST(count(*) AS VARCHAR) FROM s GROUP BY sample_id HAVING count(*) > 1 UNION ALL
    SELECT 'duplicate_key', input_path, CAST(count(*) AS VARCHAR) FROM s GROUP BY input_path HAVING count(*) > 1 UNION ALL
    SELECT 'base_among_sources', sample_id, input_path FROM s WHERE input_path = (SELECT min(c_name) FROM customer)""",
)
def q09(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    base = customers.selectExpr("min(c_name)").first()[0]
    sheet = customers.select(
        F.concat(F.lit(" "), "c_mktsegment").alias("sample_id"),
        F.expr("CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END").alias("condition"),
        F.concat("c_name", F.lit(" ")).alias("input_path"),
    )
    return q.sheet_violations(sheet, base)


@query(
    "q09_source_list",
    """WITH s AS (SELECT n_name AS sample_id, CASE WHEN r_name = 'ASIA' THEN 'notes' WHEN r_name = 'AFRICA' THEN 'Bundle' END AS fmt
                  FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'source_format' AS "check", sample_id AS "key", lower(fmt) AS detail FROM s
      WHERE coalesce(lower(fmt), 'xenium') NOT IN ('bundle', 'bundles', 'xenium', 'raw_xenium')""",
)
def q09_sources(spark, sf_dir):
    sources = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .select(
            F.col("n_name").alias("sample_id"),
            F.col("r_name").alias("condition"),
            F.col("n_name").alias("input_path"),
            F.expr("CASE WHEN r_name = 'ASIA' THEN 'notes' WHEN r_name = 'AFRICA' THEN 'Bundle' END").alias("input_format"),
        )
    )
    return q.source_list_violations(sources, "xenium")


@query(
    "q10_cardinality",
    """SELECT 'right_not_unique' AS "check", CAST(o_custkey AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail
         FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL
       SELECT 'left_not_unique', CAST(o_custkey AS VARCHAR), CAST(count(*) AS VARCHAR)
         FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(*) > 1""",
)
def q10(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").join(orders, F.expr("o_orderkey = l_orderkey"))
    return q.cardinality_violations(items, orders, ["o_custkey"], "one_to_one")


@query(
    "q12_row_set",
    f"""WITH {CELLS_O}, i AS (SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, count(*) AS n_after FROM lineitem GROUP BY 1)
    SELECT 'row_set' AS "check", cell_id AS "key",
           '1 -> ' || CAST(coalesce(n_after, 0) AS VARCHAR) AS detail
    FROM cells_o LEFT JOIN i USING (cell_id) WHERE coalesce(n_after, 0) <> 1""",
)
def q12(spark, sf_dir):
    after = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("cell_id"))
    return q.row_set_changes(cells_o(spark, sf_dir), after, ["cell_id"])


@query(
    "q12_sample_counts",
    f"""WITH {MERGED_BASE}, a AS (SELECT sample_id, count(*) AS n FROM cells_o GROUP BY 1),
      b AS (SELECT sample_id, count(*) AS m FROM merged_base WHERE quality > 500 GROUP BY 1)
    SELECT 'sample_cells' AS "check", sample_id AS "key",
           CAST(n AS VARCHAR) || ' -> ' || CAST(coalesce(m, 0) AS VARCHAR) AS detail
    FROM a LEFT JOIN b USING (sample_id) WHERE n <> coalesce(m, 0)""",
)
def q12_counts(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    return q.sample_count_changes(cells, cells.where("x + y > 500"))
