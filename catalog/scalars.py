"""Scalar expressions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.views import CELLS_E, CELLS_O, FEATURES_P, ENTRIES_L, MERGED_BASE, cells_e, cells_o, entries_l, features_p, merged_base, table
from histomesh.functions import ids
from histomesh.operators import roles
from histomesh.operators.align import cell_ids
from histomesh.operators.normalize import filter_features, select_features
from histomesh.sources.sinks import part_manifest


@query("p01_global_id", f"WITH {CELLS_O} SELECT sample_id || ':' || cell_id AS cell FROM cells_o")
def p01(spark, sf_dir):
    return cells_o(spark, sf_dir).select(ids.global_id().alias("cell"))


@query(
    "p02_stamp_source",
    f"""WITH {CELLS_O} SELECT sample_id, condition, cell_id FROM (
      SELECT 'whole' AS sample_id, 'merged' AS condition, cell_id FROM cells_o UNION ALL
      SELECT sample_id, condition, cell_id FROM cells_o)""",
)
def p02(spark, sf_dir):
    cells = cells_o(spark, sf_dir)
    single = roles.stamp_source(cells.select("cell_id"), "whole", "merged")
    sheet = cells.select("sample_id", "condition").distinct()
    multiple = roles.stamp_from_sheet(cells.select("sample_id", "cell_id"), sheet)
    return single.unionByName(multiple).select("sample_id", "condition", "cell_id")


@query(
    "p03_roles",
    """SELECT CAST(c_nationkey AS VARCHAR) AS sample_id, CAST(c_custkey AS VARCHAR) AS cell_id,
       c_mktsegment AS condition, c_name AS cell_type, round(c_acctbal, 6) AS c_acctbal FROM customer""",
)
def p03(spark, sf_dir):
    bound = roles.Roles(
        sample_id="c_nationkey", cell_id="c_custkey", condition="c_mktsegment", cell_type="c_name", compartment=None
    )
    return rounded(roles.bind_roles(table(spark, sf_dir, "customer"), bound))


@query(
    "p04_coordinates",
    f"""WITH {CELLS_O} SELECT cell_id, x + 1 AS x, y + 1 AS y FROM cells_o""",
)
def p04(spark, sf_dir):
    several = cells_o(spark, sf_dir).select(
        "cell_id", "x", "y", (F.col("x") + 1).alias("centroid_x"), (F.col("y") + 1).alias("centroid_y"),
        F.col("x").alias("x_centroid"),
    )
    return roles.with_coordinates(several).select("cell_id", "x", "y")


@query(
    "p05_feature_filter",
    f"""WITH {ENTRIES_L}, {FEATURES_P} SELECT e.sample_id, e.cell_id, e.part AS gene, e.n,
        coalesce(f.feature_id, f.gene) AS feature_id, f.feature_type
        FROM entries_l e JOIN features_p f ON e.part = f.gene WHERE f.feature_type = 'PROMO'""",
)
def p05(spark, sf_dir):
    counts = entries_l(spark, sf_dir).select("sample_id", "cell_id", F.col("part").alias("gene"), "n")
    return filter_features(counts, features_p(spark, sf_dir), "PROMO").select(
        "sample_id", "cell_id", "gene", "n", "feature_id", "feature_type"
    )


@query(
    "p05_features",
    f"""WITH {FEATURES_P} SELECT gene, coalesce(feature_id, gene) AS feature_id, feature_type
        FROM features_p WHERE feature_type = 'ECONOMY'""",
)
def p05_features(spark, sf_dir):
    return select_features(features_p(spark, sf_dir), "ECONOMY")


@query(
    "p06_embedding_array",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS cell_id,
       round(l_quantity, 6) AS first, round(l_tax, 6) AS last, CAST(3 AS BIGINT) AS size FROM lineitem""",
)
def p06(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_id"),
        "l_quantity", "l_returnflag", "l_discount", "l_tax",
    )
    vectors = roles.embedding_array(items)
    return rounded(
        vectors.select(
            "cell_id",
            F.get("embedding", F.lit(0)).alias("first"),
            F.get("embedding", F.lit(2)).alias("last"),
            F.size("embedding").alias("size"),
        )
    )


@query(
    "p07_joined_list",
    """SELECT CAST(doc_id AS VARCHAR) AS cell_id, array_to_string(string_split(text, ' '), ';') AS words FROM documents""",
)
def p07(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("cell_id"), F.split("text", " ").alias("list")
    )
    return words.select("cell_id", ids.joined_list("list").alias("words"))


@query(
    "p08_cell_ids",
    f"""WITH {CELLS_O} SELECT cell_id, sample_id FROM cells_o UNION ALL
        SELECT sample_id || ':' || cell_id AS cell_id, sample_id FROM cells_o""",
)
def p08(spark, sf_dir):
    cells = cells_o(spark, sf_dir).select("sample_id", "cell_id", ids.global_id().alias("cell_name"))
    own = cell_ids(cells).select("cell_id", "sample_id")
    named = cell_ids(cells.drop("cell_id")).select("cell_id", "sample_id")
    return own.unionByName(named)


@query(
    "p09_blank",
    """SELECT source, lang, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank,
       count(*) AS total FROM documents GROUP BY source, lang""",
)
def p09(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return rounded(
        documents.groupBy("source", "lang").agg(
            F.count_if(ids.is_blank("text")).alias("blank"), F.count(F.lit(1)).alias("total")
        )
    )


@query(
    "p10_after_colon",
    """SELECT CAST(doc_id AS VARCHAR) AS cell_id,
       CASE WHEN instr(text, ':') > 0 THEN substr(text, instr(text, ':') + 1) ELSE '' END AS rest FROM documents""",
)
def p10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("cell_id"), ids.after_colon("text").alias("rest")
    )


@query(
    "p11_null_as_empty",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer, coalesce(o_orderpriority, '') AS priority
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def p11(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left"
    )
    return joined.select(ids.text("c_custkey").alias("customer"), ids.text("o_orderpriority").alias("priority"))


@query(
    "p12_without_suffix",
    f"""WITH {MERGED_BASE} SELECT cell_id, regexp_replace(cell_id, '(_[0-9]+)+$', '') AS stripped FROM merged_base""",
)
def p12(spark, sf_dir):
    return merged_base(spark, sf_dir).select("cell_id", ids.without_merge_suffix("cell_id").alias("stripped"))


@query(
    "p13_suffix_depth",
    f"""WITH {MERGED_BASE} SELECT cell_id,
        len(string_split(regexp_extract(cell_id, '(_[0-9]+)+$'), '_')) - 1 AS depth FROM merged_base""",
)
def p13(spark, sf_dir):
    return rounded(merged_base(spark, sf_dir).select("cell_id", ids.merge_depth("cell_id").alias("depth")))


@query(
    "p14_part_names",
    f"""WITH {CELLS_E} SELECT sample_id, condition, printf('part=sample_%04d', row_number() OVER (ORDER BY sample_id)) AS bundle_dir,
        n_cells FROM (SELECT sample_id, condition, count(*) AS n_cells FROM cells_e GROUP BY ALL)""",
)
def p14(spark, sf_dir):
    return rounded(part_manifest(cells_e(spark, sf_dir)))
