"""Registered queries against their SQL twins.

A quick selection runs by default; ``CATALOG=all`` compares every query.
"""

import math
import os

import pytest

import __spark_entry__ as repo
from catalog import registry

DATA = "/root/testdata/sf0.001"
ROWS_ONLY = {"g03_delaunay_orders", "m03_representation"}
QUICK = (
    "a01_domain_abundance", "a07_abundance", "a14_neighbor_summary", "d07_coordinates", "d09_count_diff",
    "g01_knn", "g02_radius", "g03_delaunay", "j03_cohort_genes_outer", "j05_recovery", "k03_stability",
    "m01_log_norm", "m03_expression_itself", "p13_suffix_depth", "q01_counts", "u03_gene_sets",
)
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(rows, columns):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_a_twin_or_a_reason():
    assert set(registry.SQL) | ROWS_ONLY == set(registry.QUERIES)
    assert not set(registry.SQL) & ROWS_ONLY
    assert set(registry.QUERIES) <= set(repo.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL) if os.environ.get("CATALOG") == "all" else QUICK)
def test_query_matches_its_twin(spark, name):
    import duckdb

    connection = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    twin = connection.execute(repo.oracle_sql()[name])
    columns = [d[0] for d in twin.description]
    result = repo.queries()[name](spark, DATA)
    assert sorted(result.columns) == sorted(columns)
    assert plain(result.collect(), result.columns) == plain(twin.fetchall(), columns)


@needs_data
def test_entry_runs(spark):
    assert repo.entry(spark).count() > 0
