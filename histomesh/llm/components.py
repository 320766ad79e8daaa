"""Connected components of a large edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import Scratch


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one node only, which itself points nowhere."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "links") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is its smallest node.

    Each step links the neighbours of a node to the smallest among them, first the larger
    ones, then the smaller ones, until all links are stars around the smallest. Minima combine
    before they are shuffled, so a node with a third of all links is no hot group. Loops and
    repeated links do no harm; an empty table gives an empty table. The result reads the table
    ``name`` of ``scratch``; those of earlier steps are removed.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.keep(name, links)
    while not _settled(links):
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = scratch.keep(name, small.union(least).toDF("u", "v").distinct())
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
