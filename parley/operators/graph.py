"""Connected components of a table of links by alternating large-star and small-star rounds.

Few rounds for any shape (logarithmic in the longest path); each is written to the folder that all executors share
(spark.checkpoint.dir), so lineage stays short and lost executors cost one round. A hub's links meet its least neighbour
by broadcast (`spread_join`), so no vertex, whatever its share of the links, puts them all in one task. Only counts
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.shared import drop, materialize, spread_join


def _stars(e: DataFrame, n: int) -> DataFrame:
    """One round: greater neighbours of each vertex to its least one (or itself), then all but the least to the least."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("r"), F.count(F.lit(1)).alias("n")), "roots")
    wide = materialize(spread_join(both.where("b > a"), root, ["a"], 2 * n, "n").select(F.col("b").alias("a"), F.col("r").alias("b")).distinct(), "large-star")
    least = materialize(wide.groupBy("a").agg(F.min("b").alias("r"), F.count(F.lit(1)).alias("n")), "roots")
    narrow = spread_join(wide, least, ["a"], n, "n").where("b <> r").select(F.col("b").alias("a"), F.col("r").alias("b"))
    out = materialize(narrow.unionByName(least.select("a", F.col("r").alias("b"))).distinct(), "links")
    for x in (root, wide, least):
        drop(x)
    return out


def _settled(e: DataFrame) -> bool:
    """Whether all links lead straight to a root: no vertex has two lesser neighbours, or one that has a lesser one."""
    above = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    roots = e.select("b").distinct().withColumnRenamed("b", "a")
    return above.where("n > 1").isEmpty() and e.select("a").distinct().join(roots, "a", "left_semi").isEmpty()


def connected(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """links: a, b -> node, component (its least node). nodes: node, also those without links."""
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(e):
        last, e = e, _stars(e, e.count())
        drop(last)
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    return _with(found, nodes)


def _with(found: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """found, or the components of the given nodes: those without links are their own."""
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
