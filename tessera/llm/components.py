"""Connected components of a link table, by alternating large and small stars.

Only joins and aggregates with partial sums run; no group of neighbours is gathered anywhere, and no side of a join in the driver,
however few its rows: a broadcast would cost it a hash table and the tasks of one job more for each join. Tables written to the shared
folder cut the lineage after each round. The rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least.hint("merge"), "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))


def _stars_only(edges: DataFrame) -> bool:
    """Whether each larger end has one link and is nobody's smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """From links (u long, v long) to (node, component): a component is named by its smallest node; nodes without links are left out."""
    held = work.write(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars_only(held):
        new = work.write(_star(_star(held, True), False).distinct(), "stars")
        work.drop(held)
        held = new
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
