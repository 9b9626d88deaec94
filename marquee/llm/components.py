"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    each = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return not each.where("leaf + root > 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in the edges (a, b): the smallest id it can reach.

    Minima are partial aggregates and joins, so a hub's links are never gathered in one task.
    Each round is a written table. It ends when all edges form stars about their smallest ids.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        stars = written(small, "stars")
    found = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
