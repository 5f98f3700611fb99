"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written_table


def _are_stars(links: DataFrame) -> bool:
    """Whether each node either leads to one smaller node only or is led to only."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("led")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("led")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.max("e.led").alias("led"))
    return nodes.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("led") == 1))).isEmpty()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) of every node in `links` (a, b); the component is its smallest node.

    The steps keep the number of links at most as it was and end when all links are stars around
    their components' smallest nodes. Each is a grouped minimum and a join on the node, so no
    component meets in one task. What a step leaves is written in `files` files, if given.
    """
    links = links.select("a", "b").filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written_table(links, "llm-links", files)
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")
        # After the large star every link leads to a smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = written_table(small, "llm-links", files)
        drop_written(links.sparkSession, links)
        links = after
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
