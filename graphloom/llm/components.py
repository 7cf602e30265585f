"""Connected components of a table of links, by alternating stars.

Each round lets every node send its larger and then its smaller neighbours to
the least node near it, which keeps components and flattens them to stars in
few rounds.  Rounds end when the links are stars.  Links stay distributed;
every round is written to the shared folder, and the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none: then those are the roots."""
    if not links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.select(F.col("v").alias("u")).distinct().join(links.select("u"), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and root of every node with a link; ``links`` has u and v of one type, u <> v."""
    scratch = Scratch(links.sparkSession)
    links = scratch.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not _stars(links):
        links = scratch.written(_small_star(_large_star(links)), "links")
        scratch.drop_oldest("links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
