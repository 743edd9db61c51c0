"""Connected components by alternating stars, on tables alone.

A large star links the larger neighbours of every node to its least neighbour, a small star does so with the
smaller ones; they alternate until every node hangs on its component's least.  Least neighbours are found by an
aggregation that combines before the shuffle, so a node with very many links costs what others do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.llm.frames import small
from gavelstat.workspace import release


def components(links: DataFrame) -> DataFrame:
    """``links`` has bigint columns a and b; the result gives each node with a link its component's least node."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = small(links, "links")
    while not _are_stars(links):
        old, links = links, small(_small_star(_large_star(links)), "links")
        release(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which has none itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """After a large star a node has one smaller neighbour for each of its own neighbours at most."""
    met = links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    pairs = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return met.select(pairs.alias("pair")).select("pair.*").filter("a <> b").distinct()
