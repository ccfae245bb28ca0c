"""Connected components of a link table by alternating star contraction, all of it in joins and grouped minima.

A large star links every neighbour above a node to the least node around it, a small star links a node's neighbours below it, and
the node itself, to their least. Both keep components as they are; together they halve the paths in every round, so chains of n
links take about log n rounds. When each node hangs on one root only, the roots are the components' smallest ids.

Each round's links are written as tables, so plans and size estimates don't grow with the rounds. Nodes with many links are
looked up by broadcast (see :mod:`skew`); all other work is shuffled by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.skew import lookup_join
from blockloom.llm.storage import written


def _least(ends: DataFrame) -> DataFrame:
    """u, m (least of its neighbours), n (links) of the nodes of ``ends(u, v)``."""
    return written(ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components")


def _large_star(links: DataFrame) -> DataFrame:
    """links(a > b): every neighbour above a node goes to the least of the node and its neighbours."""
    ends = links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    above = lookup_join(links.select(F.col("b").alias("u"), F.col("a").alias("v")), _least(ends), "u", "n")
    return above.select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links(a > b): a node and its neighbours below it go to the least of these."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(down)
    below = lookup_join(down, least, "u", "n").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``links(a, b)``; the component is its smallest id. Loops and nulls are ignored."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not now.isEmpty():
        forked = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        chained = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if forked.isEmpty() and chained.isEmpty():
            break
        now = written(_small_star(written(_large_star(now), "components")), "components")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
