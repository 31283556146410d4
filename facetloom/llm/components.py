"""Connected components of a table of links, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import Scratch, hot_keys, spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a and b of one ordered type. (node, root) of every linked node; root is one node of its component.

    Every node hooks on to its least neighbour if that is smaller; chains are halved until they end at roots; the
    links between roots are the next, smaller graph. A star, however large, is one row per point, and the points of a large
    one are dealt to several tasks.
    """
    with Scratch(links.sparkSession) as made:
        return made.keep(_components(links))


def _components(links: DataFrame) -> DataFrame:
    edges = stored(links.where("a <> b").select("a", "b").distinct())
    found = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = stored(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = stored(spread_join(up, above, "up", hot_keys(up, "up"), ["node"]).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = step.select("node", "up")
            if step.where("moved").isEmpty():
                break
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        left = spread_join(edges, a, "a", hot_keys(edges, "a"), ["b"])
        edges = stored(spread_join(left, b, "b", hot_keys(edges, "b"), ["a"]).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        roots = up.select(F.col("node").alias("root"), F.col("up").alias("top"))
        moved = spread_join(found, roots, "root", hot_keys(found, "root"), ["node"]).select("node", F.col("top").alias("root"))
        found = stored(moved.unionByName(found.join(roots, "root", "left_anti").select("node", "root")))
    return found
