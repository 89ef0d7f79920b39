"""Connected components of a table of links, in a number of rounds that grows with the logarithm of the nodes.

Each round gives every node that has links the name of the least of itself and its neighbours, and renames the
ends of all links; links between equal names disappear. Names are compared by themselves in the first round,
which finishes stars around their least node, and by a hash that changes from round to round afterwards, which
shortens chains of any order by a constant share. All tables go through the shared folder; joins are plain
equi-joins, which adaptive execution may split, and minima are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def components(spark: SparkSession, links: DataFrame, fresh_dir: Callable[[SparkSession, str], str]) -> DataFrame:
    """``node, component`` of every node that has links; the component is its least node.

    ``links`` has columns ``a, b`` (long) in any direction and number; nulls and links of a node to itself are
    left out. The result reads from the shared folder.
    """
    def stored(frame: DataFrame, label: str) -> DataFrame:
        folder = fresh_dir(spark, label)
        frame.write.parquet(folder)
        return spark.read.schema(frame.schema).parquet(folder)

    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    named = stored(edges.select("a").union(edges.select("b")).distinct().select(
        F.col("a").alias("node"), F.col("a").alias("name")), "names")
    number = 0
    while not edges.isEmpty():
        rank = (lambda c: F.struct(F.col(c).alias("by"), F.col(c).alias("id"))) if number == 0 else (
            lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("by"), F.col(c).alias("id")))
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        least = ends.groupBy("a").agg(F.min(rank("b")).alias("there")).select(
            F.col("a").alias("name"), F.least(rank("a"), F.col("there"))["id"].alias("next"))
        least = stored(least, "names")
        renamed = edges.join(least, edges["a"] == least["name"]).select(F.col("next").alias("a"), "b")
        renamed = renamed.join(least, renamed["b"] == least["name"]).select("a", F.col("next").alias("b"))
        edges = stored(renamed.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        named = stored(named.join(least, "name", "left").select(
            "node", F.coalesce("next", "name").alias("name")), "names")
        number += 1
    first = named.groupBy("name").agg(F.min("node").alias("component"))
    return named.join(first, "name").select("node", "component")
