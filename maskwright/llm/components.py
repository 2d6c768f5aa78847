"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of ``links`` (a, b: long, a != b).

    Alternates the large-star and small-star steps until nothing changes; each step is
    one minimum a node, written and joined back (so that the join can split skewed nodes).
    The table stays as large as the links, and each round is written to the shared folder.
    """
    edges = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        # large star: larger neighbours of u link to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.staged(large.where("u != v").distinct(), "large")
        # small star: smaller neighbours of u, and u itself, link to the least of them
        least = common.staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.staged(small.where("u != v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
