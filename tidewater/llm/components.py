"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a table of its own, so that the join with the edges of a large component's root can be split
    least = C.cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least")
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = C.cut(edges.groupBy("b").agg(F.min("a").alias("m")), "cc-least")
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    moved = edges.join(least, "b").select(F.explode(F.array(pair("m", "a"), pair("m", "b"))).alias("e"))
    return moved.select("e.a", "e.b").filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a < b; root is the component's smallest node.

    Every round is cut, so the plan stays short and a lost executor costs a
    part of one round. Rounds grow with the logarithm of the nodes.
    """
    now, before = C.cut(edges.select("a", "b").filter("a < b").distinct(), "cc"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(state) or not state["n"]:
            break
        before = tuple(state)
        now = C.cut(_small_star(C.cut(_large_star(now), "cc-large")), "cc")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
