"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the node; the links of
a step are written to the checkpoint folder and the number of steps grows with the logarithm of the
longest path. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r.n, r.x


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for each node of a link between two nodes. Loops and repeated links are allowed."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = durable(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("x"), F.col("m").alias("y"))
        small = small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v")
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
