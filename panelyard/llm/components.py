"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node that node reaches.

    Nodes without edges do not appear. Loops and repeated pairs are allowed; no edges give no
    rows. The number of rounds grows with the logarithm of the largest component, each round
    is written to the shared folder in place of the one before, and nothing but two numbers a round comes to the driver.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % (1 << 31))).first()
        if now == mark or now[0] == 0:
            break
        mark, before = now, e
        e = durable(_small_star(_large_star(before)).distinct(), name)
        discard(before)
    roots = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(e.select("lo", "lo").distinct())
