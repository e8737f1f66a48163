"""Connected components by alternating star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    # Two steps, a combined minimum and a join, so that a node with very many neighbours is
    # never gathered: the minimum combines before its shuffle, the join's skew can be split.
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).withColumn("m", F.least("u", "m"))
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_least(edges)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Runs one job per round, each round ending in a reliable checkpoint.  Rows with a NULL end and
    loops are left out; repeated edges count once.  An empty input gives an empty result.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct()
    now, before = materialize(now), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = (mark["n"], mark["x"])
        now = materialize(_small_star(_large_star(now)))
