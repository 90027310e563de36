"""Clusters of linked keys, and splits that keep them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from .splits import hash_split


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each one reaches over edges (a, b), by alternating large and small stars.

    Each round is a written table; the number of rounds grows with the logarithm of the size of the largest component.
    Edges from a node to itself and repeated ones are passed over; without edges there are no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def clustered(df: DataFrame, key: str, links: DataFrame, name: str = "cluster") -> DataFrame:
    """``df`` with the smallest key that each row's key is linked with, over any number of links (a, b); alone it is its own cluster."""
    roots = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(roots, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", key)).drop("_node", "_root")


def cluster_split(df: DataFrame, key: str, links: DataFrame, fractions: Sequence[float], seed: int) -> DataFrame:
    """``df`` with cluster and role: linked keys, such as those of similar records, are never in two roles."""
    return clustered(df, key, links).withColumn("role", hash_split(F.col("cluster"), fractions, seed))
