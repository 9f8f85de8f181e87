"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.session import cut


def _settled(edges: DataFrame) -> bool:
    """Only stars left: every child has one parent and no parent is a child."""
    children = edges.select(F.col("a").alias("b")).distinct().withColumn("__chained", F.lit(True))
    n, n_children, chained = edges.join(children, "b", "left").agg(
        F.count(F.lit(1)), F.count_distinct("a"), F.count("__chained")
    ).first()
    return chained == 0 and n == n_children


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the component is its smallest node. Nodes are any orderable type.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest of them,
    until only stars are left (a logarithmic number of rounds in practice). Per-node minima combine
    on the map side and are joined back, so a hub with very many edges is never one row. Each round
    ends in a reliable checkpoint: an executor lost later does not replay the rounds.
    """
    e = edges.filter(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")
    ).distinct()
    e = cut(e)
    while not _settled(e):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).filter("a != b")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").filter(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).unionByName(parent.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
