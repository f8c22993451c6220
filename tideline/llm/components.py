"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.storage import Scratch


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of the edges; root is its component's smallest node.

    Each round links every node's larger neighbours to its smallest neighbour,
    then its smaller ones (Kiveris et al. 2014), which ends after about the
    square of the logarithm of the longest path. A round only aggregates minima,
    with map-side combining, and joins them back, so a node with a third of the
    edges is split like any skewed join. Rounds are written to the shared folder,
    and only a row count and a checksum reach the driver. Null ends and loops are
    dropped; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    current = (
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    current, before, turn = scratch.write(current, "edges-0"), None, 0
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            break
        before, turn = state, turn + 1
        current = scratch.write(_small_star(_large_star(current)), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
