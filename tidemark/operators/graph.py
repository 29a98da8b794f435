"""Connectivity: mutual edges, cliques. At most sixteen nodes, so the largest clique is
found by trying all masks, dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutual(edges: DataFrame) -> DataFrame:
    """The directed edges (a, b) whose reverse is there too."""
    back = edges.select(F.col("a").alias("b"), F.col("b").alias("a")).distinct()
    return edges.select("a", "b").distinct().join(back, ["a", "b"], "left_semi")


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, mask) of mutual neighbours and the node itself."""
    bit = lambda c: F.pow(F.lit(2), F.col(c) - 1).cast("long")
    own = nodes.select(F.col("id").alias("node"), bit("id").alias("m"))
    return mutual(edges).select(F.col("a").alias("node"), bit("b").alias("m")).unionByName(own).groupBy("node").agg(F.bit_or("m").alias("mask"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> list[tuple[int, int]]:
    """Every node with the mask it sees, in order; more than 16 nodes are an error."""
    found = [(r.node, r.mask) for r in adjacency(edges, nodes).orderBy("node").limit(17).collect()]
    if len(found) > 16:
        raise ValueError("at most 16 nodes")
    return found


def is_clique(mask, adjacent: list[tuple[int, int]]):
    """A condition: every node of the mask sees the whole mask."""
    out = F.lit(True)
    for node, seen in adjacent:
        out = out & ((mask.bitwiseAND(F.lit(1 << node - 1)) == 0) | (mask.bitwiseAND(F.lit(~seen)) == 0))
    return out


def maximum_clique(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (mask, size): the largest clique, of equal ones the smallest mask."""
    spark = edges.sparkSession
    adjacent = neighbours(edges, nodes)
    masks = spark.range(1, 1 << max((n for n, _ in adjacent), default=0)).select(F.col("id").alias("mask"))
    every = sum(1 << n - 1 for n, _ in adjacent)
    found = masks.where(F.col("mask").bitwiseAND(F.lit(~every)) == 0).where(is_clique(F.col("mask"), adjacent))
    best = found.agg(F.max(F.struct(F.bit_count("mask").alias("size"), (-F.col("mask")).alias("neg"))).alias("m"))
    return best.select((-F.col("m.neg")).alias("mask"), F.col("m.size").cast("int").alias("size"))
