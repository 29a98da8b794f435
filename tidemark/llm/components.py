"""Connected components of a distributed edge list by alternating large-star and
small-star steps. A step deals the edges by one end, once, and takes the least of
each node's neighbours by a window there, which spills where they are many: at most all
nodes of a component, as numbers. Each round's edges are a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): with m the least of a and its neighbours, ties the larger
    (large) or the smaller (small) neighbours to m. Gives a row for each edge."""
    here, there = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        tied = edges.select(F.inline(F.array(here, there)))
    else:
        tied = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a").dropDuplicates(["a", "b"])
    tied = tied.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least
    node. An edge with a null end or equal ends is no edge; repeats are one edge."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    seen = None
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False), "edges")
        print_ = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if print_ == seen:
            break
        seen = print_
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))).distinct()
