"""Comparing replicas: equality with multiplicity, checksums, agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs, compared as text and null equal to null: their cells,
    n_a and n_b. One shuffle by row, with counts combined before."""
    cols = a.columns
    if len(cols) != len(b.columns):
        raise ValueError(f"{len(cols)} columns against {len(b.columns)}")
    text = lambda df: df.select(*[F.col(f"`{x}`").cast("string").alias(c) for x, c in zip(df.columns, cols)])
    both = text(a).withColumns({"n_a": F.lit(1), "n_b": F.lit(0)}).unionByName(text(b).withColumns({"n_a": F.lit(0), "n_b": F.lit(1)}))
    return both.groupBy(*cols).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).where("n_a <> n_b")


def check_query(build: Callable[[str], DataFrame], nodes: list[str]) -> bool:
    """Whether a query gives the same rows on every node; needs two nodes or more."""
    if len(nodes) < 2:
        raise ValueError("there is only one node")
    first = build(nodes[0])
    return all(difference(first, build(n)).isEmpty() for n in nodes[1:])


def checksum(df: DataFrame, order: list[str], cells: list[str]) -> DataFrame:
    """One row `checksum`: md5 of all rows in order, as '(a, b),(c, d)'. It is one string,
    for tables that fit one: use `fingerprint` beyond."""
    row = F.concat_ws(", ", *[F.col(c).cast("string") for c in cells])
    listed = df.select(F.struct(*order, row.alias("_row")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("l"))
    return listed.select(F.md5(F.concat(F.lit("("), F.array_join(F.transform("l", lambda r: r["_row"]), "),("), F.lit(")")).cast("binary")).alias("checksum"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, and order-free sums of row digests: combined before the shuffle, any size."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"))
