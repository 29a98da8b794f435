"""Filters of a change log, at the source and at the receiver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_local(changes: DataFrame, local: DataFrame, on: list[str]) -> DataFrame:
    """Changes of tables that are not registered as local. The list of tables is small
    as a rule; Spark broadcasts it if its size says so."""
    return changes.join(local, on, "left_anti")


def own_or_recovery(changes: DataFrame, me: int, recovery: bool) -> DataFrame:
    """A stream carries the sender's own changes; a recovery stream carries all."""
    return changes if recovery else changes.where(F.col("origin") == me)


def skip_reason(txns: DataFrame, progress: DataFrame, applied: DataFrame, me: int, sender: int) -> DataFrame:
    """txns (origin, lsn, end_lsn) with `skip`: why the receiver passes over it, null
    where it applies it. progress: origin, origin_lsn, local_lsn; applied: node_id, origin_lsn."""
    at = F.when(F.col("origin") == sender, F.col("end_lsn")).otherwise(F.col("lsn"))
    t = txns.withColumn("tx_lsn", at).join(progress.select("origin", F.col("origin_lsn").alias("_p"), F.col("local_lsn").alias("_l")), "origin", "left")
    done = applied.select(F.col("node_id").alias("origin"), F.col("origin_lsn").alias("tx_lsn"), F.lit(True).alias("_done")).distinct()
    t = t.join(done, ["origin", "tx_lsn"], "left")
    why = F.when(F.col("_l").isNull(), "unknown_origin").when(F.col("_l") == 0, "no_position").when(F.col("origin") == me, "own").when(F.col("tx_lsn") <= F.col("_p"), "before_syncpoint").when(F.col("_done"), "already_applied")
    return t.withColumn("skip", why).drop("_p", "_l", "_done")


def suppress_ddl(records: DataFrame, txn: str = "gid", order: str = "lsn", prefix: str = "prefix") -> DataFrame:
    """Row changes between the begin (D) and end (E) of a statement in their transaction
    are dropped: replaying the statement makes them again."""
    w = Window.partitionBy(txn).orderBy(order)
    inside = F.last(F.when(F.col(prefix).isin("D", "E"), F.col(prefix)), ignorenulls=True).over(w)
    return records.withColumn("_in", inside).where(F.col(prefix).isNotNull() | F.col("_in").isNull() | (F.col("_in") != "D")).drop("_in")


def relation_headers(changes: DataFrame, txn: str = "gid", order: str = "lsn", relation: str = "rel_name") -> DataFrame:
    """changes with `header`: a relation is named where it differs from the one before
    in its transaction."""
    before = F.lag(relation).over(Window.partitionBy(txn).orderBy(order))
    return changes.withColumn("header", before.isNull() | (before != F.col(relation)))


def segments(records: DataFrame, by: str, order: str, barrier, width: int = 1 << 16) -> DataFrame:
    """records with `segment`: the number of barriers up to each; segments are applied in
    order. Counted on two levels, inside buckets of `width` positions and over the
    buckets, so no task holds the log of a `by`."""
    rows = records.withColumns({"_hit": F.when(barrier, 1).otherwise(0), "_b": F.expr(f"({order} - pmod({order}, {width}L)) div {width}L")})
    totals = rows.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_e")).agg(F.sum("_hit").alias("_all"))
    over = Window.partitionBy("_by").orderBy("_e").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_by", "_e", F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_before"))
    inside = F.sum("_hit").over(Window.partitionBy(by, "_b").orderBy(order))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_b").eqNullSafe(F.col("_e"))
    return rows.withColumn("segment", inside).join(totals, same).withColumn("segment", F.col("segment") + F.col("_before")).select(*records.columns, "segment")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """The rows of left whose column is NOT IN right's, as SQL has it: a null on the right
    leaves no rows, a null on the left stays only where the right is empty. An anti-join
    and a one-row count."""
    seen = right.agg(F.count(F.lit(1)).alias("_all"), F.count(other).alias("_some"))
    keep = (F.col("_all") == 0) | ((F.col("_all") == F.col("_some")) & F.col(column).isNotNull())
    rest = left.crossJoin(F.broadcast(seen)).where(keep).select(left.columns)
    names = right.select(F.col(other).alias("_other")).where("_other is not null")
    return rest.join(names, F.col(column) == F.col("_other"), "left_anti")
