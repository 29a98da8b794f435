"""Applying a change log to a table: keyed or keyless, unchanged cells kept,
conflicts reported. One shuffle on the key; no row is fetched by another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Conflict(Exception):
    """A strict apply met a change that its table does not allow."""


def apply_changes(base: DataFrame, changes: DataFrame, mode: str = "collect") -> tuple[DataFrame, DataFrame]:
    """base (key, value), changes (lsn, op, key, value, changed): the table after all
    changes, and the conflicts (lsn, op, key, conflict).

    op: I, U, D or 0 (truncate, no key). U keeps the value where `changed` is false; a
    changed null is a null. A row is present from its base or an insert on, and absent
    from a delete on: U or D on an absent row, and I on a present one, is a conflict, each
    time. Mode 'strict' raises on the first; 'collect' leaves a missing row missing and
    lets a repeated insert write.
    """
    cut = changes.where("op = '0'").agg(F.max("lsn").alias("_cut"))
    live = changes.where("op <> '0'").crossJoin(F.broadcast(cut)).where("_cut is null or lsn > _cut").drop("_cut")  # the cut is one row
    kept = base.crossJoin(F.broadcast(cut)).where("_cut is null").drop("_cut")
    log = live.select("key", "lsn", "op", "value", "changed").unionByName(kept.select("key", F.lit(0).cast(live.schema["lsn"].dataType).alias("lsn"), F.lit("B").alias("op"), "value", F.lit(True).alias("changed")))
    w = Window.partitionBy("key").orderBy("lsn")
    present = F.when(F.col("op").isin("I", "B"), True).when(F.col("op") == "D", False)
    before = F.coalesce(F.last(present, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    log = log.withColumn("here", before)
    conflict = F.when((F.col("op") == "U") & ~F.col("here"), "update of a missing row").when((F.col("op") == "D") & ~F.col("here"), "delete of a missing row").when((F.col("op") == "I") & F.col("here"), "insert of a present row")
    log = log.withColumn("conflict", conflict)
    conflicts = log.where("conflict is not null").select("lsn", "op", "key", "conflict")
    if mode == "strict":
        first = conflicts.orderBy("lsn").first()
        if first is not None:
            raise Conflict(f"{first.conflict}: key {first.key} at {first.lsn}")
    # A run starts at an insert, a delete or the base row; cells carry over inside it.
    run = F.sum(F.when(F.col("op").isin("I", "D", "B"), 1).otherwise(0)).over(w)
    log = log.withColumn("run", run)
    cell = F.when(F.col("changed") | F.col("op").isin("I", "B"), F.struct(F.col("value").alias("v")))
    inside = Window.partitionBy("key", "run").orderBy("lsn")
    log = log.withColumn("cell", F.last(cell, ignorenulls=True).over(inside)).withColumn("start", F.first("op").over(inside))
    last = log.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lsn")))).where("_r = 1")
    return last.where("start in ('I', 'B')").select("key", F.col("cell.v").alias("value")), conflicts


def apply_keyless(base: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows without a key: inserts add a row, deletes take one equal row away each,
    null equal to null."""
    cols = base.columns
    n = lambda df, k: df.groupBy(*cols).agg(F.sum(F.lit(k)).alias("_n"))
    total = n(base, 1).unionByName(n(inserted, 1)).unionByName(n(deleted, -1)).groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n > 0")
    return total.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*cols)


def upsert(base: DataFrame, rows: DataFrame, key: list[str], combine: dict[str, object] | None = None) -> DataFrame:
    """Insert or, where the key is there, update; combine: column to f(old, new)."""
    combine = combine or {}
    o, n = base.alias("o"), rows.alias("n")
    j = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    has_o, has_n = F.col(f"o.{key[0]}").isNotNull(), F.col(f"n.{key[0]}").isNotNull()

    def value(c: str):
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = combine[c](old, new) if c in combine else new
        return F.when(has_o & has_n, both).when(has_n, new).otherwise(old).alias(c)

    return j.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in key], *[value(c) for c in base.columns if c not in key])


def insert_absent(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return base.unionByName(rows.dropDuplicates(key).join(base, key, "left_anti"))


def grant(requests: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """requests (key, seq, node_id, gen_num) with `granted`, `holder`, `holder_gen`: the
    first applicant holds it, and gets it again only with a larger generation. A node_id
    of null clears it; a holder without a generation keeps it until then. Windows on the
    key, cut by its clears; equal positions go by node_id, then gen_num, nulls first."""
    rows = requests.select(key, F.col(order).cast("long").alias("seq"), F.col("node_id").cast("int").alias("node"), F.col("gen_num").cast("long").alias("gen"))
    by = [F.col("seq"), F.col("node"), F.col("gen")]
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cleared", F.count_if(F.col("node").isNull()).over(so_far(key)))
    w = so_far(key, "_cleared")
    ask = F.when(F.col("node").isNotNull(), F.struct("node", "gen"))
    rows = rows.withColumns({"_first": F.first(ask, ignorenulls=True).over(w), "_nth": F.count("node").over(w)})
    own = F.when((F.col("node") == F.col("_first.node")) & F.col("_first.gen").isNotNull(), F.col("gen"))
    rows = rows.withColumn("_own", own)
    before = F.max("_own").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_gen": F.max("_own").over(w), "_before": before})
    ok = F.col("node").isNotNull() & ((F.col("_nth") == 1) | F.coalesce(F.col("_own") > F.col("_before"), F.lit(False)))
    return rows.select(key, "seq", ok.alias("granted"), F.col("_first.node").alias("holder"), F.col("_gen").alias("holder_gen"))
