"""Progress of replication: sync points, translation between logs, horizons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored

#: Steps to a stretch of a log that one task folds at a time.
STRETCH = 64


def latest(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The latest point of each (origin, receiver), 0 where there is none, for every two
    different nodes. Nodes are at most sixteen."""
    best = points.groupBy("receiver", "origin").agg(F.max(F.struct("origin_lsn", "receiver_lsn")).alias("p"))
    two = nodes.select(F.col("id").alias("origin")).join(nodes.select(F.col("id").alias("receiver")), F.expr("origin <> receiver"))
    return two.join(best, ["origin", "receiver"], "left").select("origin", "receiver", F.coalesce("p.origin_lsn", F.lit(0)).alias("origin_lsn"), F.coalesce("p.receiver_lsn", F.lit(0)).alias("receiver_lsn"))


#: Positions in a bucket of an as-of join.
AS_OF_WIDTH = 1 << 16


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], width: int = AS_OF_WIDTH) -> DataFrame:
    """left with the values of the last right row at or before it, per key; of right rows
    at one position the one with the largest values. One union and a running `last` on
    two levels, linear in both sides, instead of a range join: inside buckets of `width`
    positions, and over the buckets' last rows, so no task holds the log of a key."""
    rows = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    marks = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_b", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))
    ends = both.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_v"))).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_e"), F.last("_end", ignorenulls=True).over(over)["_v"].alias("_before"))
    w = Window.partitionBy(*keys, "_b").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    same = F.col("_b").eqNullSafe(F.col("_e"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = both.join(ends, same, "left").withColumn("_v", F.coalesce("_v", "_before"))
    return both.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def horizons(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The recovery horizon of each node as a sender: the least, over the latest points of
    the others, of the position in the sender's own log."""
    newest = latest(points, nodes)
    senders = nodes.select(F.col("id").alias("sender"))
    asked = newest.where("origin_lsn > 0").join(senders, F.expr("sender <> receiver"))
    direct = asked.where("origin = sender").select("sender", F.col("origin_lsn").alias("at"))
    through = asked.where("origin <> sender").select("origin", F.col("sender").alias("receiver"), F.col("origin_lsn").alias("wanted"))
    placed = as_of(through, points.select("origin", "receiver", "origin_lsn", "receiver_lsn"), ["origin", "receiver"], "wanted", "origin_lsn", ["receiver_lsn"])
    other = placed.select(F.col("receiver").alias("sender"), F.coalesce("receiver_lsn", F.lit(0)).alias("at"))
    return direct.unionByName(other).groupBy("sender").agg(F.min("at").alias("horizon"))


def cleanup(points: DataFrame, bounds: DataFrame, nodes: DataFrame, me: int) -> DataFrame:
    """The points that stay: own ones below both bounds of their origin go, and own ones
    of origins that are no node any more; a null bound keeps everything. bounds: origin,
    kept_ep, kept_ap; nodes: id, at most sixteen rows."""
    j = points.join(bounds, "origin", "left").join(F.broadcast(nodes.select(F.col("id").alias("origin"), F.lit(True).alias("_known")).distinct()), "origin", "left")
    below = F.coalesce((F.col("origin_lsn") < F.col("kept_ep")) & (F.col("origin_lsn") < F.col("kept_ap")), F.lit(False))
    return j.where(~((F.col("receiver") == me) & (below | F.col("_known").isNull()))).select(points.columns)


def emit_every(log: DataFrame, by: str, order: str, step: int) -> DataFrame:
    """log with `emit`: a mark is set whenever `step` (1 or more) has been passed since the
    last one, the first counted from 0. Rows without a position are left out; of rows at
    one position the first is marked.

    Each group of `by` is cut into stretches of STRETCH * step positions. One pass finds,
    for every position at which the marks can come into a stretch, the last mark there;
    the as-of join of these with the next stretch gives pointers, and pointer doubling
    over stored tables the positions at which the marks do come in. A second pass sets the
    marks. No array or task but that join holds a group of `by`, and the join only the
    entries."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    span = STRETCH * step
    stretch = F.expr(f"(at - pmod(at, {span}L)) div {span}L").alias("c")
    rows = log.select(F.col(by).alias("by"), F.col(order).cast("long").alias("at")).where("at is not null")
    rows = rows.groupBy("by", "at").agg(F.count(F.lit(1)).alias("n")).select("by", "at", "n", stretch)
    kind = dict(rows.dtypes)["by"]

    def leave(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at = t.column("at").to_numpy()
        nxt, out = np.searchsorted(at, at + step), np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            if nxt[i] < len(at):
                out[i] = out[nxt[i]]
        m = np.searchsorted(at, at[0] // span * span + step) + 1  # entries lie below one step, or first after it
        return pa.table({"by": t.column("by")[:m], "at": at[:m], "want": at[out[:m]] + step})

    ways = stored(rows.groupBy("by", "c").applyInArrow(leave, f"by {kind}, at long, want long"), "ways")
    back = ways.select("by", "at", (-F.col("want")).alias("_want"))
    links = as_of(back, ways.select("by", (-F.col("at")).alias("_from"), F.col("at").alias("to")), ["by"], "_want", "_from", ["to"])
    links = stored(links.where("to is not null").select("by", "at", "to"), "links")
    hop = lambda left, on: left.alias("l").join(links.alias("r"), F.col("l.by").eqNullSafe(F.col("r.by")) & (F.col(f"l.{on}") == F.col("r.at")))
    reached = stored(ways.where(f"at >= {step}").groupBy("by").agg(F.min("at").alias("at")), "reached")
    while not (more := stored(hop(reached, "at").select("l.by", F.col("r.to").alias("at")), "reached")).isEmpty():
        reached = reached.unionByName(more)
        links = stored(hop(links, "to").select("l.by", "l.at", "r.to"), "links")

    def mark(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n = t.column("n").to_numpy()
        own, came = t.filter(pa.array(n > 0)), t.column("at").to_numpy()[n == 0]
        at, emit = own.column("at").to_numpy(), np.zeros(own.num_rows, bool)
        i = np.searchsorted(at, came[0]) if len(came) else len(at)
        while i < len(at):
            emit[i] = True
            i = np.searchsorted(at, at[i] + step)
        return pa.table({"by": own.column("by"), "at": at, "n": own.column("n"), "hit": emit})

    both = rows.unionByName(reached.select("by", "at", F.lit(0).cast("long").alias("n"), stretch))
    marked = both.groupBy("by", "c").applyInArrow(mark, f"by {kind}, at long, n long, hit boolean")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")
    return marked.select("by", "at", "hit", each).select(F.col("by").alias(by), "at", (F.col("hit") & (F.col("i") == 1)).alias("emit"))
