"""The engine on Structured Streaming: transactions are assembled, deduplicated by
position and applied batch by batch to a versioned snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apply import apply_changes


def deduplicated(changes: DataFrame, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A position of an origin takes effect once, however often it is delivered. On a
    stream with an event time the state is dropped behind the watermark."""
    if ts is None:
        return changes.dropDuplicates(["origin", "lsn"])
    return changes.withWatermark(ts, late).dropDuplicatesWithinWatermark(["origin", "lsn"])


def apply_stream(changes: DataFrame, snapshots: str, checkpoint: str, mode: str = "collect"):
    """Writes a new snapshot version for each micro-batch under `snapshots`, a shared
    folder, and starts the query. A batch that is run again rewrites its own version, so
    the effect is once; `latest_snapshot` reads the newest. An origin sends its log in
    order: the largest position applied is kept for each (`positions`, a row an origin),
    and what comes again in a later batch is passed over."""
    spark = changes.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = latest_snapshot(spark, snapshots, below=number)
        applied = latest_snapshot(spark, snapshots, below=number, part="positions")
        rows = deduplicated(batch)
        if applied is None:
            applied = rows.select("origin", F.col("lsn").alias("applied")).limit(0)
        # at most one row for each of sixteen origins
        rows = rows.join(F.broadcast(applied), "origin", "left").where("applied is null or lsn > applied").drop("applied")
        if before is None:
            before = rows.select("key", "value").limit(0)
        after, conflicts = apply_changes(before, rows, mode)
        reached = applied.unionByName(rows.select("origin", F.col("lsn").alias("applied"))).groupBy("origin").agg(F.max("applied").alias("applied"))
        conflicts.write.mode("overwrite").parquet(f"{snapshots}/conflicts/version={number}")
        reached.write.mode("overwrite").parquet(f"{snapshots}/positions/version={number}")
        after.write.mode("overwrite").parquet(f"{snapshots}/table/version={number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def latest_snapshot(spark: SparkSession, snapshots: str, below: int | None = None, part: str = "table") -> DataFrame | None:
    """The newest complete version (below a number), found through Hadoop's file system.
    The table is written last, so a part's version counts where the table has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{snapshots}/table")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    done = [int(n.rpartition("=")[2]) for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{snapshots}/{part}/version={max(done)}") if done else None


def silent(heartbeats: DataFrame, by: str, ts: str, timeout: str) -> DataFrame:
    """Sessions of heartbeats no further apart than the timeout; a node is silent after each."""
    return heartbeats.groupBy(by, F.session_window(ts, timeout).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(by, F.col("w.start").alias("first"), F.col("w.end").alias("silent_from"), "beats")
