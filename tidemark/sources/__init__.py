"""Change logs as DataFrames: decoding, snapshots, terminal events, fixtures from
relational tables, and readers for batch and stream."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = "lsn decimal(20,0), seq int, gid string, origin int, rel_schema string, rel_name string, op string, key long, value double, changed boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as Parquet in spark.checkpoint.dir, a temporary folder where that is unset."""
    conf = df.sparkSession.conf
    if not conf.get("spark.checkpoint.dir", None):
        conf.set("spark.checkpoint.dir", "file://" + (own := tempfile.mkdtemp(prefix="tidemark-")))
        atexit.register(shutil.rmtree, own, True)
    path = f"{conf.get('spark.checkpoint.dir').rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log over the events table: one change per event, four to a transaction."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select(
        (F.col("event_id") + 1).alias("lsn"),
        F.expr("cast(event_id div 4 as long)").alias("gid"),
        (F.col("user_id") % 3 + 1).alias("origin"),
        op.alias("op"),
        F.col("user_id").alias("key"),
        F.col("value"),
        (F.col("event_type") != "view").alias("changed"),
        F.col("event_type").alias("rel_name"),
    )


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = CHANGE, **options: str) -> DataFrame:
    """A stored change log; the schema is given, never inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def stream_changes(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = CHANGE, **options: str) -> DataFrame:
    """The same files as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def broadcast_table(df: DataFrame) -> DataFrame:
    """A full copy as changes: a truncate marker first, then every row as an insert."""
    rows = df.withColumn("op", F.lit("I"))
    marker = df.limit(0).sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], F.lit("0").alias("op"))
    return marker.unionByName(rows)


def encode_row(df: DataFrame, cells: list[str], unchanged: dict[str, str] | None = None) -> DataFrame:
    """df with `tuple`: for each cell its kind (n null, u unchanged, t text) and text.
    unchanged: condition per cell."""
    unchanged = unchanged or {}

    def cell(c: str):
        kind = F.when(F.expr(unchanged.get(c, "false")), "u").when(F.col(c).isNull(), "n").otherwise("t")
        return F.struct(kind.alias("kind"), F.when(kind == "t", F.col(c).cast("string")).alias("text"))

    return df.withColumn("tuple", F.array(*[cell(c) for c in cells]))


def decode_row(df: DataFrame, fields: T.StructType) -> DataFrame:
    """The cells of `tuple` as columns, each struct(v), null where unchanged: null and
    unchanged stay apart. A tuple of another length raises."""
    arity = F.assert_true(F.size("tuple") == len(fields), F.lit("the tuple has another number of columns"))
    df = df.where(arity.isNull())
    for i, f in enumerate(fields):
        c = F.col("tuple")[i]
        df = df.withColumn(f.name, F.when(c["kind"] != "u", F.struct(c["text"].cast(f.dataType).alias("v"))))
    return df


#: What the first letter of a logical message stands for.
MESSAGES = {"L": "local", "D": "ddl_begin", "C": "ddl_concurrent", "V": "ddl_ordered", "E": "ddl_end", "N": "sequence", "T": "table", "S": "syncpoint"}


def message_kind(prefix):
    out = F.lit("message")
    for k, v in MESSAGES.items():
        out = F.when(prefix == k, v).otherwise(out)
    return out
