"""Host parity that plain query text does not cover: views and parameters, user-defined
functions, aggregates and table functions. Each with SQL that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("h25_view_and_parameters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 10 AND 90")
def _(spark, d) -> DataFrame:
    table(spark, d, "orders").where("o_orderstatus = 'F'").createOrReplaceTempView("h25_finished")
    return spark.sql("SELECT o_orderkey, o_custkey FROM h25_finished WHERE o_custkey BETWEEN :least AND :most", args={"least": 10, "most": 90})


@query("h25_prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 7")
def _(spark, d) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("h25_orders")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT o_orderkey, o_totalprice FROM h25_orders WHERE o_orderpriority = ? AND o_orderkey > ?' USING '1-URGENT', 7")


@F.pandas_udf(T.LongType())
def _check_digit(key: pd.Series) -> pd.Series:
    return (key * 7 + 3) % 11


@F.pandas_udf(T.LongType())
def _spread(v: pd.Series) -> int:
    return int(v.max() - v.min())


@F.udtf(returnType=T.StructType().add("word", T.StringType()).add("place", T.IntegerType()))
class _Words:
    def eval(self, text: str):
        for i, word in enumerate(text.split(" ")):
            yield word, i


@query("h27_udf", "SELECT o_orderkey, (o_orderkey * 7 + 3) % 11 AS digit FROM orders")
def _(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", _check_digit("o_orderkey").alias("digit"))


@query("h27_udaf", "SELECT o_custkey, (max(o_orderkey) - min(o_orderkey))::BIGINT AS spread FROM orders GROUP BY o_custkey")
def _(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(_spread("o_orderkey").alias("spread"))


@query("h27_udtf", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word, (generate_subscripts(string_split(n_name, ' '), 1) - 1)::INT AS place FROM nation")
def _(spark, d) -> DataFrame:
    spark.udtf.register("h27_words", _Words)
    table(spark, d, "nation").createOrReplaceTempView("h27_nation")
    return spark.sql("SELECT n_nationkey, word, place FROM h27_nation, LATERAL h27_words(n_name)")
