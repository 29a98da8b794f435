"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage but the last returns the columns of documents. A stage's result is
written as Parquet in the shared folder and read again by the next.

Defined results: texts that are null or have no letter are rejected by the first
stage, others only where the model is hardly surer than chance; where nothing could be
learned every text with a letter stays; equal texts leave one row, linked near copies
one; the mix repeats or leaves out whole documents so that each source's words come
near its target; texts of any length are kept whole; an empty table gives an empty
result; columns beyond those of documents, of any name, pass through to the mix. The
session keeps the small Arrow batches that the stages ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, mixing, ngram_join, sentencepieces
from tidemark.llm.common import BATCH_ROWS, BATCHES, free, n_words, read, stored

#: A language is recognised whose mean probability is at least this part of the way from
#: chance (1 / labels) to certainty. With four labels: 0.35.
LEAST_WAY = 0.13


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, from here on in this session: stages
    share their executors, which hold a batch of whole texts on both sides of each
    Python worker, and a stage's rows are made after its function has returned."""
    rows = int(spark.conf.get(BATCHES))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    lean(spark)
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = free(docs, "lang_pred"), free(docs, "score")
    chance = 1 / len(model.labels)
    found = language_id.predict(docs, model, label=label, score=score)
    return found.where((F.col(label) != language_id.UNKNOWN) & (F.col(score) >= chance + LEAST_WAY * (1 - chance))).drop(label, score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id."""
    lean(spark)
    return exact_dedup.dedup(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles: that with the smallest doc_id."""
    lean(spark)
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of a document counts as a
    whole one with that probability, decided by the digest of its id."""
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken")).where("size > 0")
    d, s, n, times, each, copy = (free(docs, x) for x in ("_d", "_s", "_n", "_times", "_copies", "_copy"))
    taken = taken.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), (F.col("taken") / F.col("size")).alias(times))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (n_words(F.col("text")) == F.col(n))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(F.col(times) + chance).cast("int")
    kept = docs.join(taken, same).withColumn(each, copies).where(F.col(each) > 0)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).drop(d, s, n, times, each, copy)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    lean(spark)
    both = sentencepieces.encode_and_decode(docs.select("doc_id", "source", "text"))
    return both.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [("language_id", recognised), ("exact_dedup", distinct), ("ngram_jaccard_join", dissimilar), ("mixing_sources", mixed), ("sentencepiece", encoded)]
#: The first stage is a trained model, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
