"""Mixing sources to target weights by a low-discrepancy schedule.

Slots k = 0, 1, ... carry the golden-ratio points frac(k * phi), mapped through the
cumulative weights to a source. Each source's documents, in shuffled order, make a
tape that is cut into equal-token blocks; the slot of rank r in its source takes
block r mod blocks, in epoch r div blocks. What a document gets is its overlap with
the blocks taken. Ranks and tape positions are prefix sums over two levels (per
bucket, then inside buckets), so no source is sorted by one task. Everything is
DataFrame operations; the slots are a function of k, so reruns agree.

Defined results: a null text has size 0 and gets 0; a null source is a source of its
own, last in order; equal rows are told apart by nothing and get equal shares of
their common place in any order; a source of size 0 has target 0; texts of any length
are counted whole; other columns do not enter; no rows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, read, stored

#: The weights of the sources, repeating; at most so many times its size.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block.
BLOCK_WORDS = 32
#: Fixed value: 2**32 / golden ratio, odd. k * GOLDEN mod 2**32 never repeats for k < 2**32;
#: from there on the points come again in the same order.
GOLDEN = 2654435769
SLOTS_A_BUCKET = 1 << 14
DOCS_A_BUCKET = 1 << 12
CELLS = 1 << 10


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) to (source, source_size, target, number). With the sources in
    order of most * size / weight, the capped ones come first: the common level of
    the rest is the first that no remaining source's own cap undercuts. The windows
    without partitions run over one row per source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("share", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "number", "level"))).over(all_)["level"])
    return s.select("source", "source_size", "number", F.least(F.col("cap").cast("double"), F.coalesce(F.col("share"), F.lit(0.0)) * F.col("w")).alias("target"))


def _ranked(rows: DataFrame, group: str, bucket: Column, order: list, amount: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of `amount` over the rows before, in each group; a
    bucket's rows are consecutive in the order."""
    rows = rows.withColumn("_b", bucket).withColumn("_a", amount)
    totals = rows.groupBy(group, "_b").agg(F.sum("_a").alias("_t"))
    over = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(name, F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    return local.join(totals, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_bb"))).withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_a", "_g", "_bb", "_before")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of df: doc_id, size, source, source_size, target, taken."""
    spark = df.sparkSession
    docs = stored(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    goal = stored(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rows = docs.count()
    goal = goal.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("draws", F.coalesce(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = stored(goal.withColumn("all_draws", F.sum("draws").over(all_)).withColumn("hi", F.sum("draws").over(upto) / F.col("all_draws")).withColumn("hi", F.when(F.col("number") == F.max("number").over(all_), F.lit(1.0)).otherwise(F.col("hi"))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("number")), F.lit(0.0))), "weights")
    slots = int(round(goal.agg(F.max("all_draws")).first()[0] or 0))
    # A slot's point falls into a cell; only the sources that touch the cell are compared.
    ranges = goal.where("draws > 0").select("number", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    # k * GOLDEN mod 2**32 in two halves of k, so that no k overflows
    point = F.expr(f"((id div 65536 % 65536 * {GOLDEN}L) % 4294967296L * 65536L + id % 65536 * {GOLDEN}L) % 4294967296L") / float(1 << 32)
    k = spark.range(slots).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = k.join(ranges, "cell").where("u >= lo and u < hi").select("id", "number", "blocks")
    ranked = _ranked(drawn, "number", (F.col("id") / SLOTS_A_BUCKET).cast("long"), ["id"], F.lit(1), "rank").where(F.col("rank") < F.col("blocks") * most)
    taken = ranked.groupBy("number", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    # The tape: documents by md5 of their id, which shuffles; its first digits are the bucket.
    digits = 1
    while 16**digits * DOCS_A_BUCKET < rows and digits < 7:
        digits += 1
    place = docs.join(goal.select(F.col("source").alias("_s"), "number", "source_size", "target", "blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    place = place.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    order = ["key", F.col("doc_id").asc_nulls_first(), "size"]
    tape = _ranked(place, "number", F.substring("key", 1, digits), order, F.col("size"), "at").drop("key")
    # Block j is [j * S / blocks, (j + 1) * S / blocks), rounded down: equal to within a word.
    edge = lambda j: F.expr(f"({j}) * source_size div blocks")
    pieces = (
        tape.where("size > 0")
        .withColumn("first", F.expr("at * blocks div source_size"))
        .withColumn("last", F.expr("(at + size - 1) * blocks div source_size"))
        # the floor of an edge may move a word's block by one: look one further on both sides
        .withColumn("block", F.explode(F.expr("sequence(greatest(0L, first - 1), least(blocks - 1, last + 1))")))
        .withColumn("words", F.least(F.col("at") + F.col("size"), edge("block + 1")) - F.greatest(F.col("at"), edge("block")))
        .where("words > 0")
    )
    got = pieces.join(taken, ["number", "block"]).groupBy("number", "at", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = tape.join(got, ["number", "at", "size"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def op3_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")


_SQL = """
    WITH RECURSIVE docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM docs GROUP BY source
    ), weighed AS (
        SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources
    ), levels AS (
        SELECT *, 3 * s / w AS ratio,
               ((SELECT sum(s) FROM weighed) - coalesce(sum(3 * s) OVER b, 0)) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER b, 0)) AS level
        FROM weighed WINDOW b AS (ORDER BY 3 * s / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), goal AS (
        SELECT source, s, number, least((3 * s)::DOUBLE, (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, number LIMIT 1) * w) AS target,
               ceil(s / 32.0)::BIGINT AS blocks
        FROM levels
    ), draws AS (
        SELECT *, CASE WHEN s > 0 THEN target * blocks / s ELSE 0 END AS draws FROM goal
    ), points AS (
        SELECT *, CASE WHEN number = (SELECT max(number) FROM draws) THEN 1.0::DOUBLE ELSE hi0 END AS hi
        FROM (SELECT *, sum(draws) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) / (SELECT sum(draws) FROM draws) AS hi0 FROM draws)
    ), ranges AS (
        SELECT *, coalesce(lag(hi) OVER (ORDER BY number), 0) AS lo FROM points
    ), slots AS (
        SELECT k, ((k * 2654435769) % 4294967296) / 4294967296.0::DOUBLE AS u
        FROM (SELECT unnest(range((SELECT round(sum(draws))::BIGINT FROM draws))) AS k)
    ), ranked AS (
        SELECT r.number, r.blocks, row_number() OVER (PARTITION BY r.number ORDER BY k) - 1 AS rank
        FROM slots JOIN ranges r ON u >= lo AND u < hi
    ), taken AS (
        SELECT number, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 3 * blocks GROUP BY ALL
    ), tape AS (
        SELECT d.doc_id, d.size, g.*, coalesce(sum(d.size) OVER (PARTITION BY g.number ORDER BY md5(d.doc_id::VARCHAR), d.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
        FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
    ), pieces AS (
        SELECT t.doc_id, t.number, b AS block, least(start_ + size, (b + 1) * s // blocks) - greatest(start_, b * s // blocks) AS words
        FROM tape t, unnest(range(greatest(0, start_ * blocks // s - 1), least(blocks, (start_ + size) * blocks // s + 2))) AS u(b) WHERE size > 0
    ), got AS (
        SELECT p.doc_id, sum(words * times) AS taken FROM pieces p JOIN taken USING (number, block) WHERE words > 0 GROUP BY p.doc_id
    )
    SELECT t.doc_id, t.size, t.s AS source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken FROM tape t LEFT JOIN got g USING (doc_id)
"""
SQL = {"op3_mixing_sources": _SQL.format(docs="documents")}
QUERIES = {"op3_mixing_sources": op3_mixing_sources}
