"""Approximate nearest neighbours by a hash-prefix forest.

Each of `trees` trees gives a vector a string of 64 bits, the sides of as many random
hyperplanes it lies on. Largest inner product becomes smallest angle by one more
coordinate that brings every row to the same length. The forest is dealt by id into
shards of about SHARD rows; in a shard a tree is the sorted array of its strings, and
every block of queries meets every shard once, so vectors travel once per block and
strings never do.

In a shard a query descends to the longest prefixes that match in the trees and
ascends in all of them together, bit by bit, until the matching rows, counted once per
tree, are more than `share` of the shard's rows (and enough for k). All those rows, and
no others, are scored exactly. How deep the ascent ends so differs from query to query:
a query among near copies ends at long prefixes. (The count only grows on the way up,
so the level is found by halving instead of bit by bit.)

How large the share must be is measured in the run, at every table size alike: of at
most PROBES queries (those with the least hash of their id) the exact neighbours are
sought in all rows, and the share is the least at which `recall` of them are met. It
falls as tables grow, since neighbours come nearer. Where no prefix tells neighbours
from other rows it nears all rows, as any hashing must. Work is queries * rows * share;
recall against brute force and shares: README.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor do null ids and lengths other than the commonest (of equally common
ones the largest); an id that repeats counts once, with its least vector; equal scores
go by smaller id; other columns do not enter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored

TREES = 64
BITS = 64
SHARD = 4096
QUERIES = 8192
SEED = 11
#: Queries whose exact neighbours are sought, and the share of those neighbours that must be met.
PROBES = 128
RECALL = 0.95


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(vec_id).isNotNull() & v.isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def placed(x: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """Vectors of length 1 with one more coordinate, so that the largest inner product
    is the smallest angle."""
    unit = np.zeros((len(x), x.shape[1] + 1))
    unit[:, :-1] = x
    length = np.sqrt((unit**2).sum(axis=1)) if as_query else np.full(len(x), longest)
    unit /= length[:, None]
    if not as_query:
        unit[:, -1] = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))
    return unit


def hash_strings(unit: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The strings of a tree, as 64-bit numbers, first bit first."""
    planes = np.random.default_rng([seed, tree]).normal(size=(unit.shape[1], BITS))
    return np.packbits(unit @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class Shard:
    """Some rows as a forest: for each tree its strings in order, and whose they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, trees: int, seed: int):
        self.ids, self.vectors, self.seed = ids, vectors, seed
        unit = placed(vectors, longest, False)
        self.strings, self.owners, self.plain = [], [], []
        for t in range(trees):
            s = hash_strings(unit, t, seed)
            order = np.argsort(s, kind="stable")
            self.plain.append(s)
            self.strings.append(s[order])
            self.owners.append(order)

    def asked(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit = placed(vectors, 1.0, True)
        return [hash_strings(unit, t, self.seed) for t in range(len(self.strings))]

    @staticmethod
    def _range(strings: np.ndarray, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings begin and end that share the first `level` bits with each asked."""
        shift = (BITS - level).astype(np.uint64)
        rest = np.where(level > 0, (np.uint64(1) << np.minimum(shift, np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        return np.searchsorted(strings, asked & ~rest), np.searchsorted(strings, asked | rest, "right")

    def met(self, asked: list[np.ndarray], level: np.ndarray) -> np.ndarray:
        """The rows met at a level by each query, counted once per tree."""
        total = np.zeros(len(level), np.int64)
        for strings, a in zip(self.strings, asked):
            lo, hi = self._range(strings, a, level)
            total += hi - lo
        return total

    def levels(self, asked: list[np.ndarray], enough: int) -> np.ndarray:
        """The longest prefixes at which each query has met `enough` rows; 0 at the root."""
        low, high = np.zeros(len(asked[0]), np.int64), np.full(len(asked[0]), BITS)
        while (low < high).any():
            mid = (low + high + 1) // 2
            full = self.met(asked, mid) >= enough
            low, high = np.where(full, mid, low), np.where(full, high, mid - 1)
        return low

    def candidates(self, asked: list[np.ndarray], enough: int, k: int) -> Iterator[np.ndarray]:
        """For each query the rows it meets."""
        level = self.levels(asked, enough)
        ranges = [self._range(s, a, level) for s, a in zip(self.strings, asked)]
        ranges = [(lo.tolist(), hi.tolist()) for lo, hi in ranges]
        for q in range(len(level)):
            met = np.zeros(len(self.ids), bool)
            for owner, (lo, hi) in zip(self.owners, ranges):
                met[owner[lo[q] : hi[q]]] = True
            at = int(level[q])
            while at and met.sum() <= k:  # too few different ones: further up
                at -= 1
                for owner, strings, a in zip(self.owners, self.strings, asked):
                    lo, hi = self._range(strings, a[q : q + 1], np.array([at]))
                    met[owner[lo[0] : hi[0]]] = True
            yield np.flatnonzero(met)

    def best(self, who: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k of the rows `who` nearest to the query, without its own: (rows, scores).
        Scores are summed in order, so that equal vectors score equal."""
        who = who[self.ids[who] != own]
        rough = self.vectors[who] @ query
        if len(who) > k:
            margin = 1e-9 * (1 + np.abs(rough).max())
            who = who[rough >= np.partition(rough, len(who) - k)[len(who) - k] - margin]
        score = np.add.accumulate(self.vectors[who] * query, axis=1)[:, -1]
        first = np.lexsort((self.ids[who], -score))[:k]
        return who[first], score[first]


def nearest(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", is_query=None, k: int = 20, trees: int = TREES, seed: int = SEED, recall: float = RECALL, shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` (a condition on
    the column id) the k other rows with the largest inner products found."""
    spark = df.sparkSession
    rows = stored(_usable(df, vec_id, embedding), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, longest = sizes.d, sizes.m
    rows = rows.where(F.size("v") == dims)
    shards = -(-sizes.n // shard_rows)
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // query_rows))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = pa.compute.list_flatten(table.column("v")).to_numpy().astype(np.float64)
        return table.column("id").to_numpy(), flat.reshape(-1, dims)

    share = _share(rows, queries, shard, order, opened, longest, k, trees, seed, recall)

    def scan(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        ids, vectors = opened(table.filter(pa.compute.invert(asks)))
        own, asked = opened(table.filter(asks))
        out = ([], [], [])
        if len(ids) and len(own):
            forest = Shard(ids, vectors, longest, trees, seed)
            for q, who in enumerate(forest.candidates(forest.asked(asked), int(share * len(ids) + 1e-6) + 1, k)):
                who, score = forest.best(who, own[q], asked[q], k)
                out[0].append(np.full(len(who), own[q]))
                out[1].append(ids[who])
                out[2].append(score)
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = rows.select("id", "v", F.lit(False).alias("asks"), shard.alias("shard"), every(blocks).alias("block"))
    met = met.unionByName(queries.select("id", "v", F.lit(True).alias("asks"), every(shards).alias("shard"), block.alias("block")))
    hits = met.groupBy("shard", "block").applyInArrow(scan, "query_id long, vec_id long, score double")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _share(rows: DataFrame, queries: DataFrame, shard, order, opened, longest: float, k: int, trees: int, seed: int, recall: float) -> float:
    """The least share of a shard's rows, counted once per tree, past which `recall` of
    the exact neighbours of the probes are met."""
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()
    if not probes:
        return 0.0
    own, asked = np.array([r.id for r in probes]), np.array([r.v for r in probes], np.float64)

    def exact(table: pa.Table) -> pa.Table:
        ids, vectors = opened(table)
        forest = Shard(ids, vectors, longest, trees, seed)
        strings, out = forest.asked(asked), ([], [], [], [])
        for p in range(len(own)):
            who, score = forest.best(np.arange(len(ids)), own[p], asked[p], k)
            apart = np.min([plain[who] ^ s[p] for plain, s in zip(forest.plain, strings)], axis=0)  # of the tree that shares most
            level = BITS - np.ceil(np.log2(apart.astype(np.float64) + 1)).astype(np.int64)
            before = forest.met([np.full(len(who), s[p]) for s in strings], np.minimum(level + 1, BITS))
            before[level >= BITS] = 0
            for column, x in zip(out, (np.full(len(who), own[p]), ids[who], score, before / len(ids))):
                column.append(x)
        return pa.table(dict(zip(("query_id", "vec_id", "score", "need"), (pa.array(np.concatenate(x)) for x in out))))

    found = rows.select("id", "v", shard.alias("shard")).groupBy("shard").applyInArrow(exact, "query_id long, vec_id long, score double, need double")
    need = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("need").collect()  # PROBES * k numbers at most
    need = np.sort([r.need for r in need])
    return float(need[max(0, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 0.0


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), is_query=F.col("id") % 20 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}
