"""Exact deduplication by composable polynomial fingerprints.

A text is a number in base B modulo two 31-bit primes. Its chunks are hashed
apart: chunk c of a text of n bytes that ends at byte e contributes
hash(c) * B**(n - e), and the contributions add up to the fingerprint of the
whole, in any order. Texts over `huge_bytes` are dealt out chunk by chunk, so no
task hashes a huge text alone; the others are hashed where they are read.

Equal (fingerprint, length) is only a candidate: the chunks of such texts are
compared one position at a time (least and largest chunk, combined before the
shuffle, so a group of any size sends one row per task and chunk). Groups with a
position where they differ are split by their whole texts.

Defined results: a null text is the empty text; rows with equal texts form one
group whatever their other columns hold; the largest doc_id stays (null ids are
smallest); of several rows with that same id one has kept = true; an empty table
gives an empty table; extra columns pass through `dedup` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, free, read, released, slices, small_batches, stored

#: The largest primes under 2**31 and, for each, a base.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525016)
CHUNK_BYTES = 1 << 16
HUGE_BYTES = 1 << 23


def _power_table(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:  # doubling: base**(have + i) = base**have * base**i
        step = pow(base, have, modulus)
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(modulus)
        have += more
    return out


class Fingerprint:
    """Chunk hashes and their length-shifted sums."""

    def __init__(self, moduli=MODULI, chunk: int = CHUNK_BYTES):
        self.moduli, self.chunk = moduli, chunk
        self.tables = [_power_table(b, m, chunk)[::-1].copy() for b, m in zip(BASES, moduli)]

    def of_chunk(self, data: np.ndarray, after: int) -> list[int]:
        """The share of a chunk (at most `chunk` bytes) that `after` bytes follow."""
        n = len(data)
        values = data.astype(np.uint64) + np.uint64(1)
        return [int(np.dot(values, t[self.chunk - n :])) % m * pow(b, after, m) % m for t, b, m in zip(self.tables, BASES, self.moduli)]

    def of(self, data: np.ndarray) -> tuple[int, int]:
        sums = [0, 0]
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            for k, x in enumerate(self.of_chunk(part, len(data) - at - len(part))):
                sums[k] = (sums[k] + x) % self.moduli[k]
        return sums[0], sums[1]


def fingerprints(df: DataFrame, text: str = "text", moduli=MODULI, chunk_bytes: int = CHUNK_BYTES, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """df with _len, _f1, _f2 (bytes and fingerprint of the text) in place of the text.
    Huge texts get theirs from chunk rows, the rest in the pass that reads them."""
    others = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text), "_len long", "_f1 long", "_f2 long"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprint(moduli, chunk_bytes).of
        for b in batches:
            found, lengths = [], []
            for _, data, at in slices(b.column(text)):
                for i in range(len(at) - 1):
                    found.append(of(data[at[i] : at[i + 1]]))
                    lengths.append(int(at[i + 1] - at[i]))
            made = [pa.array(lengths, pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *made], [*others, "_len", "_f1", "_f2"])

    small = df.where(F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= huge_bytes).mapInArrow(released(whole), schema)
    big = df.where(F.octet_length(text) > huge_bytes)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprint(moduli, chunk_bytes).of_chunk
        for b in batches:
            got = [of(np.frombuffer(c, np.uint8), after) for c, after in zip(b.column("_chunk").to_pylist(), b.column("_after").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_size"), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["_id", "_size", "_s1", "_s2"])

    # A huge text is named by a digest, so that its row and its chunks meet again.
    named = big.withColumn("_id", F.sha2(text, 256))
    chunk = F.col("_c")
    parts = (
        named.select("_id", F.encode(text, "UTF-8").alias("_t"))
        .select("_id", "_t", F.octet_length("_t").cast("long").alias("_size"))
        .select("_id", "_size", "_t", F.explode(F.expr(f"sequence(0L, (_size - 1) div {chunk_bytes})")).alias("_c"))
        .select("_id", "_size", F.substring("_t", chunk * chunk_bytes + 1, F.lit(chunk_bytes)).alias("_chunk"), F.greatest(F.lit(0), F.col("_size") - (chunk + 1) * chunk_bytes).alias("_after"), "_c")
        .dropDuplicates(["_id", "_c"])  # deals the chunks out, and hashes copies once
        .select("_id", "_size", "_chunk", "_after")
        .mapInArrow(released(shares), "_id string, _size long, _s1 long, _s2 long")
        .groupBy("_id", "_size")
        .agg((F.sum("_s1") % moduli[0]).alias("_f1"), (F.sum("_s2") % moduli[1]).alias("_f2"))
    )
    joined = named.join(parts, "_id").select(*others, F.col("_size").alias("_len"), "_f1", "_f2")
    return small.unionByName(joined)


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli=MODULI, chunk_bytes: int = CHUNK_BYTES, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row per row of df: _row, doc_id, text_sha256, keep_id, group_size, kept.

    _row numbers the rows as they were read; it is settled once, in a stored table.
    All Python runs in here; what is returned joins stored tables.
    """
    with small_batches(df.sparkSession):
        return _groups(df, doc_id, text, moduli, chunk_bytes, huge_bytes)


def _groups(df: DataFrame, doc_id: str, text: str, moduli, chunk_bytes: int, huge_bytes: int) -> DataFrame:
    text_of = F.coalesce(F.col(text), F.lit(""))
    named = df.select(F.col(doc_id).alias("_doc"), text_of.alias("_text"), F.sha2(text_of, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(fingerprints(named, "_text", moduli, chunk_bytes, huge_bytes), "fingerprints")
    key = ["_len", "_f1", "_f2"]
    # The texts to compare are found again by their digests, and only they are moved.
    each = rows.groupBy(*key, "text_sha256").agg(F.count(F.lit(1)).alias("_n"))
    several = stored(each.withColumn("_n", F.sum("_n").over(Window.partitionBy(*key))).where("_n > 1").select("text_sha256", *key), "several")
    texts = among(named.select("_text", "text_sha256"), "text_sha256", several.select("text_sha256")).join(several, "text_sha256")
    chunks = texts.select(*key, F.encode("_text", "UTF-8").alias("_t")).select(
        *key, F.posexplode(F.expr(f"transform(sequence(0L, greatest(0L, _len - 1) div {chunk_bytes}), c -> substring(_t, cast(c * {chunk_bytes} + 1 as int), {chunk_bytes}))")).alias("_c", "_part")
    )
    compared = chunks.groupBy(*key, "_c").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"))
    unequal = stored(compared.where("_lo <> _hi").select(*key).distinct(), "unequal").withColumn("_differs", F.lit(True))
    # Where equal fingerprints hide different texts, the texts' digests tell them apart.
    parted = rows.join(unequal, key, "left").withColumn("_part", F.when(F.col("_differs"), F.col("text_sha256")).otherwise(F.lit("")))
    key = [*key, "_part"]
    found = parted.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_doc", "_row")).alias("_keep"))
    return parted.join(found, key).select("_row", F.col("_doc").alias("doc_id"), "text_sha256", F.col("_keep._doc").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that stay: of equal texts the row with the largest doc_id.

    Rows are found again by id and text digest, so df may be recomputed. Rows whose id
    is not listed never move; of rows with the same id and text one stays.
    """
    sha, d, s, kept, n = (free(df, x) for x in ("_sha", "_d", "_s", "_kept", "_n"))
    found = groups(df, doc_id, text, **options).where("group_size > 1").groupBy(F.col("doc_id").alias(d), F.col("text_sha256").alias(s)).agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(n))
    listed = stored(found.where(~F.col(kept) | (F.col(n) > 1)), "copies")
    others = among(df, doc_id, listed.select(d), yes=False)
    marked = among(df, doc_id, listed.select(d)).withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    same = F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(sha) == F.col(s))
    alone = marked.join(listed, same, "left_anti")
    repeated = marked.join(listed.where(kept), same, "left_semi").dropDuplicates([doc_id, sha])
    return alone.unionByName(repeated).drop(sha).unionByName(others)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).drop("_row")


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        WINDOW w AS (PARTITION BY text_sha256)
    """
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
