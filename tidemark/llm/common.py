"""Helpers shared by the corpus operators: scratch tables, readers and word hashing.

Everything here is bounded by an Arrow batch or by a slice of one; nothing
gathers rows on the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the words of a text are the runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that numpy works on at a time.
SLICE_BYTES = 1 << 18
#: Rows of a batch sent to Python where texts are worked on part by part anyway.
BATCH_ROWS = 1024
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits that `among` marks keys in, whatever their number (2 MB), and bits in one of its rows.
MARK_BITS = 1 << 24
MARK_ROW = 1 << 15


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, read from
    the session. Where it is unset in local mode (tests), a temporary folder is made
    and set once; on a cluster that raises, since executors do not share such a folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", place)
        atexit.register(__import__("shutil").rmtree, place[7:], True)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    path = f"{scratch(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Gives back to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives what its task has freed back to the system
    when it ends: a Python worker waits for the next task beside the executor, and
    allocators keep what they once had."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of at most `rows` rows for the jobs run inside, since a batch is held
    whole on both sides; the session's setting is put back afterwards."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, compared as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def among(df: DataFrame, key: str, listed: DataFrame, yes: bool = True) -> DataFrame:
    """The rows of df whose `key` may be in the only column of `listed`; with yes=False
    the others, which surely are not. A bit for each hash is broadcast, so that wide
    rows are told apart where they are read: a join with the list then moves few that
    have no partner (one in 17 at a million keys), and none is lost."""
    at, row, bits = (free(df, x) for x in ("_at", "_row_of_bits", "_bits"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS))
    kind = df.schema[key].dataType  # hashes differ by type
    places = listed.select(place(F.col(listed.columns[0]).cast(kind)).alias(at)).select(at, F.expr(f"`{at}` div {MARK_ROW}").alias(row))
    # dealt by row first: partial bitmaps of every task would outgrow the list
    marks = places.repartition(row).groupBy(row).agg(F.bitmap_construct_agg(F.col(at) % MARK_ROW).alias(bits))
    mine = place(F.col(key))
    byte = F.substring(F.col(bits), ((mine % MARK_ROW) / 8).cast("int") + 1, F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (mine % 8).cast("int") + 1)) != 0
    return df.join(F.broadcast(marks), ((mine / MARK_ROW).cast("long") == F.col(row)) & bit, "left_semi" if yes else "left_anti")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, as a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string array into runs of whole texts of about `size` bytes:
    (first row, bytes, offsets). A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, up to n."""
    if len(_powers.get("up", ())) < n + 1:
        n = max(n, 2 * SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends) of data."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word of the texts in a slice, in order."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inner = word[1:-1]
    starts = np.flatnonzero(inner & (~word[:-2] | first[:-1]))
    ends = np.flatnonzero(inner & (~word[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range behind the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def int64(values: np.ndarray) -> pa.Array:
    """uint64 or int64 numbers as a signed Arrow column."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
