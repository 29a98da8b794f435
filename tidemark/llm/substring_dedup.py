"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of the last 16 bytes cuts a text where some of its bits are zero, so an
insertion moves only the cuts beside it. Chunks are deduplicated by digest over all
documents: of a repeated chunk the occurrence in the smallest doc_id stays (in one
document the first). Single chunks repeat by chance, so only runs of consecutive
repeated chunks with `min_words` words or more count as repeated passages; a passage
shared word for word holds such a run but for the part of a chunk at either end. A run
that cannot reach `passage` words, even with all that its neighbouring chunks may add,
is part of no passage sought and is left alone.

Defined results: a null or empty text has no chunks and stays as it is; a row with a
null doc_id is left alone; rows that repeat a doc_id are one document, whose later
rows lose what the earlier repeat only where they share no run with a smaller id
(they are compared by position in their own row); cuts fall between characters; texts
of any length are chunked whole; other columns pass through; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, int64, read, slices, span_hashes, stored

#: A chunk ends where MASK of the 32-bit hash is zero: every 32 bytes on average. Bits
#: 11 to 15 depend on the last 16 bytes.
MASK = 0b11111 << 11
MIN_WORDS = 16
#: The words of the shortest passage sought; a run that cannot be part of one is no repeat.
PASSAGE = 51
#: The gear hash sees so many bytes where MASK looks at it; neighbours' words are counted to MANY.
WINDOW, MANY = 16, 255
_GEAR = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear[byte i back] << i, modulo 2**32, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunk_ends(data: np.ndarray, mask: int = MASK) -> np.ndarray:
    """The ends of the chunks of one text, its own end last."""
    if not len(data):
        return np.zeros(0, np.int64)
    after = np.append(data[1:], np.uint8(32))
    ends = np.flatnonzero(((gear(data) & np.uint32(mask)) == 0) & ((after & 0xC0) != 0x80)) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: int = MASK) -> DataFrame:
    """(digest, doc, row, place, told) for every chunk: place holds its start and size
    in bytes, told the words that begin in it and whether the text had it before, both
    packed (see `unpacked`) so that little is shuffled. row is 0 but where a doc_id repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = b.column("doc").to_numpy(), b.column("row").to_numpy()
            for first, data, at in slices(b.column("text")):
                words = np.zeros(len(data) + 1, np.int64)
                space = _SPACE[data]
                np.cumsum(~space & np.append(True, space[:-1])[: len(data)], out=words[1:])
                ends = [chunk_ends(data[lo:hi], mask) + lo for lo, hi in zip(at[:-1], at[1:])]
                n = np.array([len(e) for e in ends])
                if not n.sum():
                    continue
                end = np.concatenate(ends)
                start = np.concatenate(([0], end[:-1]))
                digest = span_hashes(data, start, end)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((digest, owner))
                again = np.zeros(len(end), bool)
                again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
                own = words[end] - words[start]
                # Words that a passage may have beyond its whole chunks: in the chunk before
                # and the 16 bytes before that, which the gear hash sees; in the chunk after.
                inner = start > at[owner]
                lead = np.where(inner, words[start] - words[np.maximum(np.roll(start, 1) - WINDOW, at[owner])] + 1, 0)
                tail = np.where(end < at[owner + 1], np.roll(own, -1) + 1, 0)
                around = np.minimum(lead, MANY) << 48 | np.minimum(tail, MANY) << 40
                yield pa.RecordBatch.from_arrays(
                    [int64(digest), pa.array(doc[first + owner]), pa.array(row[first + owner]), pa.array((start - at[owner]) << 32 | (end - start)), pa.array(around | own << 1 | again)],
                    ["digest", "doc", "row", "place", "told"],
                )

    rows = numbered(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text").where("doc is not null").select("doc", "row", F.col("_text").alias("text"))
    return rows.mapInArrow(work, "digest long, doc long, row long, place long, told long")


def numbered(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """df with doc, and with row: the hash of the text where the doc_id repeats, else 0."""
    ids = F.col(doc_id).cast("long").alias("doc")
    # usually few: Spark broadcasts them by their size, and else joins by shuffle
    twice = stored(df.select(ids).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("twice")), "twice")
    return df.withColumn("doc", ids).join(twice, "doc", "left").withColumn("row", F.when(F.col("twice"), F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(F.lit(0).cast("long"))).drop("twice")


def unpacked(df: DataFrame) -> DataFrame:
    """place and told as start, size, words and again."""
    place, told = F.col("place"), F.col("told")
    near = {"lead": F.shiftright(told, 48).cast("int"), "tail": F.shiftright(told, 40).bitwiseAND(MANY).cast("int")}
    return df.withColumns({"start": F.shiftright(place, 32).cast("int"), "size": place.bitwiseAND((1 << 32) - 1).cast("int"), "words": F.shiftright(told.bitwiseAND((1 << 40) - 1), 1).cast("int"), "again": told.bitwiseAND(1) == 1, **near}).drop("place", "told")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, mask: int = MASK, passage: int = PASSAGE) -> DataFrame:
    """The repeated passages of each text: (doc, row, start, end, words, first_doc,
    removed) by bytes; row tells texts of one id apart; `removed` marks the runs of a
    passage that stay in an earlier place."""
    every = chunks(df, doc_id, text, mask)
    # How often, and where least: combined before the shuffle, so any number of copies will do.
    held = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc")).where("n > 1").drop("n")
    # One shuffle by text for all that follows; what can be worked out again is left behind.
    marked = unpacked(every.join(held, "digest").select("doc", "row", "place", "told", "first_doc").repartition("doc", "row"))
    marked = marked.withColumn("later", F.col("again") | (F.col("doc") != F.col("first_doc")))
    # Runs of consecutive repeated chunks; a document's own chunks are its own size.
    by = Window.partitionBy("doc", "row").orderBy("start")
    step = F.when(F.col("start") == F.lag(F.col("start") + F.col("size")).over(by), 0).otherwise(1)
    runs = marked.dropDuplicates(["doc", "row", "start"]).withColumn("step", step).withColumn("run", F.sum("step").over(by))
    turn = F.when(F.col("later") == F.lag("later").over(Window.partitionBy("doc", "row", "run").orderBy("start")), 0).otherwise(1)
    whole = Window.partitionBy("doc", "row", "run")
    ends = {"total": F.sum("words").over(whole), "lead": F.min(F.struct("start", "lead")).over(whole)["lead"], "tail": F.max(F.struct("start", "tail")).over(whole)["tail"]}
    may = (F.col("lead") == MANY) | (F.col("tail") == MANY) | (F.col("total") + F.col("lead") + F.col("tail") >= passage)
    runs = runs.withColumns(ends).where((F.col("total") >= min_words) & may)
    runs = runs.withColumn("turn", turn).withColumn("part", F.sum("turn").over(Window.partitionBy("doc", "row", "run").orderBy("start")))
    out = runs.groupBy("doc", "row", "run", "part").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"), F.min("first_doc").alias("first_doc"), F.first("later").alias("removed"))
    # A stray chunk that happens to occur earlier stays where the passage around it stays.
    out = out.withColumn("removed", F.col("removed") & (F.col("words") >= min_words))
    return out.select("doc", "row", "start", "end", "words", "first_doc", "removed")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, mask: int = MASK, passage: int = PASSAGE) -> DataFrame:
    """df with `text` cut, and: n_repeats (passages found), repeated_words,
    removed_words, shared_with (the first documents of its passages), spans (of bytes,
    in the text as it was). Columns of these names are replaced."""
    df = df.drop("n_repeats", "repeated_words", "removed_words", "shared_with", "spans")
    span = F.struct("start", "end", "words", "first_doc", "removed")
    # A text has no more passages than it has bytes / 100: a list is no larger than its row.
    found = repeats(df, doc_id, text, min_words, mask, passage).groupBy("doc", "row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    base = numbered(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.struct(*df.columns).alias("_all")), "_id", "_text")
    out = base.join(found, ["doc", "row"], "left").select("_all.*", "spans")
    raw, gone = F.encode(F.col(text), "UTF-8"), F.filter("spans", lambda s: s["removed"])
    pieces = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["end"]))
    stops = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.octet_length(text)))
    kept = F.zip_with(pieces, stops, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    words = lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + x["words"].cast("int")).cast("long")
    spans = F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int,words:bigint,first_doc:bigint,removed:boolean>>"))
    out = out.withColumns({text: F.when(F.size(gone) > 0, F.array_join(kept, "")).otherwise(F.col(text)), "spans": spans})
    return out.withColumns({"n_repeats": F.size("spans").cast("long"), "repeated_words": words(F.col("spans")), "removed_words": words(F.filter("spans", lambda s: s["removed"])), "shared_with": F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["first_doc"])))})


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_repeats", "repeated_words", "removed_words", "shared_with", "spans")


SQL: dict[str, str] = {}
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
