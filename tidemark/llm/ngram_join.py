"""Similarity self-join on word shingles by a grouped prefix join.

A document's set is that of its distinct 5-word shingles (lower-cased A-Z), as
64-bit hashes; fewer words make one shingle, no words an empty set that links with
nothing. Two sets link when 100 * intersection >= percent * union.

1. Order. A fixed-width table counts all shingles of all documents by hash bucket.
   Rarest bucket first, then hash, is one total order for everyone: any order gives
   right results, this one keeps frequent passages out of the prefixes.
2. Prefixes. Linked sets share a token among the first n - ceil(percent/100 * n) + 1.
   Documents with the same size and prefix are one group, and the inverted lists hold
   groups; one shuffle by token makes them and drops tokens of one group only. A token
   that may be in very many documents is dealt over several lists.
3. Group pairs. Every group of a list meets the list's hub: the one in whose order the
   token stands foremost (the original among its edited copies), in later rounds a
   random one of the lists that still span several components. Pairs of groups that
   size or position rule out are filtered; the rest are made distinct and expanded to
   their members (distinct sets); bitmaps of the whole sets filter those, and each
   member's nearest hub is verified on whole sets. Rounds end when one links nothing
   new. Then all pairs of groups that meet in a list and span several components are
   filtered, expanded and verified likewise, so no link between components is lost.
4. Links. Each lies within a component, so the sets of a component are dealt into
   blocks, and every pair of blocks is compared whole in one task, which counts the
   links of each set; no pair leaves the task. Work is quadratic in the different texts
   of one component; equal sets count as one with their number of copies.

Results: component_id, the least doc_id reachable by links, and n_links, the number of
other documents linked to the document. Defined results: null text is empty and has
no links; a null doc_id links with nothing (component null); rows that repeat a doc_id
are one document that links through any of its texts, and n_links is that of the row's
text; texts of any length are compared whole; equal rows get equal results; columns
other than id and text do not enter; empty table, empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, free, give_back, int64, mix, read, released, slices, small_batches, span_hashes, stored, word_spans
from .components import components

WORDS = 5
PERCENT = 75
#: Buckets of the frequency table: 4 MB, whatever the corpus. A count is kept in one byte,
#: on a scale of so many steps to a doubling: up to 2**31, counts below ten all different.
BUCKETS = 1 << 22
STEPS = 8
BLOCK = 1 << 14
STAR_ROUNDS = 3
#: Texts that a task takes into numpy at a time.
ROWS = 1024
#: Occurrences of a token's bucket from which its list is dealt out, and so many to a part.
HOT = 1 << 17
#: Partners of a document that meet it in one task.
VERIFY_BLOCK = 1024
#: Sets of 512 shingles in a block when the links of a component are counted.
LINK_BLOCK = 2048
#: How many lists back a pair of groups is sought, so that it is made once or twice and not in every common list.
LAST = (1, 2, 3, 4)
#: Words of 64 bits in a parity bitmap.
BITMAP = 8
#: Ids up to this many (8 bytes each) are broadcast to pick documents; beyond, a shuffled join picks them.
BROADCAST_IDS = 1 << 20

_C = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, data, at in slices(texts):
        starts, ends, _ = word_spans(data, at)
        h = span_hashes(data, starts, ends, lower=True)
        bounds = np.searchsorted(starts, at)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for j in range(words):
            rolled += h[j : j + len(rolled)] * _C[j]
        rolled = mix(rolled)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                yield mix((h[lo:hi] * _C[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _set_key(s: np.ndarray, salt: int) -> int:
    """An order-free 64-bit digest of a set."""
    return int(mix(s + np.uint64(salt)).sum()) if len(s) else 0


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all, after a byte that says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpacked(raw) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def parity_bitmap(s: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """For each of 64 * words hash values whether an odd number of tokens has it. Two
    sets differ in at least as many tokens as their bitmaps differ in bits. The halves of
    a bitmap, combined by exclusive or, are the bitmap of half its words."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_words(n: int) -> int:
    """Words of the bitmap of a set of n tokens: a power of two, two bits a token or more."""
    return max(BITMAP, 1 << max(0, (2 * n - 1).bit_length() - 6)) if n else BITMAP


def scaled(counts: np.ndarray) -> np.ndarray:
    return np.rint(STEPS * np.log2(np.minimum(counts, 2**31 - 2) + 1.0)).astype(np.uint8)


def unscaled(steps: np.ndarray) -> np.ndarray:
    """About the counts: 5 % off at most, exact below ten."""
    return np.rint(2.0 ** (steps / STEPS) - 1).astype(np.int64)


def bucket_counts(df: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingles per hash bucket over all texts: BUCKETS numbers on the scale of STEPS,
    added up in blocks."""

    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for s in shingle_sets(b.column(0), words):
                np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
        for k in range(0, BUCKETS, BLOCK):
            part = total[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed(part)], pa.binary())], ["k", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += unpacked(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([scaled(total).tobytes()], pa.binary())], ["k", "counts"])

    out = np.zeros(BUCKETS, np.uint8)
    for row in df.select(text).mapInArrow(released(count), "k long, counts binary").groupBy("k").applyInArrow(add, "k long, counts binary").collect():  # 256 blocks of 16 KB
        out[row.k : row.k + BLOCK] = np.frombuffer(row.counts, np.uint8)
    return out


def _ordered(s: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The first `size` tokens of a sorted set in the global order."""
    rank = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")[:size]]


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, links: bool = True, hot: int = HOT, block: int = LINK_BLOCK) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id and, if `links`, n_links.
    All Python runs in here; what is returned joins stored tables."""
    with small_batches(df.sparkSession):
        return _similar(df, doc_id, text, words, percent, star_rounds, links, hot, block)


def _similar(df: DataFrame, doc_id: str, text: str, words: int, percent: int, star_rounds: int, links: bool, hot: int, block: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    bitmap = [f"b{j}" for j in range(BITMAP)]
    shared = spark.sparkContext.broadcast(bucket_counts(docs, "text", words))
    give_back()

    def describe(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                n, k1, k2, g, bits, first, wide = [], [], [], [], [], [], [np.zeros(0, np.int64)]
                for s in shingle_sets(part.column("text"), words):
                    p = _ordered(s, shared.value, prefix_length(len(s), percent))
                    n.append(len(s))
                    k1.append(_set_key(s, 1))
                    k2.append(_set_key(s, 2))
                    g.append(_set_key(p, len(s) + 3))
                    bits.append(parity_bitmap(s))
                    first.append(p.tobytes())
                    wide.append(parity_bitmap(s, wide_words(len(s))))
                ends = np.cumsum([len(x) for x in wide]).astype(np.int32)
                wide = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wide)))
                bits = np.array(bits, np.int64).reshape(-1, BITMAP)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int32()), *(int64(np.array(x, np.uint64)) for x in (k1, k2, g)), *(pa.array(bits[:, j]) for j in range(BITMAP)), pa.array(first, pa.binary()), wide], ["doc", "n", "k1", "k2", "g", *bitmap, "prefix", "wide"])

    def tokens(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                flat = np.frombuffer(b"".join(part.column("prefix").to_pylist()), np.uint64)
                sizes = pa.compute.binary_length(part.column("prefix")).to_numpy() // 8
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                g = np.repeat(part.column("g").to_numpy(), sizes)
                # a token that may be in very many documents is dealt over several lists
                much = unscaled(shared.value[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)]) // hot
                salt = np.where(much > 0, 1 + mix(g.view(np.uint64)).astype(np.int64) % (much + 1), 0)
                yield pa.RecordBatch.from_arrays([int64(flat), pa.array(salt.astype(np.int32)), pa.array(g), pa.array(np.repeat(part.column("n").to_numpy(), sizes)), pa.array(pos.astype(np.int32))], ["token", "salt", "g", "n", "pos"])

    described = stored(docs.mapInArrow(released(describe), "doc long, n int, k1 long, k2 long, g long, " + ", ".join(f"{x} long" for x in bitmap) + ", prefix binary, wide array<long>"), "sets")
    own = ["n", "k1", "k2"]
    real = described.where("n > 0 and doc is not null")
    sets = stored(real.groupBy(*own, "g").agg(F.min("doc").alias("node"), F.countDistinct("doc").alias("copies"), *(F.max(x).alias(x) for x in (*bitmap, "wide"))), "members")
    marks = stored(sets.select("node", "g", "n", *bitmap).dropDuplicates(["node", "g"]), "marks")

    # Inverted lists of groups. In a list of two there is one pair; of longer lists all rows are kept.
    by = Window.partitionBy("token", "salt")
    lists = real.select("g", "n", "prefix").mapInArrow(released(tokens), "token long, salt int, g long, n int, pos int")
    lists = lists.withColumns({"lo": F.min("g").over(by), "hi": F.max("g").over(by)}).where("lo <> hi or salt > 0")
    lists = lists.withColumns({"many": (F.col("salt") > 0) | F.max((F.col("g") != F.col("lo")) & (F.col("g") != F.col("hi"))).over(by), "hub": F.min(F.struct("pos", "g", "n")).over(by)})
    size = f"{percent}L * greatest(n, {{y}}n) <= 100L * least(n, {{y}}n)"
    place = f"(100L + {percent}L) * (least(pos, {{y}}pos) + least(n - pos, {{y}}n - {{y}}pos)) >= {percent}L * (n + {{y}}n)"
    passes = lambda y: " and ".join(x.format(y=y) for x in (size, place))
    lists = stored(lists.where(F.col("many") | (F.col("g") != F.col("hub.g")) & F.expr(passes("hub."))).select("token", "salt", "g", "n", "pos", "hub", "many").distinct(), "lists")
    group_pairs = lambda rows: rows.where("g <> hub.g").where(passes("hub.")).select("g", F.col("hub.g").alias("h"), (~F.col("many")).alias("two")).groupBy("g", "h").agg(F.max("two").alias("two"))

    # Groups of several sets: their members meet their least one; `inner` for the last round.
    least = stored(marks.groupBy("g").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("members")), "least")
    inner = stored(marks.join(least.where("members > 1"), "g").select("g", "node", "rep"), "inner")
    where_from = described.select("doc", *own).where("doc is not null").join(sets.select(*own, "node"), own).select("doc", "node")
    repeats = where_from.groupBy("doc").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    edges = stored(where_from.join(repeats, "doc").select(F.col("lo").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "links")

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets that size and bitmaps leave, and by how many bits they
        differ. Where one folding does not make bitmaps equally long, nothing is ruled out."""
        x = sets.select(F.col("node").alias("a"), "n", F.col("wide").alias("p"))
        y = sets.select(F.col("node").alias("b"), F.struct("n").alias("y"), F.col("wide").alias("q"))
        folded = lambda p, q: F.expr(f"case when size({p}) > size({q}) then transform(sequence(0, size({p}) div 2 - 1), i -> {p}[i] ^ {p}[i + size({p}) div 2]) else {p} end")
        both = pairs.join(x, "a").join(y, "b").where(size.format(y="y.")).withColumns({"p": folded("p", "q"), "q": folded("q", "p")})
        both = both.withColumn("bits", F.expr("case when size(p) = size(q) then aggregate(zip_with(p, q, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) else 0 end"))
        return both.where(f"(100L + {percent}L) * bits <= (100L - {percent}L) * (n + y.n)").select("a", "b", "bits")

    comp = None

    def joined(*found: DataFrame) -> DataFrame:
        """The components with what is found: those of before, each a star, and new links."""
        before = edges if comp is None else comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(components(union([before, *found])), "components")

    def grouped_components() -> DataFrame:
        """Of each group the least and the largest component of its sets."""
        named = marks.select("g", "node").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
        return named.groupBy("g").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))

    twos = None
    for turn in range(star_rounds):
        if turn:
            # another hub in each list that still spans several components
            again = Window.partitionBy("token", "salt")
            rows = lists.where("many").join(grouped_components(), "g").withColumns({"least": F.min("c_lo").over(again), "most": F.max("c_hi").over(again)}).where("least <> most")
            rows = rows.withColumn("hub", F.min(F.struct(F.xxhash64("g", "token", F.lit(turn)).alias("h"), "pos", "g", "n", "c_lo", "c_hi")).over(again))
            met = group_pairs(rows.where("c_lo <> hub.c_lo or c_lo <> c_hi or hub.c_lo <> hub.c_hi"))
        else:
            met = stored(group_pairs(lists), "met")
            twos = met.where("two").select("g", "h")
        # expanded: every member of the one group with one member of the other
        met = met.select("g", "h").join(marks.select("g", F.col("node").alias("a")), "g").join(least.select(F.col("g").alias("h"), F.col("rep").alias("b")), "h").select("a", "b")
        if not turn:
            met = met.unionByName(inner.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
        nearest = alike(met.where("a <> b").distinct()).groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", "m.b")
        found = stored(verified(docs, nearest, words, percent), "links")
        if turn and found.isEmpty():
            break
        comp = joined(found)
    # What is left: all pairs of groups that meet in a list and span several components.
    if comp is None:
        comp = joined()
        twos = group_pairs(lists.where("not many")).select("g", "h")
    # A pair is made in the first list that both groups are in: not where one of the
    # last few lists of both is the same.
    named = grouped_components().join(marks.groupBy("g").agg(F.count(F.lit(1)).alias("members"), *(F.max(x).alias(x) for x in bitmap)), "g")
    tagged = lists.where("many").select("token", "g", "n", "pos").distinct().join(stored(named, "grouped"), "g")
    apart = tagged.groupBy("token").agg(F.min("c_lo").alias("least"), F.max("c_hi").alias("most")).where("least <> most").select("token")
    along = Window.partitionBy("g").orderBy("pos", "token")
    left = tagged.join(apart, "token").withColumns({f"t{k}": F.lag("token", k).over(along) for k in LAST})
    right = left.select(F.col("token").alias("t"), F.struct(*(c for c in left.columns if c != "token")).alias("y"))
    differ = "(c_lo <> y.c_lo or c_lo <> c_hi or y.c_lo <> y.c_hi)"
    bits = " + ".join(f"bit_count({x} ^ y.{x})" for x in bitmap)
    near = f"(members > 1 or y.members > 1 or (100L + {percent}L) * ({bits}) <= (100L - {percent}L) * (n + y.n))"
    first = " and ".join(f"not coalesce(t{k} in ({', '.join(f'y.t{j}' for j in LAST)}), false)" for k in LAST)
    rest = left.join(right, F.expr(f"token = t and g < y.g and {differ} and {passes('y.')} and {near} and {first}")).select("g", F.col("y.g").alias("h")).unionByName(twos).distinct()
    member = marks.select("g", "node").join(comp, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c"))
    x, y = member.select("g", F.col("node").alias("a"), "c"), member.select(F.col("g").alias("h"), F.col("node").alias("b"), F.col("c").alias("d"))
    rest = rest.join(x, "g").join(y, "h").where("c <> d").select("a", "b")
    mates = inner.select("g", "node").join(comp, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c"))
    within = mates.join(mates.select("g", F.col("node").alias("b"), F.col("c").alias("d")), "g").where("node < b and c <> d").select(F.col("node").alias("a"), "b")
    rest = alike(rest.unionByName(within).distinct()).select("a", "b")
    found = stored(verified(docs, rest, words, percent), "links")
    if not found.isEmpty():
        comp = joined(found)
    named = sets.select(*own, "node", "copies").join(comp, "node", "left").select(*own, "node", "copies", F.coalesce("component", "node").alias("c"))
    if links:
        several = named.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        counted = stored(linked(docs, named.join(several, "c").select("node", "copies", *own, "c", "m"), words, percent, block), "n_links")
        named = named.join(counted, own, "left").withColumn("n_links", F.coalesce("linked", F.lit(0).cast("long")) + F.col("copies") - 1)
    out = described.select("doc", *own).join(named.drop("node", "copies"), own, "left")
    out = out.withColumn("c", F.when(F.col("doc").isNotNull(), F.coalesce("c", "doc")))
    more = [F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id"), *more)


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _chosen(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of docs named by (doc, ...), with those columns."""
    if names.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(names), "doc")
    return among(docs, "doc", names.select("doc")).join(names, "doc")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link, some twice. The set of a is sent to that of b; of
    a b with very many partners, copies go to blocks of them."""
    pairs = stored(pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(1 << 30)).cast("int")), "pairs")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK).cast("int").alias("blocks"))
    sent = pairs.join(many, "b").select(F.col("a").alias("doc"), F.col("b").alias("to"), (F.col("block") % F.col("blocks")).alias("block"))
    sent = stored(sent.unionByName(many.select(F.col("b").alias("doc"), F.col("b").alias("to"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))), "sent")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        to, ids = key[0].as_py(), table.column("doc").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        found = set()
        for y in (s for i, s in zip(ids, sets) if i == to):
            for i, x in zip(ids, sets):
                if i != to and i not in found and len(x) and len(y):
                    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if same and 100 * same >= percent * (len(x) + len(y) - same):
                        found.add(int(i))
        return pa.table({"a": pa.array([min(i, to) for i in found], pa.int64()), "b": pa.array([max(i, to) for i in found], pa.int64())})

    packed = _packed(_chosen(docs, sent), words, "doc long, to long, block int")
    return packed.groupBy("to", "block").applyInArrow(compare, "a long, b long")


def _packed(rows: DataFrame, words: int, schema: str) -> DataFrame:
    """The rows with their set `s` (bytes) in place of their text."""
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())], [*names, "s"])

    return rows.select(*names, "text").mapInArrow(released(pack), schema + ", s binary")


def linked(docs: DataFrame, members: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """For each set in a component (node, copies, n, k1, k2, c, m) how many documents
    its links to other sets reach: n, k1, k2, linked. A link lies within a component;
    its sets are dealt into blocks, and every pair of blocks meets in a task, which
    counts and sends no pair on."""
    own = ["n", "k1", "k2"]
    dealt = members.withColumn("blocks", F.ceil(F.col("m") * F.greatest(F.col("n"), F.lit(512)) / (512 * block)).cast("int"))
    dealt = dealt.drop("blocks").join(dealt.groupBy("c").agg(F.max("blocks").alias("blocks")), "c")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*own), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = stored(dealt.select(F.col("node").alias("doc"), "copies", *own, "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"), "dealt")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        # a document with several texts has several sets; each row asks for one of them
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        true = [k for k, s in enumerate(sets) if len(s) and np.uint64(_set_key(s, 1)).astype(np.int64) == k1[k] and np.uint64(_set_key(s, 2)).astype(np.int64) == k2[k]]
        true = [k for _, k in sorted({(k1[k], k2[k]): k for k in true}.items())]
        side, copies = table.column("own").to_numpy()[true], table.column("copies").to_numpy()[true]
        sets = [sets[k] for k in true]
        total = np.zeros(len(true), np.int64)
        if len(true) > 1:
            n = np.array([len(s) for s in sets])
            begin = np.cumsum(n) - n
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            held = np.zeros(flat.max() + 1, np.uint8)
            for k in np.flatnonzero(side == i):
                mine = flat[begin[k] : begin[k] + n[k]]
                held[mine] = 1
                same = np.add.reduceat(held[flat], begin, dtype=np.int64)
                held[mine] = 0
                hit = 100 * same >= percent * (n[k] + n - same)
                hit &= side == j
                hit[k] = False
                total[k] += copies[hit].sum()
                if i != j:
                    total[hit] += copies[k]
        take = lambda c: table.column(c).take(pa.array(true, pa.int64()))
        return pa.table({"n": take("n"), "k1": take("k1"), "k2": take("k2"), "linked": pa.array(total)})

    schema = "doc long, copies long, n int, k1 long, k2 long, c long, i int, j int, own int"
    packed = _packed(_chosen(docs, dealt), words, schema)
    return packed.groupBy("c", "i", "j").applyInArrow(count, "n int, k1 long, k2 long, linked long").groupBy(*own).agg(F.sum("linked").alias("linked"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that stay: of each component the row with the least doc_id.
    Rows without an id, or without words, stay."""
    own = free(df, "gone")
    gone = stored(similar(df, doc_id, text, links=False, **options).where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct(), "gone")
    mine = F.col(doc_id) == F.col(own)
    return among(df, doc_id, gone).join(gone, mine, "left_anti").unionByName(among(df, doc_id, gone, yes=False))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))


SQL = {
    "op2_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                   ELSE list_distinct([w[i:i + 4] for i in range(1, len(w) - 3)]) END AS s FROM words
        ), tokens AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, coalesce(l.n, 0)::BIGINT AS n_links
        FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
        LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON l.a = s.doc_id
    """
}
QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
