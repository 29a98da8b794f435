"""Scoring texts with a bigram model kept in sharded Elias-Fano tries.

Documents are dealt into blocks. Every block sends its distinct words, with their
training counts, to shards by hash, which answer with the counts over the whole
corpus. It then sends its distinct word pairs, with their counts, to the shard of the
first word (of a very frequent first word, of the second: then no shard holds more
than a share of it). A shard merges the pairs of all blocks into a trie: contexts,
pointers, successors and quantised smoothed probabilities, queried by all blocks. The
answers go back and each block adds up its texts. Everything sent is a byte array per
block and shard, so what is shuffled grows with the distinct words and pairs of the
blocks, in proportion to the input; no task or driver holds the model whole.

P(w | v) = (1 - A) * P1(w) + A * c(v, w) / c(v), with P1 the unigram estimate
(c(w) + 0.5) / (N + 0.5 * (V + 1)); after a v not seen in training P1(w). Pairs with
a word that only one block has are counted there and never sent.

Defined results: a null text is empty and has one token, the end; a null id is in
training (its remainder is not 1); rows that repeat are counted each; with nothing to
learn from, every word is unknown (N = 0); a text is scored whole, however long (its
block holds it in one task); other columns do not enter; an empty table gives no rows.
"""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, read, slices, small_batches, span_hashes, stored, word_spans
from .elias_fano import ABSENT, STEPS, SUCCESSOR_BITS, Trie
from .language_id import held_out

PAIR_WEIGHT = 0.2
BLOCK_BYTES = 1 << 24
LEAST_BLOCKS = 16
#: What stands for the end and the start of a text.
END, START = np.uint64(0xE5D0E5D0E5D0E5D1), np.uint64(0x57A2757A2757A275)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct numbers of x and the place of each x among them: np.unique with
    its inverse, by fewer and smaller arrays. Fewer than 2**31 numbers."""
    order = np.argsort(x).astype(np.int32)
    x = x[order]
    head = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=head[1:])
    x = x[head]
    place = np.empty(len(head), np.int32)
    place[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return x, place


def tally(place: np.ndarray, counted: np.ndarray, size: int) -> np.ndarray:
    """How many of the places that are counted are 0, 1, ..., size - 1."""
    out = np.zeros(size, np.int32)
    np.add.at(out, place[counted], np.int32(1))
    return out


class Block:
    """The tokens of some texts: distinct words in hash order, and their places."""

    def __init__(self, table: pa.Table):
        parts = []
        for chunk in table.column("text").chunks:
            for _, data, at in slices(chunk):
                starts, ends, _ = word_spans(data, at)
                h = span_hashes(data, starts, ends, lower=True)
                parts.append(np.insert(h, np.searchsorted(starts, at[1:]), END))
        tokens = np.concatenate(parts)
        del parts
        last = np.flatnonzero(tokens == END)
        self.sizes = np.diff(last, prepend=-1)
        self.first = last + 1 - self.sizes
        self.words, self.place = distinct(tokens)
        training = ~table.column("held_out").to_numpy()
        self.counted = np.repeat(training, self.sizes)
        self.counts = tally(self.place, self.counted, len(self.words))

    def shards(self, shards: int) -> np.ndarray:
        return _shard(self.words, shards)

    def learn(self, answers: dict[int, dict], shards: int) -> None:
        got = np.concatenate([np.frombuffer(answers[s]["data"], "<u8") for s in range(shards)])
        self.total = (got >> np.uint64(1)).astype(np.int64)
        self.only_here = (got & np.uint64(1)).astype(bool)
        self.n = sum(answers[s]["n"] for s in range(shards))
        self.v = sum(answers[s]["v"] for s in range(shards))
        self.log_p1 = np.log10((self.total + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def pair(self, shards: int) -> None:
        """The distinct pairs, and which of them go to which shard."""
        u = len(self.words)
        keys = np.empty(len(self.place), np.int64)
        keys[1:] = self.place[:-1]
        keys[self.first] = u  # the start
        keys *= u + 1
        keys += self.place
        keys, self.pair_place = distinct(keys)
        self.one = (keys // (u + 1)).astype(np.int32)
        keys %= u + 1
        self.two = keys.astype(np.int32)
        del keys
        self.pair_counts = tally(self.pair_place, self.counted, len(self.one))
        texts = self.total[np.searchsorted(self.words, END)]
        self.context = np.append(self.total, texts)
        here = np.append(self.only_here, False)
        known = (self.context[self.one] > 0) & (self.total[self.two] > 0)
        sent = np.flatnonzero(known & ~here[self.one] & ~self.only_here[self.two]).astype(np.int32)
        self.hashes = np.append(self.words, START)
        of, hot = _shard(self.hashes, shards).astype(np.int32), self.context > self.n / (4 * shards)
        shard = np.where(hot[self.one[sent]], of[self.two[sent]], of[self.one[sent]])
        order = np.argsort(shard, kind="stable").astype(np.int32)
        self.sent, self.sent_shard = sent[order], shard[order]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _rows(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_WORDS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_PAIRS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("contexts", pa.binary()), ("seen", pa.binary()), ("sizes", pa.binary()), ("successors", pa.binary()), ("counts", pa.binary()), ("p1", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int32": "int", "int64": "long", "binary": "binary", "bool": "boolean", "double": "double"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def _small(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    return kind[-1].encode() + counts.astype(kind).tobytes()


def _large(raw) -> np.ndarray:
    return np.frombuffer(raw, f"<u{bytes(memoryview(raw)[:1]).decode()}", offset=1).astype(np.int64)


def looked_up(rows: list[dict], weight: float) -> list[np.ndarray]:
    """The probability codes of the pairs of each row, from the trie of the pairs of them
    all. Equal pairs are sought once; what is as long as all rows is a key, then a place."""
    contexts = [np.frombuffer(r["contexts"], "<u8") for r in rows]
    sizes = [_large(r["sizes"]) for r in rows]
    every, place = np.unique(np.concatenate(contexts), return_inverse=True)
    seen = np.zeros(len(every))
    seen[place] = np.concatenate([_large(r["seen"]) for r in rows])
    ends = np.cumsum([x.sum() for x in sizes])
    spans = [slice(int(hi - x.sum()), int(hi)) for x, hi in zip(sizes, ends)]
    keys, mask = np.empty(int(ends[-1]), np.uint64), np.uint64((1 << SUCCESSOR_BITS) - 1)
    for r, x, own, number in zip(rows, sizes, spans, np.split(place, np.cumsum([len(c) for c in contexts])[:-1])):
        wide = np.zeros((own.stop - own.start, 8), np.uint8)
        wide[:, : SUCCESSOR_BITS // 8] = np.frombuffer(r["successors"], np.uint8).reshape(-1, SUCCESSOR_BITS // 8)
        keys[own] = np.repeat(number, x).astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | wide.view("<u8").ravel()
    merged, where = distinct(keys)
    del keys
    total, p1 = np.zeros(len(merged), np.int64), np.zeros(len(merged), np.uint16)
    for r, own in zip(rows, spans):
        np.add.at(total, where[own], _large(r["counts"]))
        p1[where[own]] = np.frombuffer(r["p1"], "<u2")
    kept = total > 0
    of = (merged[kept] >> np.uint64(SUCCESSOR_BITS)).astype(np.int32)
    p = (1 - weight) * 10.0 ** (-p1[kept].astype(np.float64) / STEPS) + weight * total[kept] / seen[of]
    del total, p1
    model = Trie(Trie.image(every, np.bincount(of, minlength=len(every)), merged[kept] & mask, np.log10(np.minimum(p, 1))))
    del of, p
    code = model.lookup(every, merged & mask, (merged >> np.uint64(SUCCESSOR_BITS)).astype(np.int32))
    return [code[where[own]] for own in spans]


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held: str = "held_out", weight: float = PAIR_WEIGHT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Rows where `held` is true are not learned from."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(LEAST_BLOCKS, -(-size // block_bytes))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(held).alias("held_out"), F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int").alias("block"))
    docs = docs.repartition(F.col("block"))

    def words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table)
        cut = np.searchsorted(b.shards(shards), np.arange(shards + 1))
        out = [[], [], [], []]
        for s in range(shards):
            lo, hi = cut[s], cut[s + 1]
            for column, x in zip(out, (key[0].as_py(), s, b.words[lo:hi].tobytes(), _small(b.counts[lo:hi]))):
                column.append(x)
        return _rows(out, _WORDS)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        counts = [_large(x) for x in table.column("counts").to_pylist()]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.uint64)
        single = np.bincount(place, minlength=len(every)) == 1
        answer = np.split((total << np.uint64(1) | single.astype(np.uint64))[place], np.cumsum([len(h) for h in hashes])[:-1])
        n, v = int(total.sum()), int((total > 0).sum())
        blocks = table.column("block").to_pylist()
        return _rows([blocks, [key[0].as_py()] * len(blocks), [1] * len(blocks), [a.astype("<u8").tobytes() for a in answer], [n] * len(blocks), [v] * len(blocks)], _ANSWER)

    def answers(table: pa.Table, kind: int) -> dict[int, dict]:
        return {r["shard"]: r for r in table.to_pylist() if r["kind"] == kind}

    def pairs(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left)
        b.learn(answers(right, 1), shards)
        b.pair(shards)
        out = [[] for _ in _PAIRS]
        cut = np.searchsorted(b.sent_shard, np.arange(shards + 1))
        code = np.clip(np.rint(-b.log_p1 * STEPS), 0, ABSENT).astype("<u2")
        for s in range(shards):
            mine = b.sent[cut[s] : cut[s + 1]]
            if not len(mine):
                continue
            heads = np.flatnonzero(np.diff(b.one[mine], prepend=-1))
            tails = b.words[b.two[mine]] >> np.uint64(64 - SUCCESSOR_BITS)
            short = np.ascontiguousarray(tails.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8]
            made = (key[0].as_py(), s, b.hashes[b.one[mine[heads]]].tobytes(), _small(b.context[b.one[mine[heads]]]), _small(np.diff(np.append(heads, len(mine)))), np.ascontiguousarray(short).tobytes(), _small(b.pair_counts[mine]), code[b.two[mine]].tobytes())
            for column, x in zip(out, made):
                column.append(x)
        return _rows(out, _PAIRS)

    def trie(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = [{name: table.column(name)[k].as_buffer() for name in table.schema.names[2:]} for k in range(table.num_rows)]
        cut = looked_up(rows, weight)
        blocks = table.column("block").to_pylist()
        return _rows([blocks, [key[0].as_py()] * len(blocks), [2] * len(blocks), [x.tobytes() for x in cut], [0] * len(blocks), [0] * len(blocks)], _ANSWER)

    def add(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left)
        b.learn(answers(right, 1), shards)
        b.pair(shards)
        # Pairs not sent: counted here where one of their words is only here, else unseen.
        seen = b.context[b.one] > 0
        ratio = np.where(seen, b.pair_counts / np.maximum(b.context[b.one], 1), 0)
        log_p = np.where(seen, np.log10((1 - weight) * 10.0 ** b.log_p1[b.two] + weight * ratio), b.log_p1[b.two])
        back = answers(right, 2)
        if len(b.sent):
            code = np.concatenate([np.frombuffer(back[s]["data"], "<u2") for s in sorted(back)])
            absent = np.log10(1 - weight) + b.log_p1[b.two[b.sent]]
            log_p[b.sent] = np.where(code == ABSENT, absent, -code.astype(np.float64) / STEPS)
        sums = lambda x: np.add.reduceat(x, b.first)
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(b.sizes), pa.array(sums((b.total[b.place] > 0).astype(np.int64))), pa.array(np.full(len(b.sizes), b.n, np.int64)), pa.array(sums(b.log_p1[b.place])), pa.array(sums(log_p[b.pair_place]))], schema=_SCORES)

    by = docs.groupBy("block")
    first = by.applyInArrow(_lean(words), _ddl(_WORDS)).groupBy("shard").applyInArrow(_lean(count), _ddl(_ANSWER))
    sent = by.cogroup(first.groupBy("block")).applyInArrow(_lean(pairs), _ddl(_PAIRS))
    second = sent.groupBy("shard").applyInArrow(_lean(trie), _ddl(_ANSWER))
    with small_batches(df.sparkSession):
        return stored(by.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(_lean(add), _ddl(_SCORES)), "scores")


def _lean(work):
    """A function on groups (key, table) or (key, left, right) that gives what a group has
    freed back to the system; Spark counts its parameters, so there are two."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return work(key, table)
        finally:
            give_back()

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(key, left, right)
        finally:
            give_back()

    return two if len(inspect.signature(work).parameters) == 3 else one


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 1))
    return score(docs)


SQL: dict[str, str] = {}
QUERIES = {"op8_lm_scoring": op8_lm_scoring}
