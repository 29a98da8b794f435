"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of its byte n-grams (those
that touch a word's edge are its affixes) and of the word itself (the lexicon), all
hashed into fixed tables; transitions between the labels of neighbouring words are
learned too, on sequences spliced from texts of different languages. Forward and
backward passes give each word's label probabilities, so code-switched text is
labelled word by word; a document's language is the label with the largest mean
probability over the words that have letters, and that mean is its score.

The passes run over blocks of a fixed number of words, tied together by transfer
matrices, so a huge document takes no more steps than a short one.

The model is fitted on the driver on a bounded sample: for each label at most
`per_label` whole texts of `label_bytes` bytes in all, those with the smallest hash of
their id (a text that would go beyond is passed over); more than MOST_LABELS labels
are an error. Prediction reads the whole text of every row, of any length, and nothing
but the text.

Defined results: null text, or text without a letter, is `und` with score 0; without
any labelled row every row is `und`; a null lang is no label; a null id is never
learned from and not held out; equal texts and repeated rows get equal results; other
columns pass through, and ones named like the results are replaced; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, free, give_back, mix, read, released, slices

UNKNOWN = "und"
#: The bounds of the training sample: texts and bytes of a label, and labels.
PER_LABEL = 80
LABEL_BYTES = 1 << 21
MOST_LABELS = 256
SIZES = (2, 3, 4)
TABLE_BITS = 16
BLOCK_WORDS = 256
EPOCHS = 30
RATE = 0.5
DECAY = 1e-5


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # [tables, 2**TABLE_BITS, labels]
    transitions: np.ndarray  # [labels, labels], log scale


@dataclass
class Words:
    """The words of some texts, with the table rows of their features."""

    bounds: np.ndarray  # [texts + 1]
    rows: list[np.ndarray]  # for each n-gram size, the table row at each byte
    spans: list[tuple[np.ndarray, np.ndarray]]  # and the range of those rows for each word
    lexicon: np.ndarray  # [words]
    letters: np.ndarray  # [words]: has a letter

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = weights[-1][self.lexicon].astype(np.float64)
        for rows, (lo, hi), w in zip(self.rows, self.spans, weights):
            sums = np.zeros((len(rows) + 1, w.shape[1]))
            np.cumsum(w[rows], axis=0, out=sums[1:])
            out += sums[hi] - sums[lo]
        out[~self.letters] = 0
        return out

    def spread(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient of the weights, from that of the emissions."""
        gradient = np.where(self.letters[:, None], gradient, 0)
        size, labels = 1 << TABLE_BITS, gradient.shape[1]
        out = np.zeros((len(self.rows) + 1, size, labels))
        for k, (rows, (lo, hi)) in enumerate(zip(self.rows, self.spans)):
            for y in range(labels):
                steps = np.bincount(lo, gradient[:, y], len(rows) + 1) - np.bincount(hi, gradient[:, y], len(rows) + 1)
                out[k, :, y] = np.bincount(rows, np.cumsum(steps)[:-1], size)
        for y in range(labels):
            out[-1, :, y] = np.bincount(self.lexicon, gradient[:, y], size)
        return out


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of a slice of texts; a space stands before, between and after them."""
    n = len(at) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)
    keep = np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(at))
    text[keep] = np.where(_SPACE[data], np.uint8(32), _LOWER[data])
    inside = text != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    bounds = np.searchsorted(starts, at + np.arange(n + 1))
    code, rows, spans = text.astype(np.uint64), [], []
    shift = np.uint64(64 - TABLE_BITS)
    for size in SIZES:
        key = np.full(max(0, len(text) - size + 1), size, np.uint64)
        for j in range(size):
            key = key * np.uint64(257) + code[j : j + len(key)]
        rows.append((mix(key) >> shift).astype(np.int64))
        lo = np.minimum(starts - 1, len(key))
        spans.append((lo, np.minimum(np.maximum(lo, ends - size + 2), len(key))))
    from .common import span_hashes

    letter = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text >= 128) | ((text >= 97) & (text <= 122)), out=letter[1:])
    return Words(bounds, rows, spans, (span_hashes(text, starts, ends) >> shift).astype(np.int64), letter[ends] > letter[starts])


def marginals(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over the sequences [bounds[i], bounds[i + 1]): the label
    probabilities of each word, and the expected transitions, summed."""
    total, y = emissions.shape
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK_WORDS)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = bounds[owner] + number * BLOCK_WORDS
    size = np.minimum(BLOCK_WORDS, bounds[owner + 1] - begin)
    if not total:
        return np.zeros((0, y)), np.zeros((y, y))
    order = np.argsort(-size, kind="stable")
    begin, size, owner, number = begin[order], size[order], owner[order], number[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # blocks with more than t words
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(transitions - transitions.max())
    # Before the first word of a text every label is as likely: no transition is paid there.
    first = number == 0
    # The transfer matrix of each block, needed where a text has several.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    several = blocks.max() > 1
    enter = np.ones((len(order), y)) / y
    leave = np.ones((len(order), y))
    if several:
        m = np.broadcast_to(np.eye(y), (len(order), y, y)).copy()
        for t, n in enumerate(active):
            m[:n] = (np.where(first[:n, None, None], 1.0 / y, a[None]) if t == 0 else m[:n] @ a) * e[begin[:n] + t][:, None, :]
            m[:n] /= m[:n].max(axis=(1, 2), keepdims=True)
        starts = np.cumsum(blocks) - blocks
        for k in range(1, int(blocks.max())):
            who = np.flatnonzero(blocks > k)
            now, before = place[starts[who] + k], place[starts[who] + k - 1]
            v = np.einsum("by,byz->bz", enter[before], m[before])
            enter[now] = v / v.sum(axis=1, keepdims=True)
            now, after = place[starts[who] + blocks[who] - 1 - k], place[starts[who] + blocks[who] - k]
            v = np.einsum("byz,bz->by", m[after], leave[after])
            leave[now] = v / v.sum(axis=1, keepdims=True)
    alpha, inward = np.empty((total, y)), np.empty((total, y))
    state = enter.copy()
    for t, n in enumerate(active):
        came = state[:n] @ a
        if t == 0:
            came[first[:n]] = 1.0 / y
        inward[begin[:n] + t] = state[:n]
        v = came * e[begin[:n] + t]
        state[:n] = v / v.sum(axis=1, keepdims=True)
        alpha[begin[:n] + t] = state[:n]
    beta = np.empty((total, y))
    state = leave.copy()
    expected = np.zeros((y, y))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        beta[at] = state[:n]
        back = state[:n] * e[at]
        pair = inward[at][:, :, None] * a[None] * back[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        if t == 0:
            pair = pair[~first[:n]]
        expected += pair.sum(axis=0)
        v = back @ a.T
        state[:n] = v / v.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), expected


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the field to spliced sequences: texts are cut into runs of 10 to 60 words,
    the runs shuffled, and sequences made of eight each."""
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    runs: list[tuple[str, int, int]] = []
    for text, lang in zip(texts, langs):
        w, at = text.split(), 0
        while at < len(w):
            n = int(rng.integers(10, 61))
            runs.append((" ".join(w[at : at + n]), len(w[at : at + n]), number[lang]))
            at += n
    runs = [runs[k] for k in rng.permutation(len(runs))]
    sequences = [runs[k : k + 8] for k in range(0, len(runs), 8)]
    joined = pa.array([" ".join(r[0] for r in s) for s in sequences], pa.string())
    parts = [words_of(data, at) for _, data, at in slices(joined)]
    gold = np.array([y for s in sequences for _, n, y in s for _ in range(n)], np.int64)
    same = np.repeat(np.arange(len(sequences)), [sum(r[1] for r in s) for s in sequences])
    y = len(labels)
    model = Model(labels, np.zeros((len(SIZES) + 1, 1 << TABLE_BITS, y), np.float32), np.zeros((y, y)))
    seen = np.zeros((y, y))
    inner = same[1:] == same[:-1]
    np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
    squares, squares_t = np.full(model.weights.shape, 1e-8), np.full((y, y), 1e-8)
    for _ in range(epochs if y > 1 else 0):
        gradient, expected, at = np.zeros(model.weights.shape), np.zeros((y, y)), 0
        for part in parts:
            p, e = marginals(part.emissions(model.weights), part.bounds, model.transitions)
            target = np.zeros_like(p)
            target[np.arange(len(p)), gold[at : at + len(p)]] = 1
            gradient += part.spread(target - p)
            expected += e
            at += len(p)
        gradient = gradient / len(gold) - DECAY * model.weights
        step = (seen - expected) / len(gold)
        squares += gradient**2
        squares_t += step**2
        model.weights += (RATE * gradient / np.sqrt(squares)).astype(np.float32)
        model.transitions += RATE * step / np.sqrt(squares_t)
    return model


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL, label_bytes: int = LABEL_BYTES) -> Model | None:
    """Fits on at most `per_label` rows and `label_bytes` bytes of each label; only the chosen texts leave their task."""
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    ids = docs.where(F.octet_length("text") <= label_bytes).select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.xxhash64("id").alias("_h"), F.octet_length("text").cast("long").alias("_size"))
    local = Window.partitionBy("_lang", F.pmod(F.col("_h"), F.lit(256))).orderBy("_h", "_id")
    least = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = ids.withColumn("_r", F.row_number().over(local)).where(f"_r <= {per_label}").withColumn("_r", F.row_number().over(least)).where(f"_r <= {per_label}")
    chosen = chosen.withColumn("_sum", F.sum("_size").over(least.rowsBetween(Window.unboundedPreceding, 0))).where(f"_sum <= {label_bytes}").select("_lang", "_id", "_size").distinct()
    labels = ids.select("_lang").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    # rows that repeat an id are told apart by size, and by no more: equal ones count once
    same = (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.octet_length("text") == F.col("_size"))
    rows = docs.join(F.broadcast(chosen), same, "left_semi").groupBy("id", "lang", F.octet_length("text")).agg(F.min("text").alias("text")).collect()
    rows = sorted((r["id"], r["lang"], r["text"]) for r in rows)
    model = fit([t for _, _, t in rows], [x for _, x, _ in rows]) if rows else None
    give_back()  # the driver goes on beside what follows
    return model


def label_words(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the label probabilities of its words, and which words have letters."""
    for _, data, at in slices(texts):
        words = words_of(data, at)
        p, _ = marginals(words.emissions(model.weights), words.bounds, model.transitions)
        for lo, hi in zip(words.bounds[:-1], words.bounds[1:]):
            yield p[lo:hi], words.letters[lo:hi]


def predict(df: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted label and its score; columns of these names are replaced."""
    df = df.drop(label, score)
    if model is None:
        return df.withColumns({label: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)
    letter = free(df, "letter")
    df = df.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = df.withColumns({label: F.lit(""), score: F.lit(0.0)}).schema

    def work(batches):
        model = shared.value
        for b in batches:
            names, sure = [], []
            for (p, letters), any_ in zip(label_words(model, b.column(text)), b.column(letter).to_pylist()):
                mean = p[letters].mean(axis=0) if any_ and letters.any() else None
                k = int(mean.argmax()) if mean is not None else -1
                names.append(UNKNOWN if k < 0 else model.labels[k])
                sure.append(0.0 if k < 0 else min(1.0, float(mean[k])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, label, score])

    return df.mapInArrow(released(work), schema).drop(letter)


def held_out(doc_id: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


SQL: dict[str, str] = {}
QUERIES = {"op9_language_id": op9_language_id}
