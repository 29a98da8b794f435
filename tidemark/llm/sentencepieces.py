"""SentencePiece encoding by a streaming Viterbi pass, and decoding.

The vocabulary is a BPE one, whose segmentation is the path on which every two
neighbours are stable: merging their joined text gives the same two pieces back.
Of the pieces that end at a position exactly one is stable behind the survivor of
its start, so the lattice keeps one survivor for each position, with a backpointer.

A boundary that no piece of the vocabulary spans is on every backpointer path: there
all survivors converge, and the ids up to it are committed. Between two such
boundaries the window holds the survivors of the last `longest` positions, since none
before them can be extended. Stretches of up to LONG characters are solved side by
side, equal ones of a slice once; a longer one is streamed character by character and
commits as soon as the paths of all survivors in its window meet. Memory is bounded by
a slice of SLICE bytes (or one text) and one fixed table of stable pairs per worker.
The ids equal the library's.

Defined results: a null text gives null ids and a null decoded text; an empty text
gives no ids and ""; characters outside the vocabulary become byte ids; decoding
gives the text back, but that U+2581 comes back as a space, as in the library; bytes
that are no UTF-8 become U+FFFD; an id outside the vocabulary raises. Rows are
independent: equal and repeated rows get equal ids, an empty table gives an empty
one, texts of any length are encoded whole, other columns pass through and one named
like the result is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import mix, ranges, read, released, slices

MODEL = "piece_bpe_32k.model"
SLICE = 1 << 20
#: Stretches of more characters than this are streamed one by one.
LONG = 96
#: Entries of the table of stable pairs (8 bytes each); a new pair overwrites the one in its place.
PAIRS = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1342543DE82EF95)
_NONE, _PART = -1, -2  # no piece ends like this; only a longer piece does


class Lattice:
    """The vocabulary as tables: pieces by hash, their splits and ranks."""

    def __init__(self, v: pieces.Pieces):
        self.v, self.longest = v, v.longest
        order = sorted(v.ids, key=len)
        self.size = len(v.text)
        self.length = np.ones(self.size, np.int64)
        self.hash = np.zeros(self.size, np.uint64)
        self.rank = np.full(self.size, -1, np.int64)  # -1: a single character, never the result of a merge
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.powers = np.ones(v.longest + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(v.longest, _BASE))
        scores = sorted({v.rank[p] for p in order})
        dense = {x: k for k, x in enumerate(scores)}
        level = np.full(self.size, -1, np.int64)
        usable, self.odd = set(), np.zeros(self.size, bool)
        for p in order:
            i = v.ids[p]
            self.length[i] = len(p)
            level[i] = dense[v.rank[p]]
            at = v.split(p) if len(p) > 1 else 0
            if at is None:
                continue
            usable.add(i)
            if at:
                a, b = v.ids[p[:at]], v.ids[p[at:]]
                self.left[i], self.right[i], self.rank[i] = a, b, level[i]
                self.odd[i] = self.odd[a] or self.odd[b] or max(self.rank[a], self.rank[b]) >= level[i]
        self.level = level  # of a merge that gives the piece, also where its own merging goes another way
        ends: dict[str, int] = {p[k:]: _PART for p in order for k in range(1, len(p))}
        ends |= {p: v.ids[p] for p in order if v.ids[p] in usable}
        self.ends = _Table(*self._hashed(ends))
        self.whole = _Table(*self._hashed(v.ids))
        for p, i in v.ids.items():
            self.hash[i] = self._hash(p)
        # Characters that stand beside others in some piece are numbered; 0: none beside.
        pairs = {(a, b) for p in order for a, b in zip(p, p[1:])}
        inner = {c: k for k, c in enumerate(sorted({c for ab in pairs for c in ab}), 1)}
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in inner]] = list(inner.values())
        self.spanned = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for a, b in pairs:
            self.spanned[inner[a], inner[b]] = True
        self.known_pairs = np.zeros(PAIRS, np.uint64)  # (pair + 1) << 1 | stable

    def _hash(self, p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def _hashed(self, named: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self._hash(p) for p in named], np.uint64), np.array(list(named.values()), np.int64)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays as it is when its text is merged."""
        pair = (a * self.size + b).astype(np.uint64)
        slot = ((pair * _TURN) >> np.uint64(43)).astype(np.int64) & (PAIRS - 1)
        held = self.known_pairs[slot]
        out = (held & np.uint64(1)).astype(bool)
        new = np.flatnonzero((held >> np.uint64(1)) != pair + np.uint64(1))
        if len(new):
            fresh = self._stable(a[new], b[new])
            out[new] = fresh
            self.known_pairs[slot[new]] = (pair[new] + np.uint64(1)) << np.uint64(1) | fresh.astype(np.uint64)
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges on both sides of the boundary, the latest first. A pair
        that met there merged across it if its own merge came before the next one;
        of equal ranks the leftmost merge comes first."""
        out = np.ones(len(a), bool)
        open_, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 60, np.int64)
        while len(open_):
            joined = self.whole.find(self.hash[x] * self.powers[self.length[y]] + self.hash[y])
            crosses = (joined >= 0) & (2 * self.level[joined] < limit)
            out[open_[crosses]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crosses & (np.maximum(rx, ry) >= 0)
            first = rx > ry
            limit = np.where(first, 2 * rx, 2 * ry + 1)[go]
            x, y, open_ = np.where(first, self.right[x], x)[go], np.where(first, y, self.left[y])[go], open_[go]
        for k in np.flatnonzero(self.odd[a] | self.odd[b]):  # formed out of rank order: merge again
            out[k] = self._merged(int(a[k]), int(b[k]))
        return out

    @functools.lru_cache(maxsize=1 << 14)  # noqa: B019 one lattice per worker
    def _merged(self, a: int, b: int) -> bool:
        a, b = self.v.text[a], self.v.text[b]
        return self.v.merged(a + b)[0] == [a, b]

    def solve(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches [start, start + size) of code points that need no
        byte ids, longest first: (ids, number of ids of each)."""
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # stretches of t characters or more
        last, window = [], []
        for t, n in enumerate(active.tolist()):
            c = code[start[:n] + t].astype(np.uint64) + np.uint64(1)
            window.insert(0, c)
            del window[self.longest :]
            best = np.full(n, -1, np.int64)
            need, h = np.arange(n), np.zeros(n, np.uint64)
            for m in range(1, len(window) + 1):
                # the last m characters, one more at the front
                h += window[m - 1][need] * self.powers[m - 1]
                found = self.ends.find(h)
                tried = np.flatnonzero(found >= 0)
                if len(tried):
                    lanes, ids = need[tried], found[tried]
                    if t + 1 == m:
                        best[lanes] = ids
                        break
                    before = last[t - m][lanes]
                    ok = before >= 0
                    ok[ok] = self.stable(before[ok], ids[ok])
                    best[lanes[ok]] = ids[ok]
                    found[tried[ok]] = _NONE
                more = found != _NONE
                need, h = need[more], h[more]
                if not len(need):
                    break
            last.append(best)
        flat = np.concatenate(last)
        offset = np.concatenate(([0], np.cumsum(active)[:-1]))
        lanes, at, steps = np.arange(len(size)), size.copy(), []
        count = np.zeros(len(size), np.int64)
        while len(lanes):
            ids = flat[offset[at - 1] + lanes]
            steps.append((lanes, ids))
            count[lanes] += 1
            at = at - self.length[ids]
            lanes, at = lanes[at > 0], at[at > 0]
        out, end = np.empty(int(count.sum()), np.int64), np.cumsum(count)
        for k, (lanes, ids) in enumerate(steps, 1):
            out[end[lanes] - k] = ids
        return out, count

    def stream(self, characters) -> Iterator[int]:
        """The ids of a stream of characters of any length, each as soon as it is
        settled: where the paths of all survivors in the window meet. `committed`
        and `held` tell of the last stream how often, and the most positions kept."""
        longest, tail, base, end, edge = self.longest, "", 0, 0, -1
        self.committed = self.held = 0
        last: dict[int, int] = {}  # survivor: the last piece of the path that ends here
        for c in characters:
            tail = (tail + c)[-longest:]
            end += 1
            h = 0
            for m in range(1, min(len(tail), end - base) + 1):
                h = (h + (ord(tail[-m]) + 1) * int(self.powers[m - 1])) % (1 << 64)
                i = self.ends.get(h)
                if i == _NONE:
                    break
                before = edge if end - m == base else last.get(end - m, -1)
                if i >= 0 and (before < 0 if end == m else before >= 0 and self._pair(before, i)):
                    last[end] = i
                    break
            self.held = max(self.held, len(last))
            if end - base >= 2 * longest:
                at = self._meeting(last, end, base)
                if at > base:
                    self.committed += 1
                    yield from self._path(last, at, base)
                    edge, base = last[at], at
                    last = {k: x for k, x in last.items() if k > at}
        yield from self._path(last, end, base)

    @functools.lru_cache(maxsize=1 << 14)  # noqa: B019
    def _pair(self, a: int, b: int) -> bool:
        return bool(self.stable(np.array([a]), np.array([b]))[0])

    def _meeting(self, last: dict[int, int], end: int, base: int) -> int:
        """The last boundary that the paths of all survivors in the window share."""
        live = {k for k in range(max(base, end - self.longest) + 1, end + 1) if k in last}
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(k - int(self.length[last[k]]))
            if base in live:
                return base
        return live.pop()

    def _path(self, last: dict[int, int], at: int, base: int) -> list[int]:
        out = []
        while at > base:
            out.append(last[at])
            at -= int(self.length[last[at]])
        return out[::-1]

    def cuts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The starts of the stretches: of texts, and where no piece spans two characters."""
        number = self.number[code]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.spanned[number[:-1], number[1:]]
        cut[first] = True
        return np.flatnonzero(cut)

    def encoded(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a slice, and how many each has."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        sign = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=sign[1:])
        at = sign[at]
        del sign
        full = np.flatnonzero(np.diff(at))  # empty texts get no space in front
        code = np.insert(np.where(code == 32, np.uint32(0x2581), code), at[full], np.uint32(0x2581))
        first = at[full] + np.arange(len(full))
        counts = np.zeros(len(at) - 1, np.int64)
        if not len(code):
            return np.zeros(0, np.int32), counts
        start = self.cuts(code, first)
        size = np.diff(np.append(start, len(code)))
        unique, place = self._distinct(code, start, size)
        ids, n = self._solved(code, start[unique], size[unique])
        per = n[place]
        owner = np.searchsorted(first, start, "right") - 1
        counts[full] = np.bincount(owner, per, len(full)).astype(np.int64)
        begin = np.cumsum(n) - n
        return ids[ranges(begin[place], per)], counts

    def _distinct(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each kind of equal stretches, and the kind of every stretch. Kinds are
        found by hash and held against each other character by character."""
        down = pow(int(_BASE), -1, 1 << 64)
        power = np.full(len(code) + 1, _BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(code) + 1, np.uint64)
        total[1:] = code
        total[1:] += np.uint64(1)
        total[1:] *= power[:-1]
        np.cumsum(total, out=total)
        h = total[start + size] - total[start]
        power[:], power[0] = np.uint64(down), 1
        np.multiply.accumulate(power, out=power)
        h = mix(h * power[start] + size.astype(np.uint64))
        del power, total
        _, one, place = np.unique(h, return_index=True, return_inverse=True)
        same = size == size[one[place]]
        near = np.flatnonzero(same)
        equal = code[ranges(start[near], size[near])] == code[ranges(start[one[place[near]]], size[near])]
        same[near] = np.logical_and.reduceat(equal, np.cumsum(size[near]) - size[near])
        odd = np.flatnonzero(~same)
        place[odd] = len(one) + np.arange(len(odd))
        return np.concatenate((one, odd)), place

    def _solved(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        long = int(np.searchsorted(-size, -LONG, "left"))
        ids, n = [], np.zeros(len(size), np.int64)
        for k in range(long):
            got = list(self.stream(map(chr, code[start[k] : start[k] + size[k]].tolist())))
            n[k] = len(got)
            ids.append(np.array(got, np.int64))
        if long < len(size):
            one = long + np.flatnonzero(size[long:] == 1)
            strange = one[self.ends.find(code[start[one]].astype(np.uint64) + np.uint64(1)) < 0]
            usual = np.ones(len(size), bool)
            usual[:long] = usual[strange] = False
            if usual.any():
                some, count = self.solve(code, start[usual], size[usual])
                n[usual] = count
            else:
                some = np.zeros(0, np.int64)
            raw = [[self.v.byte_id[b] for b in chr(c).encode()] for c in code[start[strange]].tolist()]
            n[strange] = [len(x) for x in raw]
            flat = np.empty(int(n[long:].sum()), np.int64)
            begin = np.cumsum(n[long:]) - n[long:]
            flat[ranges(begin[usual[long:]], n[usual])] = some
            flat[ranges(begin[strange - long], n[strange])] = np.array([b for x in raw for b in x], np.int64)
            ids.append(flat)
        # back from longest first to the order asked for
        begin = (np.cumsum(n) - n)[np.argsort(order)]
        n = n[np.argsort(order)]
        return np.concatenate(ids)[ranges(begin, n)].astype(np.int32), n


class _Table:
    """A fixed hash table from 64-bit hashes to numbers, probed in order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _NONE, np.int64)
        for k, x in zip(keys.tolist(), values.tolist()):
            at = k * int(_TURN) % (1 << 64) >> 64 - bits
            while self.keys[at]:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = k, x

    def find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * _TURN) >> self.shift).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], _NONE)
        miss = np.flatnonzero((key != h) & (key != 0))
        while len(miss):
            at[miss] = at[miss] + 1 & self.mask
            key = self.keys[at[miss]]
            hit = key == h[miss]
            out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (key != 0)]
        return out

    def get(self, h: int) -> int:
        return int(self.find(np.array([h], np.uint64))[0])


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(pieces.load(path))


def _lists(texts: pa.Array, path: str) -> pa.ListArray:
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, data, at in slices(texts, SLICE):
        made, n = lattice(path).encoded(data, at)
        ids.append(made)
        counts.append(n)
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=texts.is_null())


def _mapped(df: DataFrame, made: dict[str, str], work) -> DataFrame:
    """df with the columns (name: type) that `work` makes of an Arrow batch, in that
    order; columns of these names are replaced."""
    schema = df.withColumns({c: F.lit(None).cast(kind) for c, kind in made.items()}).schema
    order = [f for f in schema if f.name not in made] + [schema[c] for c in made]

    def batches(parts):
        for b in parts:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rest = [c for c in part.schema.names if c not in made]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *work(part)], [*rest, *made])

    return df.mapInArrow(released(batches), type(schema)(order))


ROWS = 2048


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """df with a column of token ids (array of int)."""
    return _mapped(df, {ids: "array<int>"}, lambda part: [_lists(part.column(text), model or public_tokenizers.path(MODEL))])


def encode_and_decode(df: DataFrame, text: str = "text", ids: str = "ids", back: str = "decoded", model: str | None = None) -> DataFrame:
    """encode and then decode in one pass, so that a task has one Python worker, not two."""

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        path = model or public_tokenizers.path(MODEL)
        lists = _lists(part.column(text), path)
        return [lists, decoded(lists, path)]

    return _mapped(df, {ids: "array<int>", back: "string"}, work)


@functools.lru_cache(maxsize=2)
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, where each begins, and its length."""
    table = pieces.load(path).bytes
    n = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(n) - n, n


def decoded(lists: pa.ListArray, path: str) -> pa.Array:
    """The texts that lists of ids stand for."""
    out = []
    raw, begin, size = _spelled(path)
    at, k = lists.offsets.to_numpy(), 0
    flat = lists.values.to_numpy(zero_copy_only=False)
    while k < len(lists):
        # a run of lists of about SLICE / 4 ids
        end = max(k + 1, int(np.searchsorted(at, at[k] + SLICE // 4, "right")) - 1)
        ids = flat[at[k] : at[end]]
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
            raise ValueError("an id outside the vocabulary")
        n = size[ids]
        data = raw[ranges(begin[ids], n)]
        upto = np.concatenate(([0], np.cumsum(n)))[at[k : end + 1] - at[k]]
        # the space put in front goes
        space = np.flatnonzero(np.diff(upto))
        space = space[data[upto[space]] == 32]
        data = np.delete(data, upto[space])
        less = np.zeros(end - k + 1, np.int64)
        less[space + 1] = 1
        upto = upto - np.cumsum(less)
        made = pa.Array.from_buffers(pa.large_binary(), end - k, [None, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        try:
            out.append(made.cast(pa.large_string()))
        except pa.ArrowInvalid:
            out.append(pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.large_string()))
        k = end
    joined = pa.concat_arrays(out) if out else pa.array([], pa.large_string())
    return pa.compute.if_else(lists.is_valid(), joined, pa.scalar(None, pa.large_string())).cast(pa.string())


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """df with the text that a column of token ids stands for."""
    return _mapped(df, {text: "string"}, lambda part: [decoded(part.column(ids), model or public_tokenizers.path(MODEL))])


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, the text decoded from the ids, and whether it is the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_and_decode(docs)
    return both.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "decoded", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


SQL: dict[str, str] = {}
QUERIES = {"op1_sentencepiece": op1_sentencepiece}
