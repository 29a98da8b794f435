"""Elias-Fano sequences and a two-level n-gram trie made of them.

A sorted sequence is split into low bits, stored as they are, and high bits, stored
in unary, so n numbers under u take about n * (2 + log2(u / n)) bits. Searches look
up the bucket of the high bits, by counts kept for every 64 bits of the unary part,
and search its low bits. The trie is one image of bytes, mapped from a file;
everything is vectorised over many queries.

The successors of a context are sorted; each run is raised by the last number of the
run before it, so that all runs are one monotone sequence. A context's two pointers
bound its run, the number in front of the run gives what it was raised by, and a
successor is sought, so raised, inside those bounds only.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

ABSENT = 0xFFFF
#: log10 probabilities are stored as steps of 1 / STEPS below zero, in 16 bits.
STEPS = 4096.0
SUCCESSOR_BITS = 40
#: Places sought at a time.
SELECT = 1 << 15
#: Successors sought at a time.
LOOKUP = 1 << 17


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low = n, width, low
        self.words = np.append(high, np.full(-len(high) % 8, 0xFF, np.uint8)).reshape(-1, 8) if len(high) % 8 else high.reshape(-1, 8)
        #: how many ones, and zeros, stand before each word of 64 bits
        ones = np.bitwise_count(self.words).sum(axis=1)
        self.ones = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        self.zeros = np.concatenate(([0], np.cumsum(64 - ones))).astype(np.uint32)
        self.buckets = int(self.zeros[-1])

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero (from 0) of the unary part."""
        out, ranks = np.empty(len(k), np.int64), self.ones if one else self.zeros
        for lo in range(0, len(k), SELECT):
            part = k[lo : lo + SELECT]
            word = np.searchsorted(ranks, part.astype(np.uint32), "right") - 1
            bits = np.unpackbits(self.words[word], axis=1) if one else 1 - np.unpackbits(self.words[word], axis=1)
            want = (part - ranks[word] + 1).astype(np.uint8)
            out[lo : lo + SELECT] = word * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) >= want[:, None]).argmax(axis=1)
        return out

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have high bits under h, for h of at most `buckets`."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        out[some] = self._select(h[some] - 1, False) - (h[some] - 1)
        return out

    @staticmethod
    def encoded(values: np.ndarray) -> bytes:
        """The image of a sorted uint64 array; low bits fill whole bytes."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = 0
        while n and (top >> 8 * width) > n and width < 7:
            width += 1
        raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(n, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8))))
        return struct.pack("<QQQ", n, width, len(packed)) + np.ascontiguousarray(raw).tobytes() + packed.tobytes()

    @classmethod
    def opened(cls, image, at: int) -> tuple[EliasFano, int]:
        n, width, size = struct.unpack_from("<QQQ", image, at)
        at += 24
        low = np.frombuffer(image, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        return cls(n, width, low, np.frombuffer(image, np.uint8, size, at)), at + size

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.width):
            out |= self.low[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, x: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """The index of each x, from `first` up to `stop` if they are given, or -1: the
        successor of x, if it is x."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = np.minimum(x >> np.uint64(8 * self.width), np.uint64(self.buckets)).astype(np.int64)
        known = high < self.buckets
        at = np.where(known, high, 0)
        lo, end = self._before(at), self._before(at + 1)
        if first is not None:
            lo, end = np.maximum(lo, first), np.minimum(end, stop)
        end = np.where(known, np.maximum(end, lo), lo)
        hi, low = end.copy(), x & np.uint64((1 << 8 * self.width) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = np.zeros(len(x), bool)
            less[open_] = self._low(mid[open_]) < low[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the indices i."""
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(8 * self.width)) | self._low(i)


class Trie:
    """Contexts, monotone pointers to their successors, the successors relative to
    their context, and a quantised log10 probability for each."""

    def __init__(self, image: bytes):
        """Maps the image from a file that goes with the task."""
        with tempfile.TemporaryFile() as f:
            f.write(image or b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.contexts, at = EliasFano.opened(self.map, 0)
        self.pointers, at = EliasFano.opened(self.map, at)
        self.successors, at = EliasFano.opened(self.map, at)
        self.codes = np.frombuffer(self.map, "<u2", self.successors.n, at)

    @staticmethod
    def image(contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, log10: np.ndarray) -> bytes:
        """contexts sorted; sizes of their runs of successors, each run sorted."""
        raised = np.zeros(len(contexts), np.uint64)
        some = np.flatnonzero(sizes)
        raised[some] = successors[np.cumsum(sizes)[some] - 1] + np.uint64(1)
        raised = np.cumsum(raised) - raised
        pointers = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
        codes = np.clip(np.rint(-log10 * STEPS), 0, ABSENT - 1).astype("<u2")
        relative = np.repeat(raised, sizes) + successors
        return b"".join((EliasFano.encoded(contexts), EliasFano.encoded(pointers), EliasFano.encoded(relative), codes.tobytes()))

    def run(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the successors of each context begin and stop, and by how much they
        are raised; an unknown context has none."""
        c = self.contexts.find(contexts)
        first, stop, raised = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64)
        known = np.flatnonzero(c >= 0)
        first[known], stop[known] = self.pointers.at(c[known]).astype(np.int64), self.pointers.at(c[known] + 1).astype(np.int64)
        behind = known[first[known] > 0]
        raised[behind] = self.successors.at(first[behind] - 1) + np.uint64(1)
        return first, stop, raised

    def lookup(self, contexts: np.ndarray, successors: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
        """The probability code of each (context, successor), ABSENT where there is none;
        number: for each successor which of the contexts is its own, else one each."""
        first, stop, raised = self.run(contexts)
        out = np.full(len(successors), ABSENT, "<u2")
        for lo in range(0, len(successors), LOOKUP):
            own = slice(lo, lo + LOOKUP)
            c = own if number is None else number[own]
            s = self.successors.find(raised[c] + successors[own], first[c], stop[c])
            found = s >= 0
            out[own][found] = self.codes[s[found]]
        return out
