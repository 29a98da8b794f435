"""A sentencepiece BPE vocabulary and its merges, shared by the counting and the
encoding operator. The model file is data of the library: only its pieces and
scores are read, and the segmentation is done here."""

from __future__ import annotations

import functools
import heapq
import re

SPACE = "▁"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte = {i for i in range(size) if sp.is_byte(i)}
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if i not in special and i not in byte}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(self.text[i][3:5], 16): i for i in byte}
        self.longest = max(map(len, self.ids))
        #: What each id stands for when decoded.
        self.bytes = [bytes([int(p[3:5], 16)]) if i in byte else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """A pattern whose consecutive matches make up any text and between which no
        piece of this vocabulary ever reaches, so that each can be merged alone."""
        latin = "A-Za-zÀ-ɏ"
        sign = re.compile(rf"[^{latin}]").match
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in pairs):
            return re.compile(r"[\s\S]+")
        if any(a != SPACE and bool(sign(a)) != bool(sign(b)) for a, b in pairs):
            return re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile(rf"{SPACE}*[{latin}]+|{SPACE}*[^{latin}{SPACE}]+|{SPACE}+")

    def prepared(self, text: str) -> str:
        """Identity normalisation with a leading space mark; an empty text stays so."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(self.prepared(text))

    def merged(self, s: str, short_of: str | None = None) -> tuple[list[str], int]:
        """The symbols left of s when the lowest-ranked adjacent pair (the leftmost
        of equals) is merged again and again, and the number of merges: a heap of
        pairs over a linked list of symbols. With `short_of`, up to the merge that
        gives it."""
        n, rank = len(s), self.rank
        left, right, symbol = list(range(-1, n - 1)), list(range(1, n + 1)), list(s)
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := s[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, p = heapq.heappop(heap)
            if p == short_of:
                break
            j = right[i]
            if j >= n or not symbol[i] or symbol[i] + symbol[j] != p:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = p, ""
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (q := p + symbol[k]) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
            if (h := left[i]) >= 0 and (q := symbol[h] + p) in rank:
                heapq.heappush(heap, (rank[q], h, q))
        return [x for x in symbol if x], merges

    def split(self, p: str) -> int | None:
        """Where the last merge joins p, or None where its merging stops before."""
        left = self.merged(p, p)[0]
        return len(left[0]) if len(left) == 2 else None

    def count(self, s: str) -> int:
        """Number of tokens of a segment: its symbols less the merges; a character
        outside the vocabulary is as many as it has bytes."""
        known = self.ids
        start = sum(1 if c in known else len(c.encode()) for c in s)
        return start - self.merged(s)[1] if len(s) > 1 else start


@functools.lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """One vocabulary for each worker process and path."""
    return Pieces(path)


class Memo(dict):
    """What `make` gives for a segment, kept for up to `most` short segments."""

    def __init__(self, make, most: int = 400_000, long: int = 48):
        super().__init__()
        self.make, self.most, self.long = make, most, long

    def __missing__(self, s: str):
        out = self.make(s)
        if len(s) <= self.long:
            if len(self) >= self.most:
                self.clear()
            self[s] = out
        return out


@functools.lru_cache(maxsize=4)
def counts(path: str) -> Memo:
    return Memo(load(path).count)
