"""FM-index over integer sequences: suffix order, wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np

from pelgrain.llm.words import runs


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order. 0 ends a segment; suffixes equal up to their 0 are ordered by position.

    The first keys hold as many symbols as fit in 60 bits; then only groups not yet told apart are
    sorted on, by the rank one depth further (prefix doubling).
    """
    n = len(t)
    bits = max(1, int(t.max(initial=0)).bit_length())
    depth = max(1, 60 // bits)
    key = t.astype(np.int64)
    for k in range(1, depth):
        rest = np.zeros(n, np.int64)
        rest[:-1] = key[1:]
        rest[t == 0] = 0
        key = (t.astype(np.int64) << (bits * k)) | rest
    ends = np.flatnonzero(t == 0)
    ahead = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = (key[order][1:] != key[order][:-1]) | (ahead[order][1:] < depth)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots, head = slots[~alone], head[~alone]
        if not len(slots):
            return order
        i = order[slots]
        both = rank[i] * n + rank[i + depth]
        by = np.argsort(both, kind="stable")
        i, both = i[by], both[by]
        order[slots] = i
        head = np.empty(len(slots), bool)
        head[0] = True
        head[1:] = both[1:] != both[:-1]
        rank[i] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        depth *= 2


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a running count before each."""

    def __init__(self, b: np.ndarray) -> None:
        packed = np.packbits(b, bitorder="little")
        words = np.zeros(len(b) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Index of a sequence of symbols > 0 in segments, each closed by a 0."""

    def __init__(self, t: np.ndarray, sample: int = 32) -> None:
        order = suffix_order(t)
        last = t[order - 1]
        sigma = int(t.max(initial=0)) + 1
        self.n, self.levels = len(t), max(1, (sigma - 1).bit_length())
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(t, minlength=sigma), out=self.before[1:])
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        seq = last
        for level in range(self.levels - 1, -1, -1):
            b = (seq >> level) & 1 == 1
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            seq = np.concatenate([seq[~b], seq[b]])
        #: where a symbol's run starts below the last level
        self.base = np.zeros(sigma, np.int64)
        at = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
        self.base[seq[at]] = at
        # Positions: every sample-th of the text, and where segments begin, as no walk crosses a 0.
        known = (order % sample == 0) | (last == 0)
        self.known, self.places = Bits(known), order[known]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before row i of the last column."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            r = bits.rank(i)
            i = np.where(one, zeros + r, i - r)
        return i - self.base[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.get(i) == 1
            r = bits.rank(i)
            i = np.where(one, zeros + r, i - r)
            c = c * 2 + one
        return self.before[c] + i - self.base[c]

    def search(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases codes[start : start + size], searched backwards from their last symbols."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        sigma = len(self.before) - 1
        live = np.arange(len(start))
        for k in range(1, int(size.max(initial=0)) + 1):
            step = live[size[live] >= k]
            c = codes[start[step] + size[step] - k].astype(np.int64)
            known = c < sigma
            hi[step[~known]] = lo[step[~known]]
            step, c = step[known], c[known]
            lo[step], hi[step] = self.before[c] + self.rank(c, lo[step]), self.before[c] + self.rank(c, hi[step])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: walk back to a known one."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            here = self.known.get(at) == 1
            out[todo[here]] = self.places[self.known.rank(at[here])] + steps
            todo, at = todo[~here], self.back(at[~here])
            steps += 1
        return out

    def find(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        lo, hi = self.search(codes, start, size)
        n = np.maximum(hi - lo, 0)
        return np.repeat(np.arange(len(start)), n), self.locate(runs(lo, n))
