"""Words of many texts at once: vectorised splitting and hashing over Arrow buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial word hash; odd, so that it has an inverse mod 2**64.
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 19

_tables: dict[str, np.ndarray] = {}


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    col = col.fill_null("").cast(pa.large_binary()) if col.null_count else col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z; all of UTF-8 above ASCII."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def spaced_table() -> np.ndarray:
    """True for bytes of [^\\x20\\x09-\\x0D]."""
    t = np.ones(256, bool)
    t[9:14] = t[32] = False
    return t


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _tables[name] = np.cumprod(x, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: first word of each text, and the number of words at the end
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def split_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None) -> Words:
    """Maximal runs of bytes with inside[byte], within each text, and their hashes after fold."""
    m = inside[buf]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(m)
    before[:1], before[1:] = False, m[:-1]
    before[heads] = False
    start = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1:], after[:-1] = False, m[1:]
    after[heads[1:] - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    del m, before, after
    return Words(start, end, np.searchsorted(start, offsets), hash_words(buf, start, end, fold))


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
    """64-bit hashes of buf[start:end]: prefix sums of a polynomial, block by block, then mixed."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(start, lo + BLOCK)))
            hi = end[j - 1]
            power, inverse = _powers(int(hi - lo) + 1)
            part = buf[lo:hi] if fold is None else fold[buf[lo:hi]]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
        return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all intervals start, start + 1, ..., in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths[:-1])
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)
