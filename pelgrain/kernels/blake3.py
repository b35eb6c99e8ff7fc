"""BLAKE3 of short strings, from the published specification (hash mode, 256-bit output)."""

from __future__ import annotations

import struct
from functools import lru_cache

# Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
LINES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
M32 = 0xFFFFFFFF


@lru_cache(1 << 14)  # shapes that differ in their paint have the same first blocks
def _compress(cv: tuple[int, ...], words: tuple[int, ...], counter: int, size: int, flags: int) -> tuple[int, ...]:
    s = [*cv, *IV[:4], counter & M32, counter >> 32, size, flags]
    m = list(words)
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(LINES):
            for x, r1, r2 in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                s[a] = (s[a] + s[b] + x) & M32
                t = s[d] ^ s[a]
                s[d] = (t >> r1 | t << (32 - r1)) & M32
                s[c] = (s[c] + s[d]) & M32
                t = s[b] ^ s[c]
                s[b] = (t >> r2 | t << (32 - r2)) & M32
        m = [m[k] for k in ORDER]
    return tuple(s[i] ^ s[i + 8] for i in range(8))


def _chunk(data: bytes, number: int, root: bool) -> tuple[int, ...]:
    cv = IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for k, b in enumerate(blocks):
        last = k == len(blocks) - 1
        flags = CHUNK_START * (k == 0) | CHUNK_END * last | ROOT * (last and root)
        cv = _compress(cv, struct.unpack("<16I", b.ljust(64, b"\0")), number, len(b), flags)
    return cv


def _tree(data: bytes, first: int, root: bool) -> tuple[int, ...]:
    n = -(-len(data) // 1024)
    if n <= 1:
        return _chunk(data, first, root)
    left = 1 << ((n - 1).bit_length() - 1)
    words = _tree(data[: left * 1024], first, False) + _tree(data[left * 1024 :], first + left, False)
    return _compress(IV, words, 0, 64, PARENT | ROOT * root)


def blake3_hex(data: bytes) -> str:
    return struct.pack("<8I", *_tree(data, 0, True)).hex()
