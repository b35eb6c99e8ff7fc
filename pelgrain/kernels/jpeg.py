"""JPEG decoding, baseline and progressive, with plain integers for the bits and numpy for the rest."""

from __future__ import annotations

import struct

import numpy as np

from pelgrain.kernels.png import ImageError

# The place of the k-th coefficient of a block, row by row.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
FRAMES = (0xC0, 0xC1, 0xC2)


def segments(data: bytes):
    """(marker, body, place after it) of all marker segments; entropy-coded data is passed over."""
    at = 2
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 2 > len(data):
            return
        marker = data[at + 1]
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n


def size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header."""
    for marker, body, _ in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            return struct.unpack(">xHH", body[:5])[::-1]
    return None


def profile(data: bytes) -> bytes | None:
    """The colour profile, joined from its parts."""
    parts = sorted((b[12], b[14:]) for m, b, _ in segments(data) if m == 0xE2 and b.startswith(b"ICC_PROFILE\0"))
    return b"".join(x for _, x in parts) or None


def exif(data: bytes) -> bytes | None:
    return next((b[6:] for m, b, _ in segments(data) if m == 0xE1 and b.startswith(b"Exif\0\0")), None)


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: length of the code and its symbol, as length * 256 + symbol; 0 where there is none."""
    table, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table.tolist()


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int) -> None:
        self.ident, self.h, self.v, self.table = ident, h, v, table


class _Scan:
    """Bits of one scan between two restarts."""

    def __init__(self, data: bytes) -> None:
        d = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
        self.words = ((d[:-2] << 16) | (d[1:-1] << 8) | d[2:]).tolist()
        self.last = len(self.words) - 1
        self.at = self.run = 0

    def peek(self) -> int:
        at = self.at
        return self.words[min(at >> 3, self.last)] >> (8 - (at & 7)) & 0xFFFF

    def bits(self, n: int) -> int:
        v = self.peek() >> (16 - n) if n else 0
        self.at += n
        return v

    def symbol(self, table: list[int]) -> int:
        e = table[self.peek()]
        if not e:
            raise ImageError("broken JPEG: a code that the table has not")
        self.at += e >> 8
        return e & 255

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _first(s: _Scan, c: _Component, place: int, lo: int, hi: int, shift: int) -> None:
    """Coefficients lo to hi of the block at `place`, first seen: all of a baseline block, or a scan's part."""
    out = c.values
    k = lo
    if k == 0:
        c.before += s.signed(s.symbol(c.dc))
        out[place] = c.before << shift
        k = 1
    if k > hi:
        return
    if s.run:
        s.run -= 1
        return
    table = c.ac
    while k <= hi:
        rs = s.symbol(table)
        r, n = rs >> 4, rs & 15
        if n:
            k += r
            if k > 63:
                raise ImageError("broken JPEG: too many coefficients")
            out[place + ZIGZAG[k]] = s.signed(n) << shift
            k += 1
        elif r == 15:
            k += 16
        else:
            s.run = (1 << r) + s.bits(r) - 1
            return


def _refined(s: _Scan, c: _Component, place: int, lo: int, hi: int, shift: int) -> None:
    """One more bit of coefficients seen before, and those that it is the first of."""
    out, one = c.values, 1 << shift
    if lo == 0:
        if s.bits(1):
            out[place] |= one
        return

    def more(i: int) -> None:
        if s.bits(1):
            out[i] += one if out[i] > 0 else -one

    k = lo
    if not s.run:
        while k <= hi:
            rs = s.symbol(c.ac)
            r, n = rs >> 4, rs & 15
            if not n and r < 15:
                s.run = (1 << r) + s.bits(r)
                break
            new = (one if s.bits(1) else -one) if n else 0
            while k <= hi:
                i = place + ZIGZAG[k]
                if out[i]:
                    more(i)
                elif r == 0:
                    if new:
                        out[i] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if s.run:
        while k <= hi:
            i = place + ZIGZAG[k]
            if out[i]:
                more(i)
            k += 1
        s.run -= 1


def _scan(parts: list[_Component], chunks: list[bytes], every: int, one: tuple, wide: int, high: int, width: int, height: int, most: tuple[int, int]) -> None:
    """All blocks of a scan, in the order of its units."""
    step, lo, hi, shift = one
    if len(parts) == 1:
        c = parts[0]
        across, down = -(-(-(-width * c.h // most[0])) // 8), -(-(-(-height * c.v // most[1])) // 8)
        units = [[(c, (y * c.across + x) * 64)] for y in range(down) for x in range(across)]
    else:
        units = [[(c, ((y * c.v + v) * c.across + x * c.h + h) * 64) for c in parts for v in range(c.v) for h in range(c.h)] for y in range(high) for x in range(wide)]
    every = every or len(units)
    for k, start in enumerate(range(0, len(units), every)):
        if k >= len(chunks):
            return  # cut off: what is missing stays grey
        s = _Scan(chunks[k])
        for c in parts:
            c.before = 0
        for unit in units[start : start + every]:
            for c, place in unit:
                step(s, c, place, lo, hi, shift)


def _cosines() -> np.ndarray:
    k, x = np.mgrid[:8, :8]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def _entropy(data: bytes, at: int) -> list[bytes]:
    """The scan's coded bytes from `at`, parted at its restarts."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]]
        marker = data[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        elif marker in (0x00, 0xFF):
            at += 2 if marker == 0 else 1
        else:
            return [*out, data[start:at]]


def decode_jpeg(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes of a grey, colour or four-ink image of 8 bits; as stored, neither turned nor profiled."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], list[int]] = {}
    comps: list[_Component] = []
    every, adobe, width = 0, None, 0
    try:
        for marker, body, after in segments(data):
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (every,) = struct.unpack(">H", body[:2])
            elif marker == 0xEE and body.startswith(b"Adobe"):
                adobe = body[11]
            elif marker in FRAMES:
                depth, height, width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not width or not height or n not in (1, 3, 4):
                    raise ImageError(f"JPEG of {depth} bits and {n} channels")
                comps = [_Component(i, s >> 4, s & 15, t) for i, s, t in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
                most = max(c.h for c in comps), max(c.v for c in comps)
                wide, high = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
                for c in comps:
                    c.across, c.down = wide * c.h, high * c.v
                    c.values = [0] * (c.across * c.down * 64)
                progressive = marker == 0xC2
            elif 0xC0 <= marker <= 0xCF:
                raise ImageError(f"JPEG coding {marker:#x}")
            elif marker == 0xDA:
                n = body[0]
                parts = []
                for k in range(n):
                    ident, t = body[1 + 2 * k], body[2 + 2 * k]
                    c = next(c for c in comps if c.ident == ident)
                    c.dc, c.ac = huff.get((0, t >> 4)), huff.get((1, t & 15))
                    parts.append(c)
                lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
                if not progressive:
                    lo, hi, bits = 0, 63, 0
                one = (_refined if bits >> 4 else _first, lo, hi, bits & 15)
                _scan(parts, _entropy(data, after), every, one, wide, high, width, height, most)
        if not comps:
            raise ImageError("JPEG without a frame")
        planes, m = [], _cosines()
        for c in comps:
            q = np.zeros(64)
            q[ZIGZAG] = quant[c.table]
            f = (np.array(c.values, np.float64).reshape(-1, 64) * q).reshape(c.down, c.across, 8, 8)
            px = np.clip(np.floor(m.T @ f @ m + 128.5), 0, 255)
            px = px.transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
            px = px.repeat(most[1] // c.v, axis=0).repeat(most[0] // c.h, axis=1)
            planes.append(px[:height, :width])
    except ImageError:
        raise
    except Exception as e:
        raise ImageError(f"broken JPEG: {e}") from e
    out = np.full((height, width, 4), 255, np.uint8)
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None]
        return out
    a, b, c = planes[:3]
    plain = adobe == 0 if adobe is not None else bytes(x.ident for x in comps[:3]) == b"RGB" or len(planes) == 4
    if not plain:
        b, c = b - 128, c - 128
        a, b, c = a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b
    rgb = np.clip(np.floor(np.stack([a, b, c], axis=2) + 0.5), 0, 255)
    if len(planes) == 4:  # inks, stored inverted by the program that marks its files
        ink = planes[3] if adobe is not None else 255 - planes[3]
        rgb = np.floor((rgb if adobe is not None else 255 - rgb) * ink[..., None] / 255 + 0.5)
    out[..., :3] = rgb
    return out
