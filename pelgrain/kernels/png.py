"""PNG and BMP decoding, and PNG encoding, with zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type (fixed values).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class ImageError(ValueError):
    """The bytes are no image this engine reads."""


def sniff(data: bytes) -> str | None:
    """Format by magic bytes."""
    if data.startswith(SIGNATURE):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "bmp" if data.startswith(b"BM") else None


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or BMP from its header alone."""
    if data.startswith(SIGNATURE) and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data.startswith(b"BM") and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    return None


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).copy()
        if kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            row, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, b = (row[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    p = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (row[i] + p) & 255
            line = np.array(row, np.uint8)
        elif kind:
            raise ImageError(f"unknown row filter {kind}")
        out[y] = above = line
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes: all colour types and depths, interlacing, transparency."""
    if not data.startswith(SIGNATURE):
        raise ImageError("not a PNG")
    at, idat, palette, trns, head = 8, b"", None, None, None
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if len(body) < n:
                raise ImageError("the file is cut off")
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                trns = body
            elif kind == b"IDAT":
                idat += body
            elif kind == b"IEND":
                break
            at += n + 12
        w, h, depth, ctype, _, _, laced = head
        channels = CHANNELS[ctype]
        raw = zlib.decompress(idat)
        bits, step = channels * depth, max(1, channels * depth // 8)
        if laced:
            s, at = np.zeros((h, w, channels), np.uint8), 0
            for x0, y0, dx, dy in PASSES:
                pw, ph = -(-max(0, w - x0) // dx), -(-max(0, h - y0) // dy)
                if pw and ph:
                    stride = -(-pw * bits // 8)
                    s[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], ph, stride, step), pw, channels, depth)
                    at += ph * (stride + 1)
        else:
            s = _samples(_unfilter(raw, h, -(-w * bits // 8), step), w, channels, depth)
    except ImageError:
        raise
    except Exception as e:
        raise ImageError(f"broken PNG: {e}") from e
    out = np.full((h, w, 4), 255, np.uint8)
    if ctype == 3:
        if palette is None:
            raise ImageError("no palette")
        k = np.minimum(s[..., 0], len(palette) - 1)
        out[..., :3] = palette[k]
        if trns:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(trns)] = np.frombuffer(trns, np.uint8)
            out[..., 3] = alpha[k]
        return out
    scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
    out[..., :3] = s[..., :3] * scale if channels >= 3 else s[..., :1] * scale
    if channels in (2, 4):
        out[..., 3] = s[..., -1]
    elif trns:
        key = np.frombuffer(trns, ">u2")
        key = (key >> 8 if depth == 16 else key).astype(np.uint8)
        out[..., 3] = np.where((s == key).all(axis=-1), 0, 255)
    return out


def encode_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1).tobytes()
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 (palette), 24 and 32 bits."""
    try:
        start, = struct.unpack("<I", data[10:14])
        head, w, h, _, bits, packed = struct.unpack("<IiiHHI", data[14:34])
        if bits not in (8, 24, 32) or packed not in (0, 3):
            raise ImageError(f"bitmap of {bits} bits, packing {packed}")
        stride = (w * bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:: 1 if h < 0 else -1]
        out = np.full((abs(h), w, 4), 255, np.uint8)
        if bits == 8:
            table = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
            out[..., :3] = table[rows[:, :w], 2::-1]
        else:
            px = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
            out[..., :3] = px[..., 2::-1]
        return out
    except ImageError:
        raise
    except Exception as e:
        raise ImageError(f"broken bitmap: {e}") from e


def decode(data: bytes) -> np.ndarray:
    kind = sniff(data)
    if kind == "png":
        return decode_png(data)
    if kind == "bmp":
        return decode_bmp(data)
    raise ImageError(f"no decoder for {kind or 'unknown bytes'}")
