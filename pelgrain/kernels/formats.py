"""Images of all formats this engine reads: size from the header, pixels turned upright and in sRGB."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from pelgrain.kernels import jpeg, png
from pelgrain.kernels.png import ImageError, sniff

# The primaries of sRGB under D50, as columns of X, Y and Z.
SRGB_D50 = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height as stored, from the header alone."""
    kind = sniff(data)
    if kind == "jpeg":
        return jpeg.size(data)
    if kind == "gif" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    return png.dimensions(data[:32])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _unpacked(data: bytes, least: int, n: int) -> np.ndarray:
    """LZW codes of GIF -> n values."""
    clear = 1 << least
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, width, before = list(roots), least + 1, b""
    out, length, hold, held = [], 0, 0, 0
    for byte in data:
        hold |= byte << held
        held += 8
        while held >= width:
            code = hold & (1 << width) - 1
            hold >>= width
            held -= width
            if code == clear:
                table, width, before = list(roots), least + 1, b""
                continue
            if code == clear + 1 or length >= n:
                return np.frombuffer(b"".join(out)[:n].ljust(n, b"\0"), np.uint8)
            if code < len(table):
                word = table[code]
            elif before and code == len(table):
                word = before + before[:1]
            else:
                raise ImageError("broken GIF: a code out of turn")
            if before and len(table) < 4096:
                table.append(before + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out.append(word)
            length += len(word)
            before = word
    return np.frombuffer(b"".join(out)[:n].ljust(n, b"\0"), np.uint8)


def decode_gif(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes: the first frame on a transparent canvas."""
    try:
        w, h, flags = struct.unpack("<HHB", data[6:11])
        at, table, clear = 13, None, None
        if flags & 128:
            n = 2 << (flags & 7)
            table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        out = np.zeros((h, w, 4), np.uint8)
        while data[at] != 0x3B:
            if data[at] == 0x21:
                body, after = _blocks(data, at + 2)
                if data[at + 1] == 0xF9 and body[0] & 1:
                    clear = body[3]
                at = after
                continue
            x, y, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if flags & 128:
                n = 2 << (flags & 7)
                table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            least = data[at]
            body, at = _blocks(data, at + 1)
            px = _unpacked(body, least, fw * fh).reshape(fh, fw)
            if flags & 64:
                order = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                px = px[np.argsort(order)]
            px = px[: max(0, h - y), : max(0, w - x)]
            frame = out[y : y + fh, x : x + fw]
            frame[..., :3] = table[np.minimum(px, len(table) - 1)]
            frame[..., 3] = 255 if clear is None else np.where(px == clear, 0, 255)
            return out
    except ImageError:
        raise
    except Exception as e:
        raise ImageError(f"broken GIF: {e}") from e
    raise ImageError("GIF without a frame")


def _png_chunk(data: bytes, kind: bytes) -> bytes | None:
    at = 8
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        if name in (kind, b"IDAT"):
            return data[at + 8 : at + 8 + n] if name == kind else None
        at += n + 12
    return None


def orientation(exif: bytes | None) -> int:
    """1 to 8 from the first directory of Exif data; 1 where it says nothing sound."""
    try:
        order = {b"II": "<", b"MM": ">"}[exif[:2]]
        (at,) = struct.unpack(order + "I", exif[4:8])
        (n,) = struct.unpack(order + "H", exif[at : at + 2])
        for k in range(n):
            tag, kind, _, value = struct.unpack(order + "HHIH", exif[at + 2 + 12 * k : at + 12 + 12 * k])
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
    except Exception:  # broken metadata never fails an image
        pass
    return 1


def upright(px: np.ndarray, turn: int) -> np.ndarray:
    """The image as it is meant to be seen."""
    if turn in (5, 7):
        px = px.transpose(1, 0, 2)
        return px if turn == 5 else px[::-1, ::-1]
    return {2: px[:, ::-1], 3: px[::-1, ::-1], 4: px[::-1], 6: np.rot90(px, -1), 8: np.rot90(px)}.get(turn, px)


def _curve(tag: bytes) -> np.ndarray:
    """Linear light by byte value."""
    v = np.arange(256) / 255
    if tag[:4] == b"curv":
        (n,) = struct.unpack(">I", tag[8:12])
        if n == 0:
            return v
        table = np.frombuffer(tag, ">u2", n, 12).astype(np.float64)
        return v ** (table[0] / 256) if n == 1 else np.interp(v, np.linspace(0, 1, n), table / 65535)
    kind = struct.unpack(">H", tag[8:10])[0]
    n = (1, 3, 4, 5, 7)[kind]
    g, a, b, c, d, e, f = (*(x / 65536 for x in struct.unpack(f">{n}i", tag[12 : 12 + 4 * n])), *[0.0] * (7 - n))
    if kind == 0:
        return v**g
    if kind in (1, 2):
        return np.where(v >= -b / a, np.maximum(a * v + b, 0) ** g + c, c)
    return np.where(v >= d, np.maximum(a * v + b, 0) ** g + e, c * v + f)


def to_srgb(px: np.ndarray, profile: bytes | None) -> np.ndarray:
    """Colours of an RGB profile made of primaries and curves, in sRGB; any other profile leaves them as they are."""
    try:
        if profile is None or profile[16:20] != b"RGB ":
            return px
        (n,) = struct.unpack(">I", profile[128:132])
        tags = {}
        for k in range(n):
            name, at, size = struct.unpack(">4sII", profile[132 + 12 * k : 144 + 12 * k])
            tags[name] = profile[at : at + size]
        to_xyz = np.stack([np.array(struct.unpack(">3i", tags[c + b"XYZ"][8:20])) / 65536 for c in (b"r", b"g", b"b")], axis=1)
        light = [_curve(tags[c + b"TRC"])[px[..., k]] for k, c in enumerate((b"r", b"g", b"b"))]
        linear = np.clip(np.stack(light, axis=2) @ (np.linalg.inv(SRGB_D50) @ to_xyz).T, 0, 1)
        out = px.copy()
        out[..., :3] = np.floor(np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055) * 255 + 0.5)
        return out
    except Exception:  # a profile that cannot be used never fails an image
        return px


def decode(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes of PNG, JPEG, GIF or BMP, turned by its Exif orientation and converted from its profile."""
    kind = sniff(data)
    if kind == "jpeg":
        return np.ascontiguousarray(to_srgb(upright(jpeg.decode_jpeg(data), orientation(jpeg.exif(data))), jpeg.profile(data)))
    if kind == "gif":
        return decode_gif(data)
    if kind == "png":
        named = _png_chunk(data, b"iCCP")
        try:
            profile = zlib.decompress(named[named.index(b"\0") + 2 :]) if named else None
        except Exception:
            profile = None
        return np.ascontiguousarray(to_srgb(upright(png.decode_png(data), orientation(_png_chunk(data, b"eXIf"))), profile))
    return png.decode(data)
