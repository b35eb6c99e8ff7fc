"""Filters and resampling of one image."""

from __future__ import annotations

import math

import numpy as np


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


KERNELS = {
    "triangle": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))),
    "catmull-rom": (2.0, _cubic),
    "lanczos3": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
}


def weights(source: int, target: int, name: str) -> np.ndarray:
    """(target, source) weights, pixel centred; the kernel widens when reducing."""
    reach, kernel = KERNELS[name]
    scale = source / target
    wide = max(1.0, scale)
    mid = (np.arange(target) + 0.5) * scale - 0.5
    m = kernel((np.arange(source)[None, :] - mid[:, None]) / wide)
    m[np.abs(np.arange(source)[None, :] - mid[:, None]) > reach * wide] = 0
    return m / m.sum(axis=1, keepdims=True)


def _along(p: np.ndarray, target: int, name: str) -> np.ndarray:
    """The first axis resampled: for each target the few sources that weigh anything."""
    m = weights(len(p), target, name).astype(np.float32)
    taps = int((m != 0).sum(axis=1).max())
    first = np.minimum((m != 0).argmax(axis=1), len(p) - taps)
    out = np.zeros((target, *p.shape[1:]), np.float32)
    for k in range(taps):
        out += m[np.arange(target), first + k][:, None, None] * p[first + k]
    return out


def resize(rgba: np.ndarray, width: int, height: int, name: str) -> np.ndarray:
    """Resampled with colour weighted by alpha, so that hidden colour does not bleed."""
    h, w = rgba.shape[:2]
    if name == "nearest":
        y = np.minimum(np.floor((np.arange(height) + 0.5) * h / height), h - 1).astype(int)
        x = np.minimum(np.floor((np.arange(width) + 0.5) * w / width), w - 1).astype(int)
        return rgba[y][:, x]
    a = rgba[..., 3:].astype(np.float32) / np.float32(255)
    p = np.concatenate([rgba[..., :3] * a, rgba[..., 3:]], axis=2, dtype=np.float32)
    p = _along(p, height, name)
    p = _along(p.transpose(1, 0, 2), width, name).transpose(1, 0, 2)
    alpha = np.clip(p[..., 3:], 0, 255)
    rgb = np.where(alpha > 0, p[..., :3] / np.maximum(alpha / 255, 1e-9), 0)
    return np.clip(np.floor(np.concatenate([rgb, alpha], axis=2) + 0.5), 0, 255).astype(np.uint8)


def shrink_to(rgba: np.ndarray, most: int, mode: str) -> tuple[np.ndarray, float]:
    """At most `most` on the long side, and the factor: Lanczos for photos, nearest for pixel art, else triangle."""
    h, w = rgba.shape[:2]
    f = min(1.0, most / max(h, w))
    if f >= 1.0:
        return rgba, 1.0
    name = {"photo": "lanczos3", "pixel-art": "nearest"}.get(mode, "triangle")
    return resize(rgba, max(1, math.floor(w * f + 0.5)), max(1, math.floor(h * f + 0.5)), name), f


def upscale(rgba: np.ndarray, factor: int) -> np.ndarray:
    f = max(1, min(8, factor))
    return rgba if f == 1 else resize(rgba, rgba.shape[1] * f, rgba.shape[0] * f, "catmull-rom")


def bilateral(rgba: np.ndarray, colour: float = 20.0) -> np.ndarray:
    """Edge-preserving smoothing, a pass along x and one along y, rounded between; alpha stays."""
    h, w = rgba.shape[:2]
    sigma = max(1.0, min(w, h) / 200)
    reach = math.ceil(2 * sigma)
    near = np.exp(-np.arange(3 * 255 * 255 + 1) / (2 * colour * colour))  # squared gaps are whole numbers
    planes = [np.ascontiguousarray(rgba[..., c]).astype(np.int32) for c in range(3)]
    for axis in (1, 0):
        n = (h, w)[axis]
        total, norm = [p.astype(np.float64) for p in planes], np.ones((h, w))
        for d in range(1, min(reach, n - 1) + 1):
            a, b = (slice(None), slice(None, n - d)) if axis else (slice(None, n - d),), (slice(None), slice(d, None)) if axis else (slice(d, None),)
            gap = sum((p[a] - p[b]) ** 2 for p in planes)
            weight = near[gap] * math.exp(-d * d / (2 * sigma * sigma))
            for p, t in zip(planes, total, strict=True):
                t[a] += p[b] * weight
                t[b] += p[a] * weight
            norm[a] += weight
            norm[b] += weight
        planes = [np.clip(np.floor(t / norm + 0.5), 0, 255).astype(np.int32) for t in total]
    return np.stack([*planes, rgba[..., 3]], axis=2).astype(np.uint8)


def deblock(rgba: np.ndarray) -> np.ndarray:
    """Weights 1 2 1 beside 8-pixel borders: columns, then rows."""
    h, w = rgba.shape[:2]
    if w <= 2 or h <= 2:
        return rgba
    out = rgba.astype(np.int64)
    for axis, n in ((1, w), (0, h)):
        at = np.arange(1, n - 1)
        at = at[(at % 8 == 0) | ((at + 1) % 8 == 0)]
        v = np.moveaxis(out[..., :3], axis, 0)
        v[at] = ((v[at - 1] + 2 * v[at] + v[at + 1] + 2) // 4).copy()
    return out.astype(np.uint8)


def blockiness(rgba: np.ndarray) -> float:
    """100 over the ratio of mean steps across 8-pixel borders to those inside, at most 100."""
    v = rgba[..., :3].astype(np.float64)
    edge, inner = [], []
    for axis in (1, 0):
        d = np.moveaxis(np.abs(np.diff(v, axis=axis)).mean(axis=2), axis, 0) if axis == 1 else np.abs(np.diff(v, axis=axis)).mean(axis=2)
        on = (np.arange(len(d)) + 1) % 8 == 0
        edge.append(d[on].ravel())
        inner.append(d[~on].ravel())
    e, i = np.concatenate(edge), np.concatenate(inner)
    if not len(e):
        return 100.0
    if not len(i) or i.mean() < 1e-5:
        return 0.0 if e.mean() > 1e-5 else 100.0
    r = e.mean() / i.mean()
    return 100.0 if r <= 1 else 100.0 / r


def crop(rgba: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return rgba[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def classify(rgba: np.ndarray) -> str:
    """pixel-art, line-art, icon or photo; the same rules as the pixel-table operator."""
    h, w = rgba.shape[:2]
    rgb, alpha = rgba[..., :3].astype(np.int64), rgba[..., 3]
    key = rgb @ np.array([65536, 256, 1])
    values, n = np.unique(key, return_counts=True)
    if max(h, w) <= 128 and 3 <= len(values) <= 64 and (alpha == 255).all() and not has_blends(rgb):
        return "pixel-art"
    from pelgrain.kernels.quant import _box

    luma = np.floor(rgb @ np.array([299, 587, 114])).astype(np.float64)
    side = max(3, min(w, h) // 8)
    total, area = _box(luma, (side + 1 - side % 2) // 2)
    if (luma * area < total - area * 10_000).sum() * 4 < h * w:
        return "line-art"
    between = np.unique(alpha[(alpha > 0) & (alpha < 255)])
    if (alpha != 255).any() and len(between) <= 2 or (n >= math.ceil(h * w * 0.01)).sum() <= 32:
        return "icon"
    return "photo"


def has_blends(rgb: np.ndarray) -> bool:
    """Some pixel mixes two different colours among its eight neighbours."""
    h, w = rgb.shape[:2]
    for y in range(h):
        for x in range(w):
            c = rgb[y, x]
            near = np.unique(rgb[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].reshape(-1, 3), axis=0)
            near = near[(near != c).any(axis=1)].astype(np.float64)
            for i in range(len(near)):
                for b in near[i + 1 :]:
                    a = near[i]
                    ok = np.abs(a - b) > 1
                    share = ((c - b)[ok]) / ((a - b)[ok])
                    share = share[(share >= -0.2) & (share <= 1.2)]
                    if len(share) >= 2 and 0.01 < (m := share.mean()) < 0.99 and np.abs(c - (m * a + (1 - m) * b)).max() < 15:
                        return True
    return False


def background(rgba: np.ndarray) -> tuple[int, int, int] | None:
    """The first corner with which two later ones agree in Lab."""
    from pelgrain.kernels.quant import to_lab

    four = rgba[[0, 0, -1, -1], [0, -1, 0, -1], :3].astype(np.int64)
    lab = to_lab(four)
    for i in range(2):
        if (((lab[i + 1 :] - lab[i]) ** 2).sum(axis=1) < 5.0).sum() >= 2:
            return tuple(int(v) for v in four[i])
    return None
