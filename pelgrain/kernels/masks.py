"""Mask candidates: overlap, greedy selection, resampling for a segmentation model."""

from __future__ import annotations

import numpy as np


def iou(a: np.ndarray, b: np.ndarray, level: int = 128) -> float:
    """Overlap of foregrounds; two empty masks have none."""
    x, y = a >= level, b >= level
    union = int((x | y).sum())
    return int((x & y).sum()) / union if union else 0.0


def select(candidates: list[tuple[float, tuple[int, int], np.ndarray]], limit: float) -> list[int]:
    """Indices kept, best first: (score, tie key, mask) whose overlap with every one kept before is under the limit."""
    kept: list[int] = []
    for k in sorted(range(len(candidates)), key=lambda k: (-candidates[k][0], candidates[k][1])):
        if all(iou(candidates[k][2], candidates[j][2]) < limit for j in kept):
            kept.append(k)
    return kept


def resize_bilinear(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Half-pixel bilinear, without widening when reducing."""
    h, w = rgb.shape[:2]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    v = rgb.astype(np.float64)
    rows = v[y0] * (1 - fy)[:, None, None] + v[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def model_input(rgb: np.ndarray, side: int = 1024) -> tuple[np.ndarray, float]:
    """float32 (side, side, 3): long edge to `side`, zeros to the right and below; and the scale."""
    h, w = rgb.shape[:2]
    scale = side / max(h, w)
    small = resize_bilinear(rgb[..., :3], max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))
    out = np.zeros((side, side, 3), np.float32)
    out[: small.shape[0], : small.shape[1]] = small
    return out, scale


def upsample(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest neighbour."""
    h, w = mask.shape
    y = np.minimum(((np.arange(height) + 0.5) * h / height).astype(int), h - 1)
    x = np.minimum(((np.arange(width) + 0.5) * w / width).astype(int), w - 1)
    return mask[y][:, x]
