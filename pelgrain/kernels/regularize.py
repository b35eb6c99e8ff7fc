"""Straightening of traced strokes: weld, close, recognise, snap, grid, unify, with a report."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from pelgrain.kernels.curves import Segment, off_line

Point = tuple[float, float]


@dataclass(frozen=True)
class Rules:
    """Fixed defaults of the clean-up, in units of the canonical box."""

    grid_pitch: float = 1.0
    max_grid_dev: float = 1.5
    max_angle_dev: float = 6.0
    weld_eps: float = 1.0
    close_eps: float = 1.2
    fit_tol: float = 0.8
    width_tol: float = 0.15
    width_quantum: float = 0.25
    snaps: tuple[float, ...] = (0.0, 45.0, 90.0, 135.0)
    least_snap: float = 3.0


@dataclass
class Report:
    welded: int = 0
    loops_closed: int = 0
    lines_fitted: int = 0
    arcs_fitted: int = 0
    angles_snapped: int = 0
    points_gridded: int = 0
    widths_unified: bool = False
    mirror_axis: float | None = None
    max_displacement: float = 0.0
    confidence: float = 1.0


@dataclass
class Stroke:
    segments: list[Segment]
    primitive: dict | None = None
    width: float = 1.0
    tags: dict = field(default_factory=dict)

    def points(self) -> list[Point]:
        return [(c[k], c[k + 1]) for _, c in self.segments for k in range(0, len(c), 2)]

    @property
    def closed(self) -> bool:
        return bool(self.segments) and self.segments[-1][0] == "Z"


def snap_angle(a: Point, b: Point, snaps: tuple[float, ...], most: float) -> tuple[Point, Point]:
    """The segment turned about its middle to the nearest direction (mod 180 degrees), if that is near enough."""
    size = math.hypot(b[0] - a[0], b[1] - a[1])
    if not snaps or size < 1e-12 or not math.isfinite(size):
        return a, b
    angle = math.degrees(math.atan2(b[1] - a[1], b[0] - a[0]))
    turn = min((math.remainder(angle - s, 180.0) for s in snaps), key=abs)
    if abs(turn) > most:
        return a, b
    t = math.radians(angle - turn)
    mx, my, dx, dy = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, size / 2 * math.cos(t), size / 2 * math.sin(t)
    return (mx - dx, my - dy), (mx + dx, my + dy)


def snap_to_grid(p: Point, pitch: float, most: float) -> Point:
    """The nearest grid point if both coordinates are near enough."""
    if pitch <= 0 or not math.isfinite(pitch) or not math.isfinite(most):
        return p
    q = tuple(math.copysign(math.floor(abs(v) / pitch + 0.5), v) * pitch for v in p)
    return q if all(abs(v - w) <= most for v, w in zip(p, q, strict=True)) else p


def weld(strokes: list[Stroke], eps: float) -> int:
    """Ends within eps of each other, in chains, move to their middle. How many moved."""
    ends = [(k, s) for k, x in enumerate(strokes) if x.segments and not x.closed for s in (0, -1)]
    at = [tuple(strokes[k].segments[s][1][-2:]) for k, s in ends]
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(at)), key=lambda i: at[i])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if at[j][0] - at[i][0] > eps:
                break
            if math.dist(at[i], at[j]) <= eps:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(at)):
        groups.setdefault(find(i), []).append(i)
    moved = 0
    for g in groups.values():
        if len(g) > 1:
            mid = [sum(at[i][c] for i in g) / len(g) for c in (0, 1)]
            for i in g:
                moved += math.dist(at[i], mid) > 1e-12
                strokes[ends[i][0]].segments[ends[i][1]][1][-2:] = mid
    return moved


def close_loop(s: Stroke, eps: float) -> bool:
    if not s.segments or s.closed or math.dist(s.segments[0][1][-2:], s.segments[-1][1][-2:]) > eps:
        return False
    s.segments[-1][1][-2:] = s.segments[0][1][-2:]
    s.segments.append(("Z", []))
    return True


def fit_line(p: np.ndarray, tol: float) -> tuple[Point, Point] | None:
    """The ends of the total-least-squares line that all points are near."""
    if len(p) < 2:
        return None
    mid = p.mean(axis=0)
    _, _, v = np.linalg.svd(p - mid)
    d = v[0] if (p[-1] - p[0]) @ v[0] >= 0 else -v[0]
    if off_line(p, mid, mid + d).max() > tol:
        return None
    t = (p - mid) @ d
    a, b = mid + d * t.min(), mid + d * t.max()
    return (float(a[0]), float(a[1])), (float(b[0]), float(b[1]))


def fit_circle(p: np.ndarray, tol: float) -> tuple[float, float, float] | None:
    if len(p) < 3:
        return None
    x, y = p.T
    m = np.stack([x, y, np.ones(len(p))], axis=1)
    sol, _, rank, _ = np.linalg.lstsq(m, -(x * x + y * y), rcond=None)
    cx, cy = -sol[0] / 2, -sol[1] / 2
    r2 = cx * cx + cy * cy - sol[2]
    if rank < 3 or r2 <= 0 or np.abs(np.hypot(x - cx, y - cy) - math.sqrt(r2)).max() > tol:
        return None
    return float(cx), float(cy), math.sqrt(r2)


def fit_arc(p: np.ndarray, tol: float) -> dict | None:
    """A circle's part: its points turn one way by less than 350 degrees."""
    c = fit_circle(p, tol)
    if c is None:
        return None
    a = np.unwrap(np.arctan2(p[:, 1] - c[1], p[:, 0] - c[0]))
    if abs(a[-1] - a[0]) >= math.radians(350):
        return None
    return {"kind": "arc", "cx": c[0], "cy": c[1], "rx": c[2], "ry": c[2], "start_angle": float(a[0]), "end_angle": float(a[-1]), "rotation": 0.0}


def mirror_axis(strokes: list[Stroke], tol: float) -> float | None:
    """The mean x, if every point has a partner mirrored at it."""
    p = np.array([q for s in strokes for q in s.points()])
    if not len(p):
        return None
    axis = float(p[:, 0].mean())
    for x, y in p:
        if np.hypot(p[:, 0] - (2 * axis - x), p[:, 1] - y).min() > tol:
            return None
    return axis


def unify_widths(widths: list[float], tol: float, quantum: float) -> list[float]:
    """Chains of near widths take their median, in steps of the quantum."""
    order = sorted(range(len(widths)), key=lambda i: widths[i])
    out, group = list(widths), []

    def flush() -> None:
        if group:
            m = len(group)
            mid = (widths[group[(m - 1) // 2]] + widths[group[m // 2]]) / 2
            for i in group:
                out[i] = math.floor(mid / quantum + 0.5) * quantum if quantum > 0 and math.isfinite(quantum) else mid

    for i in order:
        if group:
            a, b = widths[group[-1]], widths[i]
            big = max(a, b)
            if (0.0 if a == b else math.inf) > tol if big <= 0 else abs(a - b) / big > tol:
                flush()
                group = []
        group.append(i)
    flush()
    return out


def regularize(strokes: list[Stroke], rules: Rules = Rules()) -> Report:
    """Seven passes in this order; strokes change in place. Points of raw paths are never put on the grid."""
    rep = Report(welded=weld(strokes, rules.weld_eps), loops_closed=sum(close_loop(s, rules.close_eps) for s in strokes))
    far = 0.0
    for s in strokes:
        p = np.array(s.points())
        if s.primitive is not None or len(p) < 2:
            continue
        if line := fit_line(p, rules.fit_tol):
            far = max(far, float(off_line(p, np.array(line[0]), np.array(line[1])).max()))
            s.segments = [("M", list(line[0])), ("L", list(line[1])), *([("Z", [])] if s.closed else [])]
            rep.lines_fitted += 1
        elif arc := fit_arc(p, rules.fit_tol):
            s.primitive = arc
        elif c := fit_circle(p, rules.fit_tol):
            s.primitive = {"kind": "circle", "cx": c[0], "cy": c[1], "rx": c[2], "ry": c[2]}
        if s.primitive is not None:
            far = max(far, float(np.abs(np.hypot(p[:, 0] - s.primitive["cx"], p[:, 1] - s.primitive["cy"]) - s.primitive["rx"]).max()))
            rep.arcs_fitted += 1
    for s in strokes:
        if s.closed or s.primitive is not None:
            continue
        for k in range(1, len(s.segments)):
            op, c = s.segments[k]
            before = s.segments[k - 1][1]
            a, b = tuple(before[-2:]), tuple(c[-2:])
            if op == "L" and math.dist(a, b) >= rules.least_snap:
                x, y = snap_angle(a, b, rules.snaps, rules.max_angle_dev)
                if (x, y) != (a, b):
                    far = max(far, math.dist(a, x), math.dist(b, y))
                    before[-2:], c[-2:] = list(x), list(y)
                    rep.angles_snapped += 1
    for s in strokes:
        if s.primitive is not None:
            q = snap_to_grid((s.primitive["cx"], s.primitive["cy"]), rules.grid_pitch, rules.max_grid_dev)
            if q != (s.primitive["cx"], s.primitive["cy"]):
                far = max(far, math.dist(q, (s.primitive["cx"], s.primitive["cy"])))
                s.primitive |= {"cx": q[0], "cy": q[1]}
                rep.points_gridded += 1
    new = unify_widths([s.width for s in strokes], rules.width_tol, rules.width_quantum)
    rep.widths_unified = any(abs(s.width - w) > 1e-12 for s, w in zip(strokes, new, strict=True))
    for s, w in zip(strokes, new, strict=True):
        s.width = w
    rep.mirror_axis = mirror_axis(strokes, rules.weld_eps)
    rep.max_displacement = far
    rep.confidence = max(0.0, min(1.0, 1 - far / rules.max_grid_dev))
    return rep
