"""Centre lines of ink: distances, thinning, pruning, graph, traversal, smoothing."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from pelgrain.kernels import curves
from pelgrain.kernels.quant import sauvola
from pelgrain.kernels.raster import label

Pixel = tuple[int, int]  # (y, x)
EIGHT = [(-1, 0), (0, 1), (1, 0), (0, -1), (-1, 1), (1, 1), (1, -1), (-1, -1)]


def binarise(rgba: np.ndarray, window: int = 21, k: float = 0.5) -> np.ndarray:
    """Ink by the local threshold; pixels of alpha under 10 are paper."""
    luma = rgba[..., :3] @ np.array([0.299, 0.587, 0.114])
    luma = np.where(rgba[..., 3] < 10, 255.0, luma)
    return (luma < sauvola(luma, window // 2, k)) & (rgba[..., 3] >= 10)


def distances(ink: np.ndarray) -> np.ndarray:
    """Distance of ink pixels to the paper pixel that a breadth-first search brings along: near, not always the nearest.

    Without any paper, the distance to the border.
    """
    h, w = ink.shape
    if ink.all():
        y, x = np.mgrid[:h, :w]
        return np.minimum(np.minimum(y + 1, h - y), np.minimum(x + 1, w - x)).astype(np.float64)
    # a rim of -1 that nothing comes under; paper away from ink has nothing to bring along
    wide = w + 2
    flat = np.full((h + 2, wide), -1.0)
    flat[1:-1, 1:-1] = np.where(ink, np.inf, 0)
    out = flat.ravel().tolist()
    rim = np.pad(ink, 1)
    beside = np.zeros((h, w), bool)
    for dy, dx in EIGHT:
        beside |= rim[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    queue = deque((int(y), int(x), int(y), int(x)) for y, x in zip(*np.nonzero(~ink & beside), strict=True))
    steps = [(dy, dx, dy * wide + dx) for dy, dx in EIGHT]
    hypot = math.hypot
    while queue:
        y, x, sy, sx = queue.popleft()
        here, ry, rx = (y + 1) * wide + x + 1, y - sy, x - sx
        for dy, dx, step in steps:
            old = out[here + step]
            if old > 0:
                d = hypot(ry + dy, rx + dx)
                if d < old - 1e-9:
                    out[here + step] = d
                    queue.append((y + dy, x + dx, sy, sx))
    return np.array(out).reshape(h + 2, wide)[1:-1, 1:-1]


def thin(ink: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning: two parallel passes until nothing changes."""
    s = np.pad(ink, 1).astype(np.uint8)
    while True:
        before = s.copy()
        for turn in (0, 1):
            n = [s[:-2, 1:-1], s[:-2, 2:], s[1:-1, 2:], s[2:, 2:], s[2:, 1:-1], s[2:, :-2], s[1:-1, :-2], s[:-2, :-2]]
            count = sum(x.astype(np.int64) for x in n)
            rises = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(np.int64) for i in range(8))
            a, b = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if turn == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            off = (s[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (rises == 1) & (a == 0) & (b == 0)
            s[1:-1, 1:-1][off] = 0
        if (s == before).all():
            return s[1:-1, 1:-1] == 1


def neighbours(skeleton: set[Pixel], p: Pixel) -> list[Pixel]:
    """Adjacent skeleton pixels; a diagonal one does not count beside an orthogonal one that leads there."""
    y, x = p
    out = [(y + dy, x + dx) for dy, dx in EIGHT[:4] if (y + dy, x + dx) in skeleton]
    for dy, dx in EIGHT[4:]:
        q = (y + dy, x + dx)
        if q in skeleton and (y + dy, x) not in skeleton and (y, x + dx) not in skeleton:
            out.append(q)
    return out


def _walk(skeleton: set[Pixel], start: Pixel, nxt: Pixel, stop: set[Pixel]) -> list[Pixel]:
    chain = [start, nxt]
    while chain[-1] not in stop:
        ahead = [q for q in neighbours(skeleton, chain[-1]) if q != chain[-2]]
        if len(ahead) != 1 or ahead[0] == start and len(chain) > 2 and start not in stop:
            break
        chain.append(ahead[0])
    return chain


def prune(skeleton: set[Pixel], dist: np.ndarray) -> set[Pixel]:
    """Chains from an end that are shorter than three times the half-width at their base go, until none is left."""
    s = set(skeleton)
    while True:
        gone: set[Pixel] = set()
        degree = {p: len(neighbours(s, p)) for p in s}
        nodes = {p for p, d in degree.items() if d != 2}
        for p in sorted(nodes):
            if degree[p] != 1:
                continue
            chain = _walk(s, p, neighbours(s, p)[0], nodes)
            base = chain[-1]
            if degree.get(base, 0) >= 3 and len(chain) - 1 < 3 * dist[base]:
                gone.update(chain[:-1])
        if not gone:
            return s
        s -= gone


def graph(skeleton: set[Pixel]) -> tuple[list[Pixel], list[tuple[int, int, list[Pixel]]]]:
    """Nodes (pixels without exactly two neighbours; the top left one of a loop) and edges with their pixels."""
    degree = {p: len(neighbours(skeleton, p)) for p in skeleton}
    nodes = sorted(p for p, d in degree.items() if d != 2)
    number, stop = {p: k for k, p in enumerate(nodes)}, set(nodes)
    edges, seen = [], set(nodes)
    done: set[tuple[Pixel, Pixel]] = set()
    for p in nodes:
        for q in neighbours(skeleton, p):
            if (p, q) in done:
                continue
            chain = _walk(skeleton, p, q, stop)
            if chain[-1] not in stop:
                continue
            done |= {(p, q), (chain[-1], chain[-2])}
            seen.update(chain)
            edges.append((number[p], number[chain[-1]], chain))
    for p in sorted(skeleton - seen):
        if p in seen:
            continue
        near = neighbours(skeleton, p)
        chain = [p, near[0]] if near else [p]
        while len(chain) > 1:
            ahead = [q for q in neighbours(skeleton, chain[-1]) if q != chain[-2]]
            if not ahead or ahead[0] == p:
                chain.append(p)
                break
            chain.append(ahead[0])
        seen.update(chain)
        nodes.append(p)
        edges.append((len(nodes) - 1, len(nodes) - 1, chain))
    return nodes, edges


def merge_junctions(nodes: list[Pixel], edges: list, dist: np.ndarray) -> tuple[list[Pixel], list]:
    """Junctions joined by an edge shorter than twice their greater half-width become one, at their rounded centroid."""
    degree = [0] * len(nodes)
    for a, b, _ in edges:
        degree[a] += 1
        degree[b] += 1
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, b, chain in edges:
        if a != b and degree[a] >= 3 and degree[b] >= 3 and len(chain) - 1 < 2 * max(dist[nodes[a]], dist[nodes[b]]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for k in range(len(nodes)):
        groups.setdefault(find(k), []).append(k)
    place = {g: nodes[g] if len(m) == 1 else (math.floor(sum(nodes[k][0] for k in m) / len(m) + 0.5), math.floor(sum(nodes[k][1] for k in m) / len(m) + 0.5)) for g, m in groups.items()}
    number = {g: k for k, g in enumerate(groups)}
    out = []
    for a, b, chain in edges:
        x, y = find(a), find(b)
        if x == y and a != b and len(chain) - 1 < 2 * max(dist[nodes[a]], dist[nodes[b]]):
            continue
        out.append((number[x], number[y], [place[x], *chain[1:-1], place[y]]))
    return [place[g] for g in groups], out


def trails(n: int, edges: list) -> list[list[Pixel]]:
    """Paths that use every edge once: one circuit or trail where there are 0 or 2 odd nodes, else greedy walks from odd nodes."""
    at: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(edges):
        at[a].append(k)
        if a != b:
            at[b].append(k)
        else:
            at[a].append(k)
    used = [False] * len(edges)
    out = []

    def along(k: int, a: int) -> tuple[int, list[Pixel]]:
        x, y, chain = edges[k]
        return (y, chain) if x == a else (x, chain[::-1])

    parts: list[list[int]] = []
    seen = [False] * n
    for s in range(n):
        if seen[s] or not at[s]:
            continue
        todo, part = [s], []
        seen[s] = True
        while todo:
            a = todo.pop()
            part.append(a)
            for k in at[a]:
                b = edges[k][1] if edges[k][0] == a else edges[k][0]
                if not seen[b]:
                    seen[b] = True
                    todo.append(b)
        parts.append(sorted(part))
    for part in parts:
        odd = [a for a in part if len(at[a]) % 2]
        if len(odd) in (0, 2):
            # Hierholzer from an odd node, or the first one
            path: list[tuple[int, int]] = [(odd[0] if odd else part[0], -1)]
            order: list[tuple[int, int]] = []
            while path:
                a = path[-1][0]
                k = next((k for k in at[a] if not used[k]), None)
                if k is None:
                    order.append(path.pop())
                else:
                    used[k] = True
                    path.append((along(k, a)[0], k))
            order.reverse()
            pixels: list[Pixel] = []
            for (a, _), (_, k) in zip(order, order[1:], strict=False):
                chain = along(k, a)[1]
                pixels += chain[1:] if pixels else chain
            if pixels:
                out.append(pixels)
            continue
        for start in odd + part:
            while any(not used[k] for k in at[start]):
                a, pixels = start, []
                while (k := next((k for k in at[a] if not used[k]), None)) is not None:
                    used[k] = True
                    a, chain = along(k, a)
                    pixels += chain[1:] if pixels else chain
                out.append(pixels)
                if start in odd:
                    break
    return out


def extend(points: list[tuple[float, float]], ink: np.ndarray, reach: float) -> list[tuple[float, float]]:
    """Both ends prolonged along their direction over five points, in quarter steps while there is ink, by `reach` at most."""
    def end(p: list[tuple[float, float]]) -> tuple[float, float] | None:
        q = np.array(p[:5])
        if len(q) < 2:
            return None
        c = q - q.mean(axis=0)
        _, _, v = np.linalg.svd(c)
        d = v[0] if (q[0] - q[-1]) @ v[0] >= 0 else -v[0]
        best = None
        for k in range(1, int(min(reach, 8.0) / 0.25) + 1):
            x, y = q[0] + d * 0.25 * k
            if not (0 <= y < ink.shape[0] and 0 <= x < ink.shape[1] and ink[int(y), int(x)]):
                break
            best = (float(x), float(y))
        return best

    a, b = end(points), end(points[::-1])
    return ([a] if a else []) + points + ([b] if b else [])


def smooth(points: list[tuple[float, float]], closed: bool) -> list[tuple[float, float]]:
    """Pixel steps evened out by weights 1 2 1, twice; ends of open chains stay."""
    p = np.asarray(points)
    if len(p) < 4:
        return points
    for _ in range(2):
        q = p.copy()
        q[1:-1] = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        if closed:
            q[0] = q[-1] = (p[-2] + 2 * p[0] + p[1]) / 4
        p = q
    return [(float(x), float(y)) for x, y in p]


def trace(ink: np.ndarray, turdsize: int = 2, tolerance: float = 0.5, merge: bool = True, blobs: bool = True) -> tuple[list[dict], np.ndarray]:
    """Strokes (points, segments, width, widths, closed, component) and the mask of compact blobs that are rather filled."""
    dist, regions = distances(ink), label(ink, True)
    fill = np.zeros_like(ink)
    line = ink.copy()
    for k in range(1, int(regions.max(initial=0)) + 1):
        own = regions == k
        n, d = int(own.sum()), float(dist[own].max())
        if n < turdsize:
            line[own] = False
        elif blobs and n <= 2.5 * math.pi * d * d:
            fill |= own
            line[own] = False
    skeleton = {(int(y), int(x)) for y, x in zip(*np.nonzero(thin(line)), strict=True)}
    skeleton = prune(skeleton, dist)
    nodes, edges = graph(skeleton)
    if merge:
        nodes, edges = merge_junctions(nodes, edges, dist)
    out = []
    for chain in trails(len(nodes), edges):
        inside = [p for p in chain if ink[p]]
        widths = sorted(2 * float(dist[p]) for p in inside) or [1.0]
        m = len(widths)
        width = (widths[(m - 1) // 2] + widths[m // 2]) / 2
        closed = len(chain) > 2 and chain[0] == chain[-1]
        points = [(x + 0.5, y + 0.5) for y, x in chain]
        if not closed and len(points) > 1:
            points = extend(points, ink, width / 2)
        segments = curves.fit_open(smooth(points, closed), tolerance)
        out.append({"points": points, "segments": segments, "width": width, "widths": [2 * float(dist[p]) for p in chain], "closed": closed, "component": int(regions[inside[0]]) if inside else 0})
    out.sort(key=lambda s: (s["points"][0][1], s["points"][0][0]))
    return out, fill
