"""Geometry kernel on numpy arrays of shape (n, 2), for what Column expressions cannot say.

Rings are closed implicitly. Nothing here knows of Spark; ``topology.py`` wraps it for Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from fractions import Fraction

import numpy as np

Ring = np.ndarray


def ring_area(r: Ring) -> float:
    x, y = r[:, 0], r[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def oriented(r: Ring) -> Ring:
    """Counter-clockwise, without repeated neighbours."""
    r = np.asarray(r, float)
    if len(r) > 1:
        r = r[(r != np.roll(r, 1, axis=0)).any(axis=1)]
    return r[::-1] if len(r) > 2 and ring_area(r) < 0 else r


def as_box(r: Ring) -> tuple[float, float, float, float] | None:
    """x0, y0, x1, y1 of a ring that is an axis-parallel rectangle, as most rooms are; else None."""
    if len(r) != 4:
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = r.tolist()
    if (ay == by and bx == cx and cy == dy and dx == ax) or (ax == bx and by == cy and cx == dx and dy == ay):
        return min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)
    return None


def segment_distance(a: Ring, b: Ring, c: Ring, d: Ring) -> np.ndarray:
    """Distances of the segments ab to the segments cd, element by element."""

    def point(p, s, t):
        v = t - s
        k = np.clip(((p - s) * v).sum(-1) / np.where((v * v).sum(-1) == 0, 1, (v * v).sum(-1)), 0, 1)
        return np.hypot(*np.moveaxis(p - (s + k[..., None] * v), -1, 0))

    def side(p, q, r):
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    apart = np.minimum.reduce([point(a, c, d), point(b, c, d), point(c, a, b), point(d, a, b)])
    return np.where(cross, 0.0, apart)


def edges(r: Ring | list[Ring]) -> tuple[Ring, Ring]:
    """Both ends of all edges of a ring, or of the rings (outer ones and holes) of a polygon."""
    if isinstance(r, list):
        return (np.concatenate(r), np.concatenate([np.roll(x, -1, axis=0) for x in r])) if r else (np.zeros((0, 2)), np.zeros((0, 2)))
    return r, np.roll(r, -1, axis=0)


def inside(r: Ring, p: np.ndarray) -> np.ndarray:
    """Even-odd test of many points, for a ring or all rings of a polygon; points on the boundary are not told apart."""
    a, b = edges(r)
    x, y = p[:, 0:1], p[:, 1:2]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum(axis=1) % 2 == 1


def boundary_distance(r: Ring, p: np.ndarray) -> np.ndarray:
    a, b = edges(r)
    v = b - a
    n = np.where((v * v).sum(1) == 0, 1, (v * v).sum(1))
    k = np.clip(((p[:, None] - a) * v).sum(-1) / n, 0, 1)
    near = a + k[..., None] * v
    return np.hypot(p[:, None, 0] - near[..., 0], p[:, None, 1] - near[..., 1]).min(axis=1)


def polygon_distance(r: Ring, s: Ring) -> float:
    """0 if they touch or overlap."""
    a, b = as_box(r), as_box(s)
    if a and b:
        return math.hypot(max(a[0] - b[2], b[0] - a[2], 0.0), max(a[1] - b[3], b[1] - a[3], 0.0))
    if len(r) > 2 and len(s) and inside(r, s[:1])[0] or len(s) > 2 and len(r) and inside(s, r[:1])[0]:
        return 0.0
    (a, b), (c, d) = edges(r), edges(s)
    return float(segment_distance(a[:, None], b[:, None], c[None], d[None]).min())


def boxes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`as_box` of many rings with equally many points (n, k, 2): which are boxes, their low and high corners."""
    x, y = r[..., 0], r[..., 1]
    low, high = r.min(axis=1), r.max(axis=1)
    if r.shape[1] != 4:
        return np.zeros(len(r), bool), low, high
    same = lambda z, i, j: z[:, i] == z[:, j]
    one = same(y, 0, 1) & same(x, 1, 2) & same(y, 2, 3) & same(x, 3, 0)
    two = same(x, 0, 1) & same(y, 1, 2) & same(x, 2, 3) & same(y, 3, 0)
    return one | two, low, high


def polygon_distances(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """:func:`polygon_distance` of many pairs at once; rings of a side have equally many points (n, k, 2)."""
    (one, a0, a1), (two, b0, b1) = boxes(r), boxes(s)
    gap = np.maximum(np.maximum(a0 - b1, b0 - a1), 0)
    out = np.hypot(gap[:, 0], gap[:, 1])
    rest = np.flatnonzero(~(one & two))
    if not len(rest):
        return out
    r, s = r[rest], s[rest]

    def holds(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
        a, b = ring, np.roll(ring, -1, axis=1)
        x, y = p[:, :1], p[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
        return (((a[..., 1] > y) != (b[..., 1] > y)) & (x < at)).sum(axis=1) % 2 == 1

    a, b, c, d = r[:, :, None], np.roll(r, -1, axis=1)[:, :, None], s[:, None], np.roll(s, -1, axis=1)[:, None]
    near = segment_distance(*np.broadcast_arrays(a, b, c, d)).reshape(len(rest), -1).min(axis=1)
    if r.shape[1] > 2:
        near[holds(r, s[:, 0])] = 0
    if s.shape[1] > 2:
        near[holds(s, r[:, 0])] = 0
    out[rest] = near
    return out


def intersection_area(r: Ring, s: Ring) -> float:
    """Area of the common part of two simple polygons, by slabs between all vertex and crossing heights.

    In a slab no edges cross, so the common width is linear and its mean height gives the exact area.
    """
    one, two = as_box(r), as_box(s)
    if one and two:
        return max(0.0, min(one[2], two[2]) - max(one[0], two[0])) * max(0.0, min(one[3], two[3]) - max(one[1], two[1]))
    r, s = oriented(r), oriented(s)
    if len(r) < 3 or len(s) < 3:
        return 0.0
    return common_region_area(r, s)


def common_region_area(r: Ring | list[Ring], s: Ring | list[Ring]) -> float:
    """Area that two polygons share; each is a ring, or all rings of a polygon with holes or several parts."""
    (a, b), (c, d) = edges(r), edges(s)
    if len(a) < 3 or len(c) < 3:
        return 0.0
    low, high = max(a[:, 1].min(), c[:, 1].min()), min(a[:, 1].max(), c[:, 1].max())
    if low >= high or max(a[:, 0].min(), c[:, 0].min()) >= min(a[:, 0].max(), c[:, 0].max()):
        return 0.0
    cuts = [a[:, 1], c[:, 1]]
    u, v, w = b[:, None] - a[:, None], d[None] - c[None], c[None] - a[:, None]
    den = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    ok = den != 0
    t = np.where(ok, (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / np.where(ok, den, 1), -1)
    k = np.where(ok, (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / np.where(ok, den, 1), -1)
    hit = ok & (t >= 0) & (t <= 1) & (k >= 0) & (k <= 1)
    cuts.append((a[:, None, 1] + t * u[..., 1])[hit])
    y = np.unique(np.clip(np.concatenate(cuts), low, high))
    total = 0.0
    for y0, y1 in zip(y[:-1], y[1:], strict=True):
        mid = (y0 + y1) / 2
        spans = []
        for p, q in ((a, b), (c, d)):
            on = (p[:, 1] > mid) != (q[:, 1] > mid)
            xs = np.sort(p[on, 0] + (mid - p[on, 1]) * (q[on, 0] - p[on, 0]) / (q[on, 1] - p[on, 1]))
            spans.append(xs.reshape(-1, 2))
        first, second = spans
        common = np.minimum(first[:, None, 1], second[None, :, 1]) - np.maximum(first[:, None, 0], second[None, :, 0])
        total += float(np.maximum(common, 0).sum()) * (y1 - y0)
    return total


def region_distance(r: list[Ring], s: list[Ring]) -> float:
    """Distance of two polygons with holes or several parts, 0 if they touch or overlap; infinite if one has no points."""
    (a, b), (c, d) = edges(r), edges(s)
    if not len(a) or not len(c):
        return math.inf
    if any(inside(r, x[:1])[0] for x in s) or any(inside(s, x[:1])[0] for x in r):
        return 0.0
    return float(segment_distance(a[:, None], b[:, None], c[None], d[None]).min())


def _followed(sizes: tuple[int, ...]) -> np.ndarray:
    """For each point of rings of these sizes, one after the other, the place of the next point of its ring."""
    out, at = [], 0
    for n in sizes:
        out += [*range(at + 1, at + n), at]
        at += n
    return np.array(out, int)


def region_distances(r: np.ndarray, rings: tuple[int, ...], s: np.ndarray, others: tuple[int, ...]) -> np.ndarray:
    """:func:`region_distance` of many pairs at once: points (n, k, 2) of polygons whose rings have these sizes."""
    b, d = r[:, _followed(rings)], s[:, _followed(others)]

    def holds(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        x, y = p[:, None, 0], p[:, None, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
        return (((a[..., 1] > y) != (b[..., 1] > y)) & (x < at)).sum(axis=1) % 2 == 1

    near = segment_distance(*np.broadcast_arrays(r[:, :, None], b[:, :, None], s[:, None], d[:, None])).reshape(len(r), -1).min(axis=1)
    for i in np.cumsum((0, *others[:-1])):
        near[holds(r, b, s[:, i])] = 0.0
    for i in np.cumsum((0, *rings[:-1])):
        near[holds(s, d, r[:, i])] = 0.0
    return near


def common_region_areas(r: np.ndarray, rings: tuple[int, ...], s: np.ndarray, others: tuple[int, ...]) -> np.ndarray:
    """:func:`common_region_area` of many pairs at once: points (n, k, 2) of polygons whose rings have these sizes.

    All pairs have slabs for all edges that might cross; those of no height count nothing.
    """
    a, b, c, d = r, r[:, _followed(rings)], s, s[:, _followed(others)]
    low, high = np.maximum(a[..., 1].min(1), c[..., 1].min(1)), np.minimum(a[..., 1].max(1), c[..., 1].max(1))
    apart = (low >= high) | (np.maximum(a[..., 0].min(1), c[..., 0].min(1)) >= np.minimum(a[..., 0].max(1), c[..., 0].max(1)))
    u, v, w = (b - a)[:, :, None], (d - c)[:, None], c[:, None] - a[:, :, None]
    den = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    ok = den != 0
    t = np.where(ok, (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / np.where(ok, den, 1), -1)
    k = np.where(ok, (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / np.where(ok, den, 1), -1)
    hit = ok & (t >= 0) & (t <= 1) & (k >= 0) & (k <= 1)
    crossing = np.where(hit, a[:, :, None, 1] + t * u[..., 1], low[:, None, None]).reshape(len(r), -1)
    y = np.sort(np.clip(np.concatenate([a[..., 1], c[..., 1], crossing], axis=1), low[:, None], np.maximum(low, high)[:, None]), axis=1)
    tall = np.diff(y, axis=1)
    row, slab = np.nonzero(tall > 0)
    mid = ((y[:, :-1] + y[:, 1:]) / 2)[row, slab][:, None]
    spans = []
    for p, q in ((a[row], b[row]), (c[row], d[row])):
        on = (p[..., 1] > mid) != (q[..., 1] > mid)
        x = p[..., 0] + (mid - p[..., 1]) * (q[..., 0] - p[..., 0]) / np.where(on, q[..., 1] - p[..., 1], 1)
        x = np.sort(np.where(on, x, np.inf), axis=1)[:, : 2 * (x.shape[1] // 2)]
        spans.append(x.reshape(len(x), -1, 2))
    first, second = spans
    right, left = np.minimum(first[:, :, None, 1], second[:, None, :, 1]), np.maximum(first[:, :, None, 0], second[:, None, :, 0])
    common = np.where(left < right, right - np.where(left < right, left, 0), 0).sum(axis=(1, 2))
    total = np.bincount(row, common * tall[row, slab], len(r))
    return np.where(apart, 0.0, total)


def iou(r: Ring, s: Ring) -> float:
    both = intersection_area(r, s)
    either = abs(ring_area(r)) + abs(ring_area(s)) - both
    return both / either if either > 0 else 0.0


def shared_length(r: Ring, s: Ring, tolerance: float = 0.0) -> float:
    """Length of the boundary that two polygons share: parallel edges within the tolerance, where they overlap."""
    total = 0.0
    one, two = as_box(r), as_box(s)
    if one and two:
        for k in (0, 1):
            reach = max(tolerance, 1e-9 * (one[3 - k] - one[1 - k]))
            common = max(0.0, min(one[3 - k], two[3 - k]) - max(one[1 - k], two[1 - k]))
            total += common * sum(abs(one[i] - two[j]) <= reach for i in (k, k + 2) for j in (k, k + 2))
        return total
    (a, b), (c, d) = edges(r), edges(s)
    for p, q in zip(a, b, strict=True):
        v = q - p
        n = math.hypot(*v)
        if n == 0:
            continue
        u = v / n
        for e, f in zip(c, d, strict=True):
            off = np.array([u[0] * (z[1] - p[1]) - u[1] * (z[0] - p[0]) for z in (e, f)])
            if np.abs(off).max() > max(tolerance, 1e-9 * n):
                continue
            t = sorted(float((z - p) @ u) for z in (e, f))
            total += max(0.0, min(n, t[1]) - max(0.0, t[0]))
    return total


def shared_lengths(r: np.ndarray, s: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """:func:`shared_length` of many pairs at once; rings of a side have equally many points (n, k, 2)."""
    (one, a0, a1), (two, b0, b1) = boxes(r), boxes(s)
    out = np.zeros(len(r))
    for k in (0, 1):
        reach = np.maximum(tolerance, 1e-9 * (a1[:, 1 - k] - a0[:, 1 - k]))
        common = np.maximum(np.minimum(a1[:, 1 - k], b1[:, 1 - k]) - np.maximum(a0[:, 1 - k], b0[:, 1 - k]), 0)
        out += common * sum((np.abs(x[:, k] - y[:, k]) <= reach).astype(int) for x in (a0, a1) for y in (b0, b1))
    rest = np.flatnonzero(~(one & two))
    if not len(rest):
        return out
    p, c = r[rest], s[rest]
    v, d = np.roll(p, -1, axis=1) - p, np.roll(c, -1, axis=1)
    n = np.hypot(v[..., 0], v[..., 1])
    u = v / np.where(n == 0, 1.0, n)[..., None]
    # Of each side of the first ring and each side of the second: how far off its line the ends are, and where along it.
    to = [z[:, None] - p[:, :, None] for z in (c, d)]
    off = np.maximum(*(np.abs(u[..., None, 0] * z[..., 1] - u[..., None, 1] * z[..., 0]) for z in to))
    at = [z[..., 0] * u[..., None, 0] + z[..., 1] * u[..., None, 1] for z in to]
    common = np.maximum(np.minimum(n[..., None], np.maximum(*at)) - np.maximum(np.minimum(*at), 0), 0)
    out[rest] = np.where((off <= np.maximum(tolerance, 1e-9 * n)[..., None]) & (n > 0)[..., None], common, 0.0).sum(axis=(1, 2))
    return out


def hull(p: np.ndarray) -> Ring:
    """Convex hull, counter-clockwise, without collinear points."""
    pts = sorted({(float(x), float(y)) for x, y in p})
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def min_rectangle(p: np.ndarray) -> tuple[float, float, float]:
    """(area, long side, short side) of the smallest rectangle, at any angle, around the points."""
    if box := as_box(p):
        w, v = box[2] - box[0], box[3] - box[1]
        return w * v, max(w, v), min(w, v)
    h = hull(p)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    if len(h) == 2:
        return 0.0, math.dist(*h), 0.0
    best = (math.inf, 0.0, 0.0)
    for a, b in zip(*edges(h), strict=True):
        u = (b - a) / math.dist(a, b)
        along, across = h @ u, h @ np.array([-u[1], u[0]])
        w, v = float(np.ptp(along)), float(np.ptp(across))
        if w * v < best[0]:
            best = (w * v, max(w, v), min(w, v))
    return best


def solidity(r: Ring) -> float:
    full = abs(ring_area(hull(r))) if len(r) > 2 else 0.0
    return abs(ring_area(r)) / full if full else 0.0


def inscribed_radius(r: Ring, precision: float = 1.0) -> tuple[float, float, float]:
    """Centre and radius of the largest inscribed circle, by best-first refinement of square cells."""
    low, high = r.min(0), r.max(0)
    size = float(min(high - low))
    if size <= 0:
        return float(low[0]), float(low[1]), 0.0

    def signed(x: float, y: float) -> float:
        p = np.array([[x, y]])
        d = float(boundary_distance(r, p)[0])
        return d if inside(r, p)[0] else -d

    half, queue, best = size / 2, [], (-math.inf, 0.0, 0.0)

    def push(x: float, y: float, h: float) -> None:
        nonlocal best
        d = signed(x, y)
        best = max(best, (d, x, y))
        heapq.heappush(queue, (-(d + h * math.sqrt(2)), x, y, h))

    for x in np.arange(low[0] + half, high[0] + half, size):
        for y in np.arange(low[1] + half, high[1] + half, size):
            push(float(x), float(y), half)
    while queue:
        top, x, y, h = heapq.heappop(queue)
        if -top - best[0] <= precision:
            break
        for dx in (-h / 2, h / 2):
            for dy in (-h / 2, h / 2):
                push(x + dx, y + dy, h / 2)
    return best[1], best[2], max(best[0], 0.0)


def survives_inset(r: Ring | list[Ring], d: float, precision: float = 2.0) -> bool:
    """Whether more than a point is left of the polygon when it is shrunk by d (to within the precision).

    Square cells are refined level by level, all at once, as long as they may hold a point deeper than d.
    Holes shrink it from within.
    """
    r = r[0] if isinstance(r, list) and len(r) == 1 else r
    points = edges(r)[0]
    low, high = points.min(0), points.max(0)
    size = float(min(high - low))
    if size <= 2 * d or not isinstance(r, list) and as_box(r):
        return size > 2 * d
    gx, gy = np.meshgrid(np.arange(low[0] + size / 2, high[0] + size / 2, size), np.arange(low[1] + size / 2, high[1] + size / 2, size))
    cells, half = np.stack([gx.ravel(), gy.ravel()], 1), size / 2
    while len(cells):
        depth = np.concatenate([np.where(inside(r, c), 1.0, -1.0) * boundary_distance(r, c) for c in np.array_split(cells, -(-len(cells) // 4096))])
        if (depth > d).any():
            return True
        cells = cells[depth + half * math.sqrt(2) > d + precision]
        half /= 2
        cells = np.concatenate([cells + half * np.array(s) for s in ((-1, -1), (-1, 1), (1, -1), (1, 1))]) if len(cells) else cells
    return False


def clear_width(r: Ring) -> float:
    """Least distance of two edges that do not touch; of shapes of fewer than four points, the short side."""
    n = len(r)
    if n < 4 or as_box(r):
        return min_rectangle(r)[2]
    a, b = edges(r)
    i, j = np.triu_indices(n, 2)
    ok = ~((i == 0) & (j == n - 1))
    i, j = i[ok], j[ok]
    return float(segment_distance(a[i], b[i], a[j], b[j]).min()) if len(i) else 0.0


def clear_widths(r: np.ndarray) -> np.ndarray:
    """:func:`clear_width` of many rings with equally many points (n, k, 2)."""
    one, low, high = boxes(r)
    out = (high - low).min(axis=1)
    rest = np.flatnonzero(~one)
    n = r.shape[1]
    if n < 4:
        out[rest] = [min_rectangle(x)[2] for x in r[rest]]
    elif len(rest):
        a, b = r[rest], np.roll(r[rest], -1, axis=1)
        i, j = np.triu_indices(n, 2)
        ok = ~((i == 0) & (j == n - 1))
        i, j = i[ok], j[ok]
        out[rest] = segment_distance(a[:, i], b[:, i], a[:, j], b[:, j]).min(axis=1)
    return out


def min_rectangles(r: np.ndarray) -> np.ndarray:
    """:func:`min_rectangle` of many rings with equally many points (n, k, 2): (n, 3)."""
    one, low, high = boxes(r)
    side = high - low
    out = np.column_stack([side.prod(axis=1), side.max(axis=1), side.min(axis=1)])
    for i in np.flatnonzero(~one):
        out[i] = min_rectangle(r[i])
    return out


def reflex(r: Ring) -> np.ndarray:
    """Indices of the concave vertices of a counter-clockwise ring."""
    u, v = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
    return np.flatnonzero(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] < -1e-4)


Points = list[tuple[float, float]]


def _area(r: Points) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)) / 2


def _oriented(r: Points) -> Points:
    """:func:`oriented` of a list: rings of a few points are cut faster without arrays."""
    if len(r) > 1:
        r = [p for i, p in enumerate(r) if p != r[i - 1]]
    return r[::-1] if len(r) > 2 and _area(r) < 0 else r


def _reflex(r: Points) -> list[int]:
    """Indices of the concave vertices of a counter-clockwise ring."""
    out = []
    for i, (x, y) in enumerate(r):
        (a, b), (c, d) = r[i - 1], r[(i + 1) % len(r)]
        if (x - a) * (d - y) - (y - b) * (c - x) < -1e-4:
            out.append(i)
    return out


def ray_hit(r: Points, p: tuple[float, float], u: tuple[float, float], least: float = 1e-4) -> tuple[float, float] | None:
    """Where the ray from p along the unit vector u first meets the boundary, further than ``least``."""
    best = math.inf
    for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
        vx, vy, wx, wy = bx - ax, by - ay, ax - p[0], ay - p[1]
        den = u[0] * vy - u[1] * vx
        if abs(den) > 1e-12:
            t = (wx * vy - wy * vx) / den
            if least < t < best and -1e-9 <= (wx * u[1] - wy * u[0]) / den <= 1 + 1e-9:
                best = t
    return (p[0] + best * u[0], p[1] + best * u[1]) if math.isfinite(best) else None


def _holds(r: Points, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def split(r: Points, p: tuple[float, float], q: tuple[float, float]) -> list[Points]:
    """The parts of a simple polygon on both sides of the chord through p and q, which end on its boundary."""
    r = _oriented(r)
    points, marks = [], []
    for a, b in zip(r, r[1:] + r[:1], strict=True):
        points.append(a)
        vx, vy = b[0] - a[0], b[1] - a[1]
        n2 = vx * vx + vy * vy
        found = []
        for z in (p, q):
            t = ((z[0] - a[0]) * vx + (z[1] - a[1]) * vy) / n2 if n2 else 0.0
            if 1e-9 < t < 1 - 1e-9 and math.hypot(a[0] + t * vx - z[0], a[1] + t * vy - z[1]) < 1e-6 * max(1.0, math.sqrt(n2)):
                found.append((t, z))
        points += [z for _, z in sorted(found, key=lambda x: x[0])]
    for z in (p, q):
        d = [math.dist(x, z) for x in points]
        i = min(range(len(d)), key=d.__getitem__)
        if d[i] > 1e-3:
            return [r]
        marks.append(i)
    i, j = sorted(marks)
    parts = [points[i : j + 1], points[j:] + points[: i + 1]]
    return [x for x in parts if len(x) > 2 and abs(_area(x)) > 1e-2]


def half_plane(r: Ring, axis: int, at: float, keep_low: bool) -> Ring:
    """A convex ring cut by the line x = at or y = at."""
    out = []
    side = (r[:, axis] - at) * (1 if keep_low else -1)
    for k in range(len(r)):
        a, b, s, t = r[k], r[(k + 1) % len(r)], side[k], side[(k + 1) % len(r)]
        if s <= 0:
            out.append(a)
        if (s < 0 < t) or (t < 0 < s):
            out.append(a + (b - a) * (s / (s - t)))
    return np.array(out).reshape(-1, 2)


def best_cut(r: Points) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """The shortest extension of an edge at a concave vertex to the boundary, within the polygon."""
    best = None
    for i in _reflex(r):
        p = r[i]
        for q in (r[i - 1], r[(i + 1) % len(r)]):
            ux, uy = p[0] - q[0], p[1] - q[1]
            n = math.hypot(ux, uy)
            if n == 0:
                continue
            hit = ray_hit(r, p, (ux / n, uy / n))
            if hit is None or not _holds(r, (p[0] + hit[0]) / 2, (p[1] + hit[1]) / 2):
                continue
            d = math.dist(p, hit)
            if best is None or d < best[0]:
                best = (d, p, hit)
    return best[1:] if best else None


def convex_parts(r: Ring, anchors: np.ndarray | None = None) -> list[Ring]:
    """Recursive decomposition of a polygon into convex parts.

    A convex polygon with exactly two anchors is cut halfway between them, across the longer axis.
    """
    points = _oriented([tuple(p) for p in np.asarray(r, float).tolist()])
    if not _reflex(points):
        r = np.array(points, float).reshape(-1, 2)
        if anchors is not None and len(anchors) == 2:
            d = np.abs(anchors[0] - anchors[1])
            axis = 0 if d[0] > d[1] else 1
            at = float(anchors[:, axis].mean())
            parts = [half_plane(r, axis, at, low) for low in (True, False)]
            parts = [x for x in parts if len(x) > 2 and abs(ring_area(x)) > 1e-2]
            if len(parts) == 2:
                return parts
        return [r]
    todo, done = [points], []
    while todo:
        x = _oriented(todo.pop())
        cut = best_cut(x)
        parts = split(x, *cut) if cut else [x]
        if len(parts) < 2:
            done.append(x)
        else:
            todo += parts[::-1]
    return [np.array(x, float).reshape(-1, 2) for x in done]


# --------------------------------------------------------- planar lines


def _share(n: int, d: int) -> int | Fraction:
    whole, rest = divmod(n, d)
    return Fraction(n, d) if rest else whole


def node_lines(segments: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[tuple[tuple[int | Fraction, int | Fraction], tuple[int | Fraction, int | Fraction]]]:
    """Segments cut at all their meeting points, overlaps merged, collinear chains joined.

    Exact rational arithmetic on integer coordinates; whole numbers stay integers, which are much faster.
    """
    lines: dict[tuple, list[tuple[tuple, tuple]]] = {}
    for p, q in segments:
        if p == q:
            continue
        dx, dy = q[0] - p[0], q[1] - p[1]
        g = math.gcd(dx, dy)
        dx, dy = dx // g, dy // g
        if dx < 0 or dx == 0 and dy < 0:
            dx, dy = -dx, -dy
        lines.setdefault((dx, dy, p[0] * dy - p[1] * dx), []).append((min(p, q), max(p, q)))
    merged = []
    for parts in lines.values():
        parts.sort()
        low, high = parts[0]
        for a, b in parts[1:]:
            if a <= high:
                high = max(high, b)
            else:
                merged.append((low, high))
                low, high = a, b
        merged.append((low, high))
    merged.sort()
    cuts: list[set] = [{a, b} for a, b in merged]
    lefts = [a[0] for a, _ in merged]
    spans = [(a[1], b[1]) if a[1] <= b[1] else (b[1], a[1]) for a, b in merged]
    for i, (a, b) in enumerate(merged):
        bottom, top = spans[i]
        # lines come by their left ends: none further on reaches back
        for j, (low, high) in enumerate(spans[i + 1 : bisect_right(lefts, b[0])], i + 1):
            if bottom > high or top < low:
                continue
            c, d = merged[j]
            u, v, w = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
            den = u[0] * v[1] - u[1] * v[0]
            if den == 0:
                for z in (c, d):
                    if min(a, b) <= z <= max(a, b) and (z[0] - a[0]) * u[1] == (z[1] - a[1]) * u[0]:
                        cuts[i].add(z)
                continue
            t, k = w[0] * v[1] - w[1] * v[0], w[0] * u[1] - w[1] * u[0]
            if den < 0:
                t, k, den = -t, -k, -den
            if 0 <= t <= den and 0 <= k <= den:
                z = (a[0] + _share(t * u[0], den), a[1] + _share(t * u[1], den))
                cuts[i].add(z)
                cuts[j].add(z)
    out = set()
    for points in cuts:
        at = sorted(points)
        out |= set(zip(at[:-1], at[1:], strict=True))
    degree: dict[tuple, list] = {}
    for s in out:
        for z in s:
            degree.setdefault(z, []).append(s)
    changed = True
    while changed:
        changed = False
        for z in list(degree):
            touching = degree[z]
            if len(touching) != 2:
                continue
            (a, b), (c, d) = touching
            p, q = (a if b == z else b), (c if d == z else d)
            if p != q and (z[0] - p[0]) * (q[1] - p[1]) == (z[1] - p[1]) * (q[0] - p[0]) and (p < z < q or q < z < p):
                new = (min(p, q), max(p, q))
                out -= {touching[0], touching[1]}
                out.add(new)
                for e, old in ((p, touching[0]), (q, touching[1])):
                    degree[e] = [new if s == old else s for s in degree[e]]
                del degree[z]
                changed = True
    return sorted(out)


def circumcircle(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float] | None:
    d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    if d == 0:
        return None
    sq = [p[0] ** 2 + p[1] ** 2 for p in (a, b, c)]
    x = (sq[0] * (b[1] - c[1]) + sq[1] * (c[1] - a[1]) + sq[2] * (a[1] - b[1])) / d
    y = (sq[0] * (c[0] - b[0]) + sq[1] * (a[0] - c[0]) + sq[2] * (b[0] - a[0])) / d
    return x, y, math.hypot(a[0] - x, a[1] - y)


def inscribed_square(r: Ring, tolerance: float = 10.0, step: float = 2.0, grid: int = 25) -> tuple[float, float, float]:
    """(side, angle in degrees, area) of the largest square found inside: centres on a grid and the
    inscribed circle's, angles in steps, side by bisection."""
    low, high = r.min(0), r.max(0)
    gx, gy = np.meshgrid(*(np.linspace(low[k], high[k], grid) for k in (0, 1)))
    centres = np.concatenate([np.stack([gx.ravel(), gy.ravel()], 1), np.array([inscribed_radius(r)[:2]])])
    centres = centres[inside(r, centres)]
    if not len(centres):
        return 0.0, 0.0, 0.0
    best_side, best_angle = 0.0, 0.0
    a, b = edges(r)

    def fits(c: np.ndarray, side: float, u: np.ndarray) -> bool:
        v = np.array([-u[1], u[0]])
        h = side / 2 - 1e-9
        corners = np.array([c + h * (sx * u + sy * v) for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
        if not inside(r, corners).all():
            return False
        d = segment_distance(corners[:, None], np.roll(corners, -1, axis=0)[:, None], a[None], b[None])
        return bool((d > 0).all())

    for c in centres:
        for angle in np.arange(0.0, 90.0, step):
            u = np.array([math.cos(math.radians(angle)), math.sin(math.radians(angle))])
            if not fits(c, best_side + tolerance, u):
                continue
            lo, hi = best_side + tolerance, float(np.hypot(*(high - low)))
            while hi - lo > tolerance:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if fits(c, mid, u) else (lo, mid)
            best_side, best_angle = lo, float(angle)
    return best_side, best_angle, best_side**2


def longest_chord(door: Ring, r: Ring, margin: float = 0.1) -> tuple[float, np.ndarray, np.ndarray]:
    """The longest stretch of the boundary of r within the axis-parallel box of the door grown by the margin."""
    low, high = door.min(0) - margin, door.max(0) + margin
    best = (0.0, low, low)
    for p, q in zip(*edges(r), strict=True):
        v, t0, t1 = q - p, 0.0, 1.0
        for k in (0, 1):
            if v[k] == 0:
                if not low[k] <= p[k] <= high[k]:
                    t0, t1 = 1.0, 0.0
                continue
            s = sorted(((low[k] - p[k]) / v[k], (high[k] - p[k]) / v[k]))
            t0, t1 = max(t0, s[0]), min(t1, s[1])
        if t0 < t1:
            n = (t1 - t0) * math.hypot(*v)
            if n > best[0]:
                best = (n, p + t0 * v, p + t1 * v)
    return best


def longest_chords(door: np.ndarray, r: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`longest_chord` of many pairs at once; rings of a side have equally many points (n, k, 2)."""
    low, high = (door.min(axis=1) - margin)[:, None], (door.max(axis=1) + margin)[:, None]
    v = np.roll(r, -1, axis=1) - r
    t0, t1 = np.zeros(v.shape[:2]), np.ones(v.shape[:2])
    for k in (0, 1):
        flat = v[..., k] == 0
        out = flat & ~((low[..., k] <= r[..., k]) & (r[..., k] <= high[..., k]))
        step = np.where(flat, 1.0, v[..., k])
        x, y = (low[..., k] - r[..., k]) / step, (high[..., k] - r[..., k]) / step
        t0 = np.where(flat, np.where(out, 1.0, t0), np.maximum(t0, np.minimum(x, y)))
        t1 = np.where(flat, np.where(out, 0.0, t1), np.minimum(t1, np.maximum(x, y)))
    length = np.where(t0 < t1, (t1 - t0) * np.hypot(v[..., 0], v[..., 1]), 0.0)
    row, best = np.arange(len(r)), length.argmax(axis=1)
    p, u = r[row, best], v[row, best]
    length = length[row, best]
    first, last = p + t0[row, best][:, None] * u, p + t1[row, best][:, None] * u
    none = length == 0
    first[none] = last[none] = low[none, 0]
    return length, first, last
