"""Geometry as Column expressions over rings and polylines (array<struct<x:double,y:double>>).

A ring is closed implicitly: its first point is not repeated. Everything here stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise ring of an axis-parallel rectangle."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it.

    Spark works out anew what a lambda function names twice, and once an item what it takes from outside.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _turn(ring: Column, step: int) -> Column:
    """The ring, beginning at its second (step 1) or last (step -1) point."""
    n = F.size(ring)
    if step == 1:
        return F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _edges(ring: Column, value: Callable[[Column, Column], Column]) -> Column:
    """A value of every edge (p, q) of the ring."""
    return F.zip_with(ring, _turn(ring, 1), value)


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def perimeter(ring: Column) -> Column:
    return _sum(_edges(ring, distance))


def length(line: Column) -> Column:
    """Length of an open polyline."""
    n = F.size(line)
    heads, tails = F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return _sum(F.zip_with(heads, tails, distance))


def bounds(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>"""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def as_box(ring: Column) -> Column:
    """:func:`bounds` of a ring that is an axis-parallel rectangle, as most rooms are; else null."""
    x, y = ([F.get(ring, F.lit(i))[c] for i in range(4)] for c in "xy")
    same = lambda z, i, j: z[i] == z[j]
    flat = same(y, 0, 1) & same(x, 1, 2) & same(y, 2, 3) & same(x, 3, 0)
    tall = same(x, 0, 1) & same(y, 1, 2) & same(x, 2, 3) & same(y, 3, 0)
    box = F.struct(F.least(x[0], x[2]).alias("x0"), F.least(y[0], y[2]).alias("y0"), F.greatest(x[0], x[2]).alias("x1"), F.greatest(y[0], y[2]).alias("y1"))
    return F.when((F.size(ring) == 4) & (flat | tall), box)


def centroid(ring: Column) -> Column:
    """Centre of mass of a polygon; of a degenerate one, the mean of its points."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    twice = _sum(_edges(ring, cross))
    cx = _sum(_edges(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
    cy = _sum(_edges(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
    n = F.size(ring)
    flat = point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)
    return F.when(twice != 0, point(F.try_divide(cx, 3 * twice), F.try_divide(cy, 3 * twice))).otherwise(flat)


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    def hit(p: Column, q: Column) -> Column:
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        inside = (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
        return (cross == 0) & inside

    return F.exists(_edges(ring, hit), lambda b: b)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a point on the boundary is not."""

    def crosses(p: Column, q: Column) -> Column:
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    odd = F.aggregate(_edges(ring, crosses), F.lit(False), lambda a, b: a != F.coalesce(b, F.lit(False)))
    return odd & ~on_boundary(ring, x, y)


def distance_to_segment(p: Column, q: Column, x: Column, y: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (p["x"] + t * dx), y - (p["y"] + t * dy))


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon, 0 inside."""
    edge = F.array_min(_edges(ring, lambda p, q: distance_to_segment(p, q, x, y)))
    return F.when(contains(ring, x, y), F.lit(0.0)).otherwise(edge)


def concave_points(ring: Column) -> Column:
    """Vertices with a reflex angle, whatever the orientation."""
    turned = F.zip_with(_turn(ring, -1), F.arrays_zip(ring.alias("b"), _turn(ring, 1).alias("c")), lambda a, z: F.struct(a.alias("a"), z["b"].alias("b"), z["c"].alias("c")))

    def reflex(t: Column, side: Column) -> Column:
        a, b, c = t["a"], t["b"], t["c"]
        cross = (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
        return cross * side < -1e-4

    return once(F.signum(signed_area(ring)), lambda side: F.transform(F.filter(turned, lambda t: reflex(t, side)), lambda t: t["b"]))


def without_repeats(ring: Column) -> Column:
    """The ring without corners that equal the next one."""
    pairs = _edges(ring, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.transform(F.filter(pairs, lambda e: e["p"] != e["q"]), lambda e: e["p"])


def is_simple(ring: Column) -> Column:
    """Whether a ring bounds one area: three corners or more, no sides that meet but neighbours, none that folds back."""
    n = F.size(ring)
    sides = F.transform(_edges(ring, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda e, i: F.struct(i.alias("i"), e["p"].alias("p"), e["q"].alias("q")))
    cross = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    apart = lambda s, t, k: (F.greatest(s["p"][k], s["q"][k]) < F.least(t["p"][k], t["q"][k])) | (F.greatest(t["p"][k], t["q"][k]) < F.least(s["p"][k], s["q"][k]))

    def bad(s: Column, t: Column) -> Column:
        a, b, c, d = s["p"], s["q"], t["p"], t["q"]
        beside = (t["i"] == s["i"] + 1) | ((s["i"] == 0) & (t["i"] == n - 1))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
        folds = (ux * vy == uy * vx) & (ux * vx + uy * vy < 0)
        meets = ~apart(s, t, "x") & ~apart(s, t, "y") & (cross(a, b, c) * cross(a, b, d) <= 0) & (cross(c, d, a) * cross(c, d, b) <= 0)
        return (t["i"] > s["i"]) & F.when(beside, folds).otherwise(meets)

    return (n >= 3) & ~once(sides, lambda all_sides: F.exists(all_sides, lambda s: F.exists(all_sides, lambda t: bad(s, t))))


def compactness(ring: Column) -> Column:
    return F.coalesce(F.try_divide(4 * F.pi() * area(ring), F.pow(perimeter(ring), 2)), F.lit(0.0))


# ------------------------------------------------- coordinates and shapes


def svg_to_world(line: Column, scale: Column, height: float = 140.0) -> Column:
    """SVG units (y down, a box of this height) to millimetres (y up)."""
    return F.transform(line, lambda p: point(p["x"] / scale, (height - p["y"]) / scale))


def world_to_svg(line: Column, scale: Column, height: float = 140.0) -> Column:
    return F.transform(line, lambda p: point(p["x"] * scale, height - p["y"] * scale))


def affine(line: Column, m: Column) -> Column:
    """Applies struct<a,b,c,d,e,f> as in SVG: x' = a x + c y + e, y' = b x + d y + f."""
    return once(m, lambda m: F.transform(line, lambda p: point(m["a"] * p["x"] + m["c"] * p["y"] + m["e"], m["b"] * p["x"] + m["d"] * p["y"] + m["f"])))


def drop_close(line: Column, tolerance: float = 1e-4) -> Column:
    """Drops points that are within the tolerance, in both coordinates, of the last one kept."""

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.abs(last["x"] - p["x"]) <= tolerance) & (F.abs(last["y"] - p["y"]) <= tolerance)
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(line, F.array().cast(RING), step)


def snap(line: Column) -> Column:
    """Coordinates rounded half-even to integers, without equal neighbours."""
    rounded = F.transform(line, lambda p: point(F.rint(p["x"]), F.rint(p["y"])))
    return F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))


def segments(ring: Column) -> Column:
    """The two-point segments of a closed ring: array<struct<p, q>>."""
    return _edges(ring, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def circle_points(cx: Column, cy: Column, rx: Column, ry: Column, n: int = 20) -> Column:
    """n samples of an ellipse from angle 0 to 2 pi, both ends included."""
    step = 2 * 3.141592653589793 / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(cx + rx * F.cos(i * step), cy + ry * F.sin(i * step)))


def path_points(d: Column) -> Column:
    """Points of an SVG path of absolute M, L and Z commands, each subpath's end joined to its start by Z."""
    pairs = F.regexp_extract_all(d, F.lit(r"(-?[0-9.]+(?:[eE][-+]?\d+)?)[ ,]+(-?[0-9.]+(?:[eE][-+]?\d+)?)"), F.lit(0))
    points = F.transform(F.transform(pairs, lambda s: F.split(s, "[ ,]+")), lambda v: point(F.element_at(v, 1), F.element_at(v, 2)))
    return once(points, lambda p: F.when(d.rlike(r"[zZ]\s*$"), F.concat(p, F.slice(p, 1, 1))).otherwise(p))


def _matrix(*six: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in zip(six, "abcdef", strict=True)))


def transform_matrix(text: Column) -> Column:
    """The product, in the order of the text, of an SVG transform attribute's matrix, translate, scale and rotate."""
    calls = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:matrix|translate|scale|rotate)\s*\([^)]*\)"), F.lit(0))

    def one(call: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(call, F.lit(r"-?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0)), lambda s: s.cast("double"))
        return once(numbers, lambda v: once(F.regexp_extract(call, r"^(\w+)", 1), lambda kind: matrix(kind, v)))

    def matrix(kind: Column, v: Column) -> Column:
        get = lambda i, default: F.coalesce(F.get(v, F.lit(i)), default)
        zero, unit = F.lit(0.0), F.lit(1.0)
        angle, cx, cy = F.radians(get(0, zero)), get(1, zero), get(2, zero)
        c, s = F.cos(angle), F.sin(angle)
        return (
            F.when(kind == "matrix", _matrix(*(get(i, unit if i in (0, 3) else zero) for i in range(6))))
            .when(kind == "translate", _matrix(unit, zero, zero, unit, get(0, zero), get(1, zero)))
            .when(kind == "scale", _matrix(get(0, unit), zero, zero, get(1, get(0, unit)), zero, zero))
            .otherwise(_matrix(c, s, -s, c, cx - c * cx + s * cy, cy - s * cx - c * cy))
        )

    def times(m: Column, n: Column) -> Column:
        return _matrix(
            m["a"] * n["a"] + m["c"] * n["b"],
            m["b"] * n["a"] + m["d"] * n["b"],
            m["a"] * n["c"] + m["c"] * n["d"],
            m["b"] * n["c"] + m["d"] * n["d"],
            m["a"] * n["e"] + m["c"] * n["f"] + m["e"],
            m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
        )

    unit = _matrix(*(F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))
    return F.aggregate(F.transform(calls, one), unit, times)


def to_wkt(ring: Column) -> Column:
    """POLYGON ((x y, ...)) with the first point repeated; whole coordinates are written as integers."""
    number = lambda v: F.when(v == F.rint(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ", "), F.lit("))"))


def svg_path(ring: Column, scale: Column, height: float = 140.0) -> Column:
    """M x,y L ... Z of a ring, in SVG units."""
    drawn = F.transform(world_to_svg(ring, scale, height), lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"]))
    return F.concat(F.lit("M "), F.array_join(drawn, " L "), F.lit(" Z"))
