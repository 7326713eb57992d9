"""Polygons with holes and of several parts, as Column expressions.

A polygon is an array of parts, each an outer ring and an array of holes (rings as in ``geometry``).
Holes lie within their part's outer ring, parts do not overlap. Everything here stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

PART = f"struct<outer:{G.RING},holes:array<{G.RING}>>"
PARTS = f"array<{PART}>"


def part(outer: Column, holes: Column | None = None) -> Column:
    none = F.array().cast(f"array<{G.RING}>")
    return F.struct(outer.alias("outer"), (none if holes is None else F.coalesce(holes, none)).alias("holes"))


def parts(outer: Column, holes: Column | None = None) -> Column:
    """A polygon of one part."""
    return F.array(part(outer, holes))


def rings(polygon: Column) -> Column:
    """All rings, outer ones and holes."""
    return F.flatten(F.transform(polygon, lambda p: F.concat(F.array(p["outer"]), p["holes"])))


def holes(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, lambda p: p["holes"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def area(polygon: Column) -> Column:
    """Of the outer rings, less that of the holes."""
    return _sum(F.transform(polygon, lambda p: G.area(p["outer"]) - _sum(F.transform(p["holes"], G.area))))


def perimeter(polygon: Column) -> Column:
    """Length of the whole boundary, that of the holes included."""
    return _sum(F.transform(rings(polygon), G.perimeter))


def bounds(polygon: Column) -> Column:
    return G.bounds(F.flatten(F.transform(polygon, lambda p: p["outer"])))


def centroid(polygon: Column) -> Column:
    """Centre of mass: holes count against it. Of a polygon without area, the mean of all its points."""

    def weighed(ring: Column, sign: int) -> Column:
        c, a = G.centroid(ring), sign * G.area(ring)
        return F.struct(a.alias("a"), (a * c["x"]).alias("x"), (a * c["y"]).alias("y"))

    pieces = F.concat(F.transform(polygon, lambda p: weighed(p["outer"], 1)), F.transform(holes(polygon), lambda h: weighed(h, -1)))
    total = _sum(F.transform(pieces, lambda w: w["a"]))
    points = F.flatten(rings(polygon))
    mean = lambda k: F.try_divide(_sum(F.transform(points, lambda p: p[k])), F.size(points).cast("double"))
    mass = lambda k: F.try_divide(_sum(F.transform(pieces, lambda w: w[k])), total)
    return F.when(total > 0, G.point(mass("x"), mass("y"))).otherwise(G.point(mean("x"), mean("y")))


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a point on the boundary, that of a hole included, is not."""
    in_hole = lambda h: G.contains(h, x, y) | G.on_boundary(h, x, y)
    return F.exists(polygon, lambda p: G.contains(p["outer"], x, y) & ~F.exists(p["holes"], in_hole))


def distance_to(polygon: Column, x: Column, y: Column) -> Column:
    """Distance of a point, 0 inside; in a hole, that to its edge."""
    edge = F.array_min(F.transform(rings(polygon), lambda r: F.array_min(F.transform(G.segments(r), lambda s: G.distance_to_segment(s["p"], s["q"], x, y)))))
    return F.when(contains(polygon, x, y), F.lit(0.0)).otherwise(edge)


def largest(polygon: Column) -> Column:
    """The part of largest area, the first among equals."""
    sized = F.transform(polygon, lambda p, i: F.struct((G.area(p["outer"]) - _sum(F.transform(p["holes"], G.area))).alias("a"), (-i).alias("i")))
    return F.get(polygon, -F.array_max(sized)["i"])


def to_wkt(polygon: Column) -> Column:
    """POLYGON ((...), (...)) or MULTIPOLYGON (((...)), ((...))); first points are repeated, whole coordinates are integers."""
    number = lambda v: F.when(v == F.rint(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ", "), F.lit(")"))
    each = F.transform(polygon, lambda p: F.concat(F.lit("("), F.array_join(F.transform(F.concat(F.array(p["outer"]), p["holes"]), ring), ", "), F.lit(")")))
    several = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(each, ", "), F.lit(")"))
    return F.when(F.size(polygon) == 0, "POLYGON EMPTY").when(F.size(polygon) == 1, F.concat(F.lit("POLYGON "), F.get(each, F.lit(0)))).when(F.size(polygon) > 1, several)


def from_wkt(text: Column) -> Column:
    """All parts and holes of a POLYGON or MULTIPOLYGON text, further coordinates than x and y left out.

    An empty one has no parts; anything else, and a text with a coordinate that is no number, is null.
    """
    whole = F.regexp_extract(text, r"(?is)^\s*(?:SRID=\d+;\s*|<[^>]*>\s*)?(?:MULTI)?POLYGON\s*(?:ZM?|M)?\s*(\(.*\)|EMPTY)\s*$", 1)

    def opened(ring: Column) -> Column:
        closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
        return F.when(closed, F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)

    def read_ring(s: Column) -> Column:
        points = F.transform(F.split(s, ","), lambda c: F.split(F.trim(c), r"\s+"))
        return G.once(F.transform(points, lambda v: G.point(F.get(v, F.lit(0)).try_cast("double"), F.get(v, F.lit(1)).try_cast("double"))), opened)

    def read_part(s: Column) -> Column:
        found = F.transform(F.split(s, r"\)\s*,\s*\("), read_ring)
        return G.once(found, lambda r: F.struct(F.get(r, F.lit(0)).alias("outer"), F.slice(r, F.lit(2), F.size(r)).alias("holes")))

    def read(body: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(body, r"^[\s(]+", ""), r"[\s)]+$", "")
        found = F.transform(F.split(bare, r"\)\s*\)\s*,\s*\(\s*\("), read_part)
        sound = lambda f: F.coalesce(~F.exists(rings(f), lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull())), F.lit(False))
        return F.when(F.upper(body) == "EMPTY", F.array().cast(PARTS)).when(body != "", G.once(found, lambda f: F.when(sound(f), f)))

    return G.once(whole, read)
