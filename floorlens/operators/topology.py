"""Who touches whom: rooms, doors, windows, furniture and texts of a drawing.

Rooms: drawing_id, room_id, ord, ring. Components: drawing_id, uid, category, specific_type, ring.
All joins run per drawing through grid buckets; Column predicates decide where they can, the numpy
kernel (in Arrow batches) where they cannot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import geometry as G
from ..functions import kernel as K
from ..functions import planar, polygons
from ..functions.vocab import EXTERIOR_ID
from ..sources.shared import materialise
from .spatial import box_join, boxed, nearest

#: Millimetres: length of the probe on both sides of a threshold, reach of windows and unhit doors.
PROBE, REACH, DOOR_MARGIN = 300.0, 300.0, 0.1


def as_points(ring) -> np.ndarray:
    """A ring as an array of points: of the numbers that :func:`flat` makes of it, or of its structs."""
    if isinstance(ring, np.ndarray) and ring.dtype != object:
        return ring.reshape(-1, 2)
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def flat(ring):
    """A ring as x, y, x, y, ..., which Arrow hands over as one array of numbers."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def lazy_udf(function, kind: str, *, in_place: bool = False):
    """A pandas UDF that is made when it is called, since workers import this module without a session.

    With ``in_place`` filters on its result stay above it, and do not take it below a shuffle that deals its rows.
    """

    def call(*rings):
        made = pandas_udf(function, kind)
        return (made.asNondeterministic() if in_place else made)(*(flat(F.col(r) if isinstance(r, str) else r) for r in rings))

    return call


def pair_udf(function, kind: str):
    """A pandas UDF of a kernel function of two rings."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(as_points(x), as_points(y)) for x, y in zip(a, b, strict=True)])

    return lazy_udf(run, kind)


def stacks(a: pd.Series, b: pd.Series):
    """Pairs of rings by their numbers of points: (places, first rings (n, k, 2), second rings (n, m, 2))."""
    one, two = ([None if x is None else as_points(x) if x.dtype == object else x for x in side] for side in (a, b))
    by: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(one, two, strict=True)):
        if x is not None and y is not None:
            by.setdefault((x.size, y.size), []).append(i)
    for (k, m), at in by.items():
        if k and m:
            yield np.array(at), *(np.concatenate([side[i] for i in at], axis=None).reshape(len(at), -1, 2) for side in (one, two))


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.inf)
    for at, r, s in stacks(a, b):
        out[at] = K.polygon_distances(r, s)
    return pd.Series(out)


def _common_areas(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    for at, r, s in stacks(a, b):
        (one, a0, a1), (two, b0, b1) = K.boxes(r), K.boxes(s)
        both = np.maximum(np.minimum(a1, b1) - np.maximum(a0, b0), 0)
        out[at] = both[:, 0] * both[:, 1]
        for i in np.flatnonzero(~(one & two)).tolist():
            out[at[i]] = K.intersection_area(r[i], s[i])
    return pd.Series(out)


def _shared_lengths(a: pd.Series, b: pd.Series, tolerance: float = 0.0) -> pd.Series:
    out = np.zeros(len(a))
    for at, r, s in stacks(a, b):
        out[at] = K.shared_lengths(r, s, tolerance)
    return pd.Series(out)


def shared_within(tolerance: float):
    """A pandas UDF of the length of the boundary that two rings share, walls up to the tolerance apart."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _shared_lengths(a, b, tolerance)

    return lazy_udf(run, "double")


def measured(function, *names: str):
    """A pandas UDF of a kernel function of many rings with equally many points (n, k, 2), which gives a number for
    each, or a row of the named ones; 0 for a ring without points, null for null."""

    def table(a: pd.Series) -> np.ndarray:
        out = np.full((len(a), len(names) or 1), np.nan)
        rings = [None if x is None else as_points(x) for x in a]
        by: dict[int, list[int]] = {}
        for i, x in enumerate(rings):
            if x is not None:
                by.setdefault(len(x), []).append(i)
        out[by.pop(0, [])] = 0
        for at in by.values():
            out[at] = np.reshape(function(np.stack([rings[i] for i in at])), (len(at), -1))
        return out

    def number(a: pd.Series) -> pd.Series:
        return pd.Series(table(a)[:, 0])

    def row(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(table(a), columns=list(names))

    return lazy_udf(row, f"struct<{','.join(f'{n}:double' for n in names)}>") if names else lazy_udf(number, "double")


def ring_udf(function, kind: str):
    """A pandas UDF of a kernel function of one ring; null for null."""

    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(as_points(x)) for x in a], dtype=object)

    def run_frame(a: pd.Series) -> pd.DataFrame:
        names = [f.split(":")[0] for f in kind[7:-1].split(",")]
        return pd.DataFrame([dict.fromkeys(names) if x is None else function(as_points(x)) for x in a], columns=names)

    return lazy_udf(run_frame if kind.startswith("struct") else run, kind)


def flat_rings(polygon):
    """All rings of a polygon (outer ones and holes), each as x, y, x, y, ..."""
    return F.transform(polygons.rings(polygon), flat)


def as_rings(rings) -> list[np.ndarray]:
    return [np.asarray(r, float).reshape(-1, 2) for r in rings]


def polygon_udf(function, kind: str):
    """A pandas UDF of a kernel function of the rings of one or two polygons with holes and parts; null where one is null."""

    def run(first: pd.Series, *more: pd.Series) -> pd.Series:
        rows = zip(first, *more, strict=True)
        return pd.Series([None if any(x is None for x in row) else function(*map(as_rings, row)) for row in rows])

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def call(*columns):
        return pandas_udf(one if len(columns) == 1 else two, kind)(*(flat_rings(F.col(c) if isinstance(c, str) else c) for c in columns))

    return call


def region_udf(alone, together, kind: str):
    """A pandas UDF of a kernel function of two polygons: ``together`` for many whose rings have equally many points,
    ``alone`` for those with a ring without points; null where one is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float | None] = [None] * len(a)
        by: dict[tuple, list[int]] = {}
        one, two = ([None if x is None else as_rings(x) for x in side] for side in (a, b))
        for i, (r, s) in enumerate(zip(one, two, strict=True)):
            if r is None or s is None:
                continue
            sizes = tuple(map(len, r)), tuple(map(len, s))
            if all(n and min(n) > 0 and sum(n) > 2 for n in sizes):
                by.setdefault(sizes, []).append(i)
            else:
                out[i] = alone(r, s)
        for (rings, others), at in by.items():
            # as many pairs at once as have some million pairs of sides
            step = max(1, 500_000 // (sum(rings) * sum(others)))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                found = together(np.stack([np.concatenate(one[i]) for i in some]), rings, np.stack([np.concatenate(two[i]) for i in some]), others)
                for i, x in zip(some, found.tolist(), strict=True):
                    out[i] = x
        return pd.Series(out, dtype="Float64")

    def call(*columns):
        return pandas_udf(run, kind)(*(flat_rings(F.col(c) if isinstance(c, str) else c) for c in columns))

    return call


def _mended(a: pd.Series) -> pd.Series:
    points = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    # Storeys repeat: rings that are equal, point by point, are mended once a batch.
    known: dict[bytes, list] = {}

    def one(numbers) -> list | None:
        if numbers is None:
            return None
        ring = as_points(numbers)
        same = ring.tobytes()
        if same not in known:
            known[same] = [{"outer": points(outer), "holes": [points(h) for h in holes]} for outer, holes in planar.mended([planar.exact(p) for p in ring.tolist()])]
        return known[same]

    return pd.Series([one(x) for x in a], dtype=object)


#: The areas of a ring that crosses, touches or folds onto itself; null for a null ring.
mended = lazy_udf(_mended, polygons.PARTS)
polygon_distance = region_udf(K.region_distance, K.region_distances, "double")
polygon_common_area = region_udf(K.common_region_area, K.common_region_areas, "double")
shared_length = shared_within(0.0)
ring_distance = lazy_udf(_distances, "double")
common_area = lazy_udf(_common_areas, "double", in_place=True)


def _rooms(rooms: DataFrame, margin: float = 0.0) -> DataFrame:
    return boxed(rooms.select("drawing_id", "room_id", F.col("ord").alias("room_ord"), F.col("ring").alias("room_ring")), G.bounds(F.col("room_ring")), margin)


def points_in_rooms(points: DataFrame, rooms: DataFrame) -> DataFrame:
    """Pairs of points (drawing_id, x, y and more) and the rooms that hold them strictly inside."""
    at = boxed(points, F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    return box_join(at, _rooms(rooms)).where(G.contains(F.col("room_ring"), F.col("x"), F.col("y"))).drop("box", "other_box")


def furniture_in_rooms(components: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms that hold a component's centroid."""
    centre = components.withColumn("centre", G.centroid(F.col("ring"))).withColumns({"x": F.col("centre.x"), "y": F.col("centre.y")})
    return points_in_rooms(centre.select("drawing_id", "uid", "specific_type", "x", "y"), rooms).select("drawing_id", "uid", "specific_type", "room_id", "room_ord")


def windows_of_rooms(windows: DataFrame, rooms: DataFrame, reach: float = REACH) -> DataFrame:
    """Rooms nearer than ``reach`` to a window's centroid; a window may have several."""
    centre = G.centroid(F.col("ring"))
    at = windows.select("drawing_id", "uid", centre["x"].alias("x"), centre["y"].alias("y"))
    at = boxed(at, F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")), reach)
    near = G.distance_to_ring(F.col("room_ring"), F.col("x"), F.col("y")) < reach
    return box_join(at, _rooms(rooms)).where(near).select("drawing_id", "uid", "room_id", "room_ord")


def nearest_rooms(doors: DataFrame, rooms: DataFrame, *, search: float = 0.5, second: float = 0.4) -> DataFrame:
    """For each door its nearest room and, if nearer than ``second``, the next one.

    Doors: drawing_id, uid, ring. The nearest within ``search`` is always kept.
    """
    held = boxed(doors.select("drawing_id", "uid", "ring"), G.bounds(F.col("ring")), search)
    near = box_join(held, _rooms(rooms)).withColumn("distance", ring_distance("ring", "room_ring")).where(F.col("distance") <= search)
    two = nearest(near, ["drawing_id", "uid"], [F.col("distance"), F.col("room_ord")], 2)
    return two.where((F.col("rank") == 1) | (F.col("distance") < second)).select("drawing_id", "uid", "room_id", "rank", "distance")


_CHORD = "struct<length:double,px:double,py:double,qx:double,qy:double>"


def _longest_chords(door: pd.Series, room: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(door), 5))
    for at, d, r in stacks(door, room):
        n, p, q = K.longest_chords(d, r, DOOR_MARGIN)
        out[at] = np.column_stack([n, p, q])
    return pd.DataFrame(out, columns=["length", "px", "py", "qx", "qy"])


_chord = lazy_udf(_longest_chords, _CHORD)


def bind_doors(doors: DataFrame, rooms: DataFrame) -> DataFrame:
    """(drawing_id, uid, ends): the rooms that a door joins, in room order.

    The longest stretch of any room's boundary in the door's box is the threshold. From its middle a
    probe goes PROBE to both sides; the rooms that it meets are the door's. If it meets none, all rooms
    nearer than REACH are. Of more than two the first two stay; a single one is joined to the exterior;
    a door without rooms has no ends.
    """
    held = boxed(doors.select("drawing_id", "uid", "ring"), G.bounds(F.col("ring")), DOOR_MARGIN)
    chords = box_join(held, _rooms(rooms)).withColumn("chord", _chord("ring", "room_ring")).where(F.col("chord.length") > 1e-3)
    best = chords.groupBy("drawing_id", "uid").agg(F.max_by("chord", F.struct("chord.length", -F.col("room_ord"))).alias("chord"))
    c = F.col("chord")
    nx, ny = (c["py"] - c["qy"]) / c["length"], (c["qx"] - c["px"]) / c["length"]
    mx, my = (c["px"] + c["qx"]) / 2, (c["py"] + c["qy"]) / 2
    probe = F.array(G.point(mx - PROBE * nx, my - PROBE * ny), G.point(mx + PROBE * nx, my + PROBE * ny))
    probes = best.select("drawing_id", "uid", probe.alias("probe"))
    probes = boxed(probes, G.bounds(F.col("probe")))
    met = box_join(probes, _rooms(rooms)).where(ring_distance("room_ring", "probe") == 0).select("drawing_id", "uid", "room_id", "room_ord")
    # Used twice below; written out, or every chord and probe would be worked out twice.
    met = materialise(met, "door-rooms")
    unhit = doors.select("drawing_id", "uid", "ring").join(met, ["drawing_id", "uid"], "left_anti")
    around = box_join(boxed(unhit, G.bounds(F.col("ring")), REACH), _rooms(rooms)).where(ring_distance("ring", "room_ring") < REACH)
    met = met.unionByName(around.select("drawing_id", "uid", "room_id", "room_ord"))
    ends = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("room_ord", "room_id"))), 1, 2), lambda s: s["room_id"])
    bound = met.groupBy("drawing_id", "uid").agg(ends.alias("ends"))
    all_doors = doors.select("drawing_id", "uid").join(bound, ["drawing_id", "uid"], "left")
    one = F.size("ends") == 1
    return all_doors.select("drawing_id", "uid", F.when(one, F.concat("ends", F.array(F.lit(EXTERIOR_ID)))).otherwise(F.coalesce("ends", F.array().cast("array<string>"))).alias("ends"))


def door_edges(bound: DataFrame) -> DataFrame:
    """(drawing_id, u, v) of doors between two rooms, exterior left out."""
    two = bound.where((F.size("ends") == 2) & ~F.array_contains("ends", EXTERIOR_ID))
    return two.select("drawing_id", F.element_at("ends", 1).alias("u"), F.element_at("ends", 2).alias("v"))


def touching_rooms(rooms: DataFrame, *, min_shared: float | None = None, tolerance: float = 0.0) -> DataFrame:
    """(drawing_id, u, v, shared) of rooms that touch, corners included, or share more than ``min_shared``.

    Pairs come once, in room order. Walls up to ``tolerance`` apart are shared ones.
    """
    a = boxed(rooms.select("drawing_id", F.col("room_id").alias("u"), F.col("ord").alias("a_ord"), F.col("ring").alias("a_ring")), G.bounds(F.col("a_ring")), tolerance)
    b = boxed(rooms.select("drawing_id", F.col("room_id").alias("v"), F.col("ord").alias("b_ord"), F.col("ring").alias("b_ring")), G.bounds(F.col("b_ring")))
    pairs = box_join(a, b).where("a_ord < b_ord")
    if min_shared is None:
        pairs = pairs.where(ring_distance("a_ring", "b_ring") <= tolerance)
    pairs = pairs.withColumn("shared", shared_within(tolerance)("a_ring", "b_ring"))
    if min_shared is not None:
        pairs = pairs.where(F.col("shared") > min_shared)
    return pairs.select("drawing_id", "u", "v", "shared")


def adjacency(rooms: DataFrame, bound: DataFrame) -> DataFrame:
    """(drawing_id, u, v, kind): door edges, and touching rooms that no door joins."""
    doors = door_edges(bound).select("drawing_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = touching_rooms(rooms).select("drawing_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    plain = near.join(doors.hint("merge"), ["drawing_id", "u", "v"], "left_anti")
    return doors.withColumn("kind", F.lit("door")).unionByName(plain.withColumn("kind", F.lit("touch")))


def graph_view(rooms: DataFrame, bound: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (drawing_id, node, kind) and undirected edges (drawing_id, u, v, kind) of rooms and doors.

    Doors without ends are left out. Rooms are joined by ``edges`` as adjacent, a door and its rooms as
    interface; ends that are no room of the drawing, such as the exterior, have no edge.
    """
    spaces = rooms.select("drawing_id", F.col("room_id").alias("node"), F.lit("space").alias("kind"))
    doors = bound.where(F.size("ends") > 0)
    nodes = spaces.unionByName(doors.select("drawing_id", F.col("uid").alias("node"), F.lit("door").alias("kind")))
    sides = doors.select("drawing_id", F.col("uid").alias("u"), F.explode("ends").alias("v"))
    sides = sides.join(spaces.select("drawing_id", F.col("node").alias("v")), ["drawing_id", "v"], "left_semi").select("drawing_id", "u", "v")
    pairs = edges.where(F.col("u") != F.col("v")).select("drawing_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return nodes, pairs.withColumn("kind", F.lit("adjacent")).unionByName(sides.withColumn("kind", F.lit("interface")))


def drawing_summary(rooms: DataFrame, doors: DataFrame, edges: DataFrame, suites: DataFrame) -> DataFrame:
    """drawing_id, n_rooms, n_doors, n_edges, n_suites of every drawing with a room; edges count once."""
    pairs = edges.where(F.col("u") != F.col("v")).select("drawing_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    out = rooms.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_rooms"))
    for df, what, n in ((doors, F.count(F.lit(1)), "n_doors"), (pairs, F.count(F.lit(1)), "n_edges"), (suites, F.count_distinct("suite_id"), "n_suites")):
        out = out.join(df.groupBy("drawing_id").agg(what.alias(n)), "drawing_id", "left")
    return out.fillna(0, ["n_doors", "n_edges", "n_suites"])


def first_room(facilities: DataFrame, rooms: DataFrame, *, reach: float = 5.0) -> DataFrame:
    """For each facility (drawing_id, uid, x, y) the first room in order that holds it or is nearer than ``reach``."""
    at = boxed(facilities, F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")), reach)
    near = box_join(at, _rooms(rooms)).where(G.distance_to_ring(F.col("room_ring"), F.col("x"), F.col("y")) < reach)
    return near.groupBy("drawing_id", "uid").agg(F.min_by("room_id", "room_ord").alias("room_id"))


def numbered(df: DataFrame, pattern: str, by: list[str], order: list, name: str = "id") -> DataFrame:
    """Consecutive ids per group, such as Space_001."""
    return df.withColumn(name, F.format_string(pattern, F.row_number().over(Window.partitionBy(*by).orderBy(*order))))
