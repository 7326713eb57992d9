"""Rooms as areas of a constrained mesh: triangles between walls, typed sides, flood fill, areas with holes.

Walls are segments (drawing_id, x0, y0, x1, y1); coordinates are rounded to 1 / UNITS and kept as multiples of it
until areas come out. Each drawing is triangulated in one task (many drawings a batch), which also tells what triangles
belong together however openings are closed; types of sides between such cells, the fill and the areas'
boundaries are DataFrame joins and groupings by drawing.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import planar, polygons
from ..sources.shared import materialise_rows
from .elements import opening_edges
from .graph import by_drawing, components, drawings

#: Parts of a millimetre to which walls' ends are rounded.
UNITS = 100
#: Walls of drawings whose triangles a task keeps.
KNOWN_WALLS = 30_000
#: Kinds of a triangle's side. The names of the mesh's edge types.
REAL_WALL, CONVEX_HULL, VIRTUAL_BLOCKER = "real_wall", "convex_hull", "virtual_blocker"

_TRIANGLE = ", ".join(["drawing_id long", "tri int", "cell int", *(f"x{i} double, y{i} double, wall{i} boolean, near{i} boolean, other{i} int, next{i} int" for i in range(3))])
_SIDE = ("x", "y", "wall", "near", "other", "next")


def constrained_mesh(walls: DataFrame, openings: DataFrame | None = None, *, reach: float = 300.0, longest: float = 3500.0) -> DataFrame:
    """drawing_id, tri, cell, and for each corner i its place xi, yi (in 1 / UNITS) and the side from it on: whether it is wall
    (walli) or may close an opening (neari), the triangle behind it, if any (otheri), and that one's cell (nexti).

    Triangles are counter-clockwise. Every wall, cut where walls meet, is a chain of sides; but for these the
    mesh is Delaunay. Drawings whose walls are all on one line have no triangles. A cell is what can be reached through sides that
    are neither, whatever openings turn out to be closed; it has the number of its least triangle.

    openings: drawing_id, ring. Sides may close one if they are no longer than ``longest`` and both ends are within ``reach`` of its box.
    """

    # Storeys repeat: equal walls are triangulated once a task, as long as those known are not too many.
    known: dict[tuple, tuple] = {}
    size = 0

    def triangulated(rows: list[tuple]) -> tuple:
        nonlocal size
        same = tuple(sorted(rows))
        if same not in known:
            if size > KNOWN_WALLS:
                known.clear()
                size = 0
            mesh = planar.constrained_mesh([((int(a), int(b)), (int(c), int(d))) for a, b, c, d in same])
            triangles, walls_ = mesh.numbered()
            known[same] = (np.array(triangles, np.int64).reshape(-1, 3), np.array(mesh.points, float).reshape(-1, 2), np.array(walls_, np.int64).reshape(-1, 2))
            size += len(same)
        return known[same]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        box = frame["box"].to_numpy(bool)
        each = [(drawing, *triangulated(rows)) for drawing, rows in drawings(frame[~box], "x0", "y0", "x1", "y1")]
        each = each or [(0, *triangulated([]))]
        ids, triangles, points, fixed = zip(*each, strict=True)
        from_ = np.cumsum([0, *map(len, points)])[:-1]  # corners are numbered on from drawing to drawing
        ids = np.repeat(np.array(ids, np.int64), [len(t) for t in triangles])
        found, fixed = (np.concatenate([n + x for n, x in zip(from_, part, strict=True)]) for part in (triangles, fixed))
        points = np.concatenate(points)
        return _cells(ids, found.ravel(), points, fixed, frame[box], reach, longest)

    held = walls.select("drawing_id", *(F.rint(F.col(c) * UNITS).cast("bigint").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(False).alias("box")).dropna()
    if openings is not None:
        bound = G.bounds(F.col("ring"))
        held = held.unionByName(openings.select("drawing_id", *(bound[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(True).alias("box")).dropna())
    return by_drawing(held, run, _TRIANGLE)


def _cells(drawing: np.ndarray, corner: np.ndarray, place: np.ndarray, ends: np.ndarray, boxes: pd.DataFrame, reach: float, longest: float) -> pd.DataFrame:
    """Rows of :func:`constrained_mesh` for triangles of many drawings, which come one after the other: their drawings,
    the numbers of their corners, all corners, and the sides that are walls."""
    n, m = len(place), len(drawing)
    u, v = corner, corner.reshape(-1, 3)[:, [1, 2, 0]].ravel()
    # The triangle behind a side has it the other way round.
    key, back = u * n + v, v * n + u
    order = np.argsort(key)
    where = np.minimum(np.searchsorted(key[order], back), max(len(key) - 1, 0))
    behind = np.where(key[order][where] == back, order[where] // 3, -1) if m else np.zeros(0, np.int64)
    wall = np.isin(np.minimum(u, v) * n + np.maximum(u, v), ends.min(axis=1) * n + ends.max(axis=1))
    near = ~wall & (behind >= 0) & _near(drawing, corner, place, u, v, boxes, reach, longest)
    # Each triangle takes the least number beyond its open sides until none changes; numbers point to further ones.
    cell, side = np.arange(m), np.repeat(np.arange(m), 3)
    open_ = ~wall & ~near & (behind >= 0)
    a, b = side[open_], behind[open_]
    while True:
        least = cell.copy()
        np.minimum.at(least, cell[a], cell[b])
        least = least[least]
        if (least == cell).all():
            break
        cell = least
    first = np.searchsorted(drawing, drawing)  # drawings come in order
    number = lambda x, by: np.where(x >= 0, x - first[by], -1)
    other, behind_cell = number(behind, side), np.where(behind >= 0, number(cell[behind], side), -1) if m else behind
    out = {"drawing_id": drawing, "tri": np.arange(m) - first, "cell": number(cell, np.arange(m))}
    for i in range(3):
        for name, values in zip(_SIDE, (place[u, 0], place[u, 1], wall, near, other, behind_cell), strict=True):
            mine = values[i::3]
            out[f"{name}{i}"] = pd.array(mine, "Int32") if name in ("other", "next") else mine
            if name in ("other", "next"):
                out[f"{name}{i}"][mine < 0] = pd.NA
    return pd.DataFrame(out)


def _near(drawing: np.ndarray, corner: np.ndarray, place: np.ndarray, u: np.ndarray, v: np.ndarray, boxes: pd.DataFrame, reach: float, longest: float) -> np.ndarray:
    """Which sides may close an opening: a millimetre is added to both limits, and every 64th box of a drawing counts as the same."""
    owner = np.zeros(len(place), np.int64)
    owner[corner] = np.repeat(drawing, 3)
    at, box = place / UNITS, boxes[["x0", "y0", "x1", "y1"]].to_numpy(float)
    of = boxes["drawing_id"].to_numpy(np.int64)
    low, high = np.searchsorted(of, owner), np.searchsorted(of, owner, "right")
    p = np.repeat(np.arange(len(place)), high - low)
    k = np.arange(len(p)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    q = low[p] + k
    apart = np.hypot(*(np.maximum(np.maximum(box[q, i] - at[p, i], at[p, i] - box[q, i + 2]), 0) for i in range(2)))
    hit = apart <= reach + 1
    met = np.zeros(len(place), np.uint64)
    np.bitwise_or.at(met, p[hit], np.uint64(1) << (k[hit] % 64).astype(np.uint64))
    return ((met[u] & met[v]) != 0) & (np.hypot(*(at[u] - at[v]).T) <= longest + 1)


def sides(mesh: DataFrame) -> DataFrame:
    """drawing_id, tri, cell, px, py, qx, qy, wall, near, other, next of triangles' sides, counter-clockwise, without those inside cells."""
    each = F.array(*(F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{i}").alias("py"), F.col(f"x{j}").alias("qx"), F.col(f"y{j}").alias("qy"), *(F.col(f"{c}{i}").alias(c) for c in _SIDE[2:])) for i, j in ((0, 1), (1, 2), (2, 0))))
    return mesh.select("drawing_id", "tri", "cell", F.inline(each)).where(~F.col("next").eqNullSafe(F.col("cell")) | F.col("near"))


def typed_sides(mesh: DataFrame, openings: DataFrame | None = None, *, reach: float = 300.0, longest: float = 3500.0) -> DataFrame:
    """drawing_id, cell, next, px, py, qx, qy, kind of :func:`sides`: wall, hull (a side with nothing behind it that is no wall), blocker (it closes an opening), or null."""
    columns = ["drawing_id", "cell", "next", "px", "py", "qx", "qy", "kind"]
    found = sides(mesh).withColumn("kind", F.when(F.col("wall"), REAL_WALL).when(F.col("other").isNull(), CONVEX_HULL))
    if openings is None:
        return found.select(columns)
    # Two triangles have one side in common; few sides are near an opening.
    name = F.least("tri", "other").cast("bigint") * (1 << 31) + F.greatest("tri", "other")
    doubtful = found.where("near").withColumn("edge_id", name)
    open_ = doubtful.where(F.col("tri") < F.col("other")).select("drawing_id", "edge_id", *((F.col(a) / UNITS).alias(b) for a, b in (("px", "x0"), ("py", "y0"), ("qx", "x1"), ("qy", "y1"))))
    closed = opening_edges(open_, openings, reach=reach, longest=longest).select("drawing_id", "edge_id", F.lit(VIRTUAL_BLOCKER).alias("closed"))
    told = doubtful.join(closed.hint("merge"), ["drawing_id", "edge_id"], "left").withColumn("kind", F.col("closed"))
    return found.where("not near").select(columns).unionByName(told.select(columns))


def filled(typed: DataFrame) -> DataFrame:
    """drawing_id, cell, area_id (its least triangle), exterior: what a flood fill through open sides reaches from each cell.

    An area that meets the hull anywhere without a wall leaks, and is exterior.
    """
    cells = typed.groupBy("drawing_id", "cell").agg(F.coalesce(F.bool_or(F.col("kind") == CONVEX_HULL), F.lit(False)).alias("leak"))
    through = typed.where(F.col("kind").isNull() & (F.col("cell") < F.col("next"))).select("drawing_id", F.col("cell").alias("u"), F.col("next").alias("v")).distinct()
    reached = components(cells.select("drawing_id", F.col("cell").alias("node")), through).select("drawing_id", F.col("node").alias("cell"), F.col("component").alias("area_id"))
    whole = Window.partitionBy("drawing_id", "area_id")
    return reached.join(cells.hint("merge"), ["drawing_id", "cell"]).select("drawing_id", "cell", "area_id", F.bool_or("leak").over(whole).alias("exterior"))


def area_polygons(typed: DataFrame, areas: DataFrame) -> DataFrame:
    """drawing_id, area_id, polygon (parts with holes, in millimetres) of areas (drawing_id, cell, area_id).

    An area is bounded by the sides of its cells behind which it does not go on; walls that end in it fall out.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # Cells' areas come with the sides, and are told by numbers that no two drawings of the frame share.
        at = frame["drawing_id"].ne(frame["drawing_id"].shift()).cumsum() * (1 << 31)
        own = frame["area_id"].notna()
        area = pd.Series(frame["area_id"][own].to_numpy(), at[own] + frame["cell"][own])
        rim = frame[~own]
        mine, theirs = (area.reindex(at[~own] + rim[c].fillna(-1).astype("int64")).to_numpy() for c in ("cell", "next"))
        rim = rim.assign(area_id=mine)[~np.isnan(mine) & (mine != theirs)].sort_values(["drawing_id", "area_id"], kind="stable")
        # Sides of an area stand together.
        keys = zip(rim["drawing_id"].tolist(), rim["area_id"].astype("int64").tolist(), strict=True)
        ends = rim[["px", "py", "qx", "qy"]].to_numpy()
        whole = (ends == np.rint(ends)).all()
        edges = ends.astype(np.int64).tolist() if whole else [[v for p in (row[:2], row[2:]) for v in planar.exact(p)] for row in ends.tolist()]
        points = lambda ring: [{"x": float(x) / UNITS, "y": float(y) / UNITS} for x, y in ring]
        rows = []
        for (drawing, number), group in groupby(zip(keys, edges, strict=True), lambda r: r[0]):
            found = planar.polygons([((a, b), (c, d)) for _, (a, b, c, d) in group])
            rows.append((drawing, number, [{"outer": points(ring), "holes": [points(h) for h in holes]} for ring, holes in found]))
        return pd.DataFrame(rows, columns=["drawing_id", "area_id", "polygon"])

    none = lambda kind, *names: (F.lit(None).cast(kind).alias(n) for n in names)
    rim = typed.select("drawing_id", "cell", "next", "px", "py", "qx", "qy", *none("int", "area_id"))
    held = areas.select("drawing_id", "cell", *none("int", "next"), *none("double", "px", "py", "qx", "qy"), "area_id")
    return by_drawing(rim.unionByName(held), run, f"drawing_id long, area_id int, polygon {polygons.PARTS}")


def enclosed_areas(walls: DataFrame, openings: DataFrame | None = None, **limits) -> DataFrame:
    """drawing_id, area_id, polygon of the areas that walls and closed openings (drawing_id, ring) shut in."""
    mesh = materialise_rows(constrained_mesh(walls, openings, **limits), "mesh")
    typed = materialise_rows(typed_sides(mesh, openings, **limits), "mesh-sides")
    inner = filled(typed).where(~F.col("exterior"))
    return area_polygons(typed, inner)


def candidate_faces(areas: DataFrame) -> DataFrame:
    """Areas as faces for ``elements.plausible_rooms``: the outer ring of the largest part and its holes, numbered by their first corner."""
    part = areas.withColumn("part", polygons.largest(F.col("polygon"))).where(F.col("part").isNotNull())
    first = F.array_min(F.transform("part.outer", lambda p: F.struct(p["x"], p["y"])))
    face = F.row_number().over(Window.partitionBy("drawing_id").orderBy(first, "area_id")) - 1
    return part.select("drawing_id", face.alias("face"), F.col("part.outer").alias("ring"), F.col("part.holes").alias("holes"))


def triangle_area() -> Column:
    """The area of a mesh's triangle in square millimetres."""
    x, y = ([F.col(f"{c}{i}") for i in range(3)] for c in "xy")
    return ((x[1] - x[0]) * (y[2] - y[0]) - (y[1] - y[0]) * (x[2] - x[0])) / (2 * UNITS**2)


def mesh_rings(mesh: DataFrame) -> DataFrame:
    """drawing_id, tri, ring (in millimetres) of the mesh's triangles."""
    corner = lambda i: G.point(F.col(f"x{i}") / UNITS, F.col(f"y{i}") / UNITS)
    return mesh.select("drawing_id", "tri", F.array(*map(corner, range(3))).alias("ring"))
