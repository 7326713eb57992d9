"""From drawing primitives to elements, components, walls and rooms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernel as K
from ..functions import planar, polygons
from ..functions.vocab import BACKGROUND, BOUNDARY_LABELS, LABELS, OPENING_LABELS, STOP_TEXT, TEXT_LABEL, WINDOW_LABELS
from ..sources.shared import spread
from .graph import by_drawing, drawings
from .graph import components as connected
from .spatial import box_join, boxed
from .topology import lazy_udf, measured, polygon_udf, ring_udf, stacks


def label_of(semantic: Column, instance: Column) -> Column:
    """The label of a class id; background where the class or the instance is -1, absent or out of range."""
    labels = F.array(*(F.lit(x) for x in LABELS))
    known = (semantic >= 0) & (instance != -1)
    return F.coalesce(F.when(known, F.get(labels, semantic)), F.lit(BACKGROUND))


def inject_instances(primitives: DataFrame, instances: DataFrame) -> DataFrame:
    """Primitives (drawing_id, ord, ...) with instance_id, label_id and score of the last instance whose mask holds them.

    Instances: drawing_id, instance_id, masks array<boolean>, label_id, score.
    """
    bits = instances.select("drawing_id", "instance_id", "label_id", "score", F.posexplode("masks").alias("ord", "bit")).where("bit")
    last = bits.groupBy("drawing_id", "ord").agg(F.max_by(F.struct("instance_id", "label_id", "score"), "instance_id").alias("hit"))
    joined = primitives.join(last, ["drawing_id", "ord"], "left")
    return joined.select(*primitives.columns, F.coalesce("hit.instance_id", F.lit(-1)).alias("instance_id"), F.coalesce("hit.label_id", F.lit(-1)).alias("label_id"), F.col("hit.score").alias("score"))


def walls(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("type").isin(BOUNDARY_LABELS))


def doors(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("type").isin(OPENING_LABELS))


def windows(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("type").isin(WINDOW_LABELS))


def furniture(elements: DataFrame) -> DataFrame:
    """Neither boundary, opening nor text."""
    return elements.where(~F.col("type").isin([*BOUNDARY_LABELS, *OPENING_LABELS, "text", TEXT_LABEL]))


def room_texts(texts: DataFrame) -> DataFrame:
    """Texts that may name a room: at least two characters, not the stop text, not plain letters, digits and dots."""
    t = F.trim(F.col("text"))
    ok = (F.length(t) >= 2) & (t != STOP_TEXT) & ~t.rlike(r"^[a-zA-Z0-9.]+$")
    return texts.withColumn("text", t).where(ok)


def text_centre(x: Column, y: Column, text: Column, size: Column, anchor: Column) -> Column:
    """Estimated centre of a text, truncated to integers: an anchor in the middle is its own centre."""
    cx = F.when(anchor == "middle", x).otherwise(x + F.length(text) * size * 0.8 / 2)
    return F.struct(cx.cast("bigint").alias("x"), (y - size / 2).cast("bigint").alias("y"))


def group_instances(elements: DataFrame, category: str) -> DataFrame:
    """One component per instance: box of all its points, sides in whole millimetres, first element's type.

    elements: drawing_id, elem_id, type, instance_id, coords. A flat box is grown by 1 on all sides.
    """
    held = elements.where("instance_id <> -1").withColumn("b", G.bounds(F.col("coords")))
    boxes = held.groupBy("drawing_id", "instance_id").agg(
        F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"), F.min_by("type", "elem_id").alias("specific_type"), F.count(F.lit(1)).alias("n_elements")
    )
    flat = F.when((F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1")), 1.0).otherwise(0.0)
    w, h = F.col("x1") - F.col("x0") + 2 * flat, F.col("y1") - F.col("y0") + 2 * flat
    return boxes.select(
        "drawing_id",
        F.concat(F.lit(category.upper() + "_"), F.col("instance_id").cast("string")).alias("uid"),
        F.lit(category).alias("category"),
        "specific_type",
        G.rectangle(F.col("x0") - flat, F.col("y0") - flat, F.col("x1") + flat, F.col("y1") + flat).alias("ring"),
        F.greatest(w, h).cast("bigint").alias("length_mm"),
        F.least(w, h).cast("bigint").alias("width_mm"),
        "n_elements",
    )


def component_segments(components: DataFrame) -> DataFrame:
    """The sides of components' boxes as segments."""
    side = F.posexplode(G.segments(F.col("ring"))).alias("ord", "s")
    return components.select("drawing_id", "uid", side).select("drawing_id", "uid", "ord", F.array("s.p", "s.q").alias("coords"))


# ----------------------------------------------------------- wall diffusion


def _covered_lengths(line: pd.Series, wall: pd.Series) -> pd.Series:
    """Length of a polyline within 0.1 of another one, by exact clipping of its parts to capsules."""
    out = np.zeros(len(line))
    for at, a, b in stacks(line, wall):
        out[at] = covered_lengths(a, b, 0.1)
    return pd.Series(out)


_covered = lazy_udf(_covered_lengths, "double", in_place=True)


def covered_length(line, wall, reach: float) -> float:
    """Length of ``line`` within ``reach`` of ``wall`` (both open polylines)."""
    return float(covered_lengths(line[None], wall[None], reach)[0])


def covered_lengths(line: np.ndarray, wall: np.ndarray, reach: float) -> np.ndarray:
    """Lengths of ``line`` within ``reach`` of ``wall``, of many pairs of open polylines; those of a side have equally many points (n, k, 2)."""
    total = np.zeros(len(line))
    for i in range(line.shape[1] - 1):
        p, v = line[:, i], line[:, i + 1] - line[:, i]
        n = np.hypot(v[:, 0], v[:, 1])
        u = v / np.where(n == 0, 1.0, n)[:, None]
        spans = [_capsules(p, u, n, wall[:, j], wall[:, j + 1], reach) for j in range(wall.shape[1] - 1)]
        if not spans:
            continue
        lo, hi = (np.stack([s[k] for s in spans]) for k in (0, 1))
        order = np.argsort(lo, axis=0, kind="stable")
        lo, hi = (np.take_along_axis(x, order, axis=0) for x in (lo, hi))
        end, found = np.zeros(len(line)), np.zeros(len(line))
        for x, y in zip(lo, hi, strict=True):
            x = np.maximum(x, end)
            found += np.where(y > x, y - x, 0.0)
            end = np.where(y > x, y, end)
        total += np.where(n > 0, found, 0.0)
    return total


def _capsules(p: np.ndarray, u: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of p + t u, 0 <= t <= n, within ``reach`` of the segment ab: an interval, since capsules are convex; empty ones end before they begin."""
    dot = lambda x, y: x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1]
    low, high = np.full(len(p), np.inf), np.full(len(p), -np.inf)
    for c in (a, b):
        w = p - c
        k = dot(w, u)
        d = k * k - (dot(w, w) - reach * reach)
        r = np.sqrt(np.maximum(d, 0))
        low, high = np.where(d >= 0, np.minimum(low, -k - r), low), np.where(d >= 0, np.maximum(high, -k + r), high)
    v = b - a
    m = np.hypot(v[:, 0], v[:, 1])
    e = v / np.where(m == 0, 1.0, m)[:, None]
    lo, hi = np.full(len(p), -np.inf), np.full(len(p), np.inf)
    for axis, least, most in ((e, 0.0, m), (np.column_stack([-e[:, 1], e[:, 0]]), -reach, reach)):
        s, w = dot(u, axis), dot(p - a, axis)
        flat = np.abs(s) < 1e-15
        step = np.where(flat, 1.0, s)
        x, y = (least - w) / step, (most - w) / step
        out = flat & ~((least <= w) & (w <= most))
        lo = np.where(flat, np.where(out, np.inf, lo), np.maximum(lo, np.minimum(x, y)))
        hi = np.where(flat, np.where(out, -np.inf, hi), np.minimum(hi, np.maximum(x, y)))
    held = (m > 0) & (lo <= hi)
    low, high = np.where(held, np.minimum(low, lo), low), np.where(held, np.maximum(high, hi), high)
    return np.maximum(low, 0.0), np.minimum(high, n)


def diffuse_walls(elements: DataFrame, *, reach: float = 0.1) -> DataFrame:
    """All elements, with type ``wall`` for background lines that continue walls.

    A background line that runs along an original wall (more than 15, or 30 % of its length, within
    ``reach``) is never promoted. Of the others those are whose first or last point is within ``reach``
    of an end of a wall or of one promoted before, until nothing changes.
    """
    lines = elements.where(F.size("coords") >= 2)
    wall = lines.where(F.col("type").isin(BOUNDARY_LABELS))
    ground = lines.where(F.col("type").contains(BACKGROUND))
    side = lambda df, n: boxed(df.select("drawing_id", F.col("elem_id").alias(f"{n}_id"), F.col("coords").alias(f"{n}_line")), G.bounds(F.col(f"{n}_line")), reach)
    near = spread(box_join(side(ground, "g"), side(wall, "w")), "drawing_id", "g_id", "w_id")
    full = G.length(F.col("g_line"))
    over = _covered("g_line", "w_line")
    along = near.withColumn("full", full).where("full >= 1e-3").withColumn("over", over).where((F.col("over") > 15) | (F.col("over") / F.col("full") > 0.3))
    free = ground.join(along.select("drawing_id", F.col("g_id").alias("elem_id")).distinct(), ["drawing_id", "elem_id"], "left_anti")
    held = free.select("drawing_id", "elem_id", "coords").withColumn("is_wall", F.lit(False)).unionByName(wall.select("drawing_id", "elem_id", "coords").withColumn("is_wall", F.lit(True)))
    ends = held.select("drawing_id", "elem_id", F.explode(F.array_distinct(F.array(F.element_at("coords", 1), F.element_at("coords", -1)))).alias("p"))
    # Ends are joined through cells of ``reach``: a near end is in the same cell or a neighbour.
    cell = lambda c: F.floor(F.col(c) / reach)
    a = ends.select("drawing_id", F.col("elem_id").alias("u"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), cell("p.x").alias("cx"), cell("p.y").alias("cy"))
    near_by = F.sequence(F.lit(-1), F.lit(1))
    b = ends.select("drawing_id", F.col("elem_id").alias("v"), F.col("p.x").alias("bx"), F.col("p.y").alias("by"), cell("p.x").alias("x"), cell("p.y").alias("y"))
    b = b.withColumn("dx", F.explode(near_by)).withColumn("dy", F.explode(near_by)).withColumns({"cx": F.col("x") + F.col("dx"), "cy": F.col("y") + F.col("dy")})
    close = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= reach * reach
    links = a.join(b, ["drawing_id", "cx", "cy"]).where((F.col("u") < F.col("v")) & close).select("drawing_id", "u", "v").distinct()
    comp = connected(held.select("drawing_id", F.col("elem_id").alias("node")), links).withColumnRenamed("node", "elem_id")
    reached = comp.join(held.where("is_wall").select("drawing_id", "elem_id"), ["drawing_id", "elem_id"]).select("drawing_id", "component").distinct()
    promoted = comp.join(reached, ["drawing_id", "component"]).join(free.select("drawing_id", "elem_id"), ["drawing_id", "elem_id"], "left_semi").select("drawing_id", "elem_id", F.lit(True).alias("promoted"))
    out = elements.join(promoted, ["drawing_id", "elem_id"], "left")
    return out.withColumn("type", F.when(F.col("promoted"), F.lit("wall")).otherwise(F.col("type"))).select(*elements.columns)


# ------------------------------------------------------------------- rooms


def clean_walls(elements: DataFrame) -> DataFrame:
    """drawing_id, seg, and integer ends x0, y0, x1, y1 of the drawing's walls, noded, merged and straight.

    Ends at crossings that are no integers are rounded to 1e-6.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for drawing, group in frame.groupby("drawing_id", sort=True):
            parts = []
            for line in group["line"]:
                pts = [(int(p["x"]), int(p["y"])) for p in line]
                parts += list(zip(pts[:-1], pts[1:], strict=True))
            rows += [(drawing, i, *(round(float(v), 6) for p in s for v in p)) for i, s in enumerate(K.node_lines(parts))]
        return pd.DataFrame(rows, columns=["drawing_id", "seg", "x0", "y0", "x1", "y1"])

    lines = elements.select("drawing_id", G.snap(F.col("coords")).alias("line")).where(F.size("line") >= 2)
    return by_drawing(lines, run, "drawing_id long, seg int, x0 double, y0 double, x1 double, y1 double")


def room_faces(segments: DataFrame) -> DataFrame:
    """drawing_id, face, ring, holes: the closed areas between segments (drawing_id, x0, y0, x1, y1), less the islands in them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        points = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
        rows = []
        for drawing, walls_ in drawings(frame, "x0", "y0", "x1", "y1"):
            lines = K.node_lines([((int(a), int(b)), (int(c), int(d))) for a, b, c, d in walls_])
            rows += [(drawing, i, points(ring), [points(h) for h in holes]) for i, (ring, holes) in enumerate(planar.faces(lines))]
        return pd.DataFrame(rows, columns=["drawing_id", "face", "ring", "holes"])

    return by_drawing(segments.select("drawing_id", "x0", "y0", "x1", "y1"), run, f"drawing_id long, face int, ring {G.RING}, holes array<{G.RING}>")


def mesh(points: DataFrame) -> DataFrame:
    """drawing_id, tri, ring, cx, cy, radius: Delaunay triangles of a drawing's points (drawing_id, x, y).

    Points are rounded to integers; repeated ones count once, fewer than three give no triangle. The
    triangles' sides are counter-clockwise; centre and radius are those of the circumcircle.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for drawing, group in frame.groupby("drawing_id", sort=True):
            mesh = planar.Mesh(zip(group["x"].tolist(), group["y"].tolist(), strict=True))
            for i, ring in enumerate(mesh.triangles()):
                rows.append((drawing, i, [{"x": float(x), "y": float(y)} for x, y in ring], *K.circumcircle(*ring)))
        return pd.DataFrame(rows, columns=["drawing_id", "tri", "ring", "cx", "cy", "radius"])

    whole = points.select("drawing_id", F.rint("x").cast("bigint").alias("x"), F.rint("y").cast("bigint").alias("y")).where("x is not null and y is not null")
    return by_drawing(whole, run, f"drawing_id long, tri int, ring {G.RING}, cx double, cy double, radius double")


#: Least area (mm2), inset (mm), short side (mm), compactness and solidity of a plausible room.
ROOM_LIMITS = (2e6, 250.0, 600.0, 0.08, 0.25)

rectangle_of = measured(K.min_rectangles, "area", "long", "short")
inset_left = ring_udf(lambda r: K.survives_inset(r, ROOM_LIMITS[1]), "boolean")
polygon_inset_left = polygon_udf(lambda rings: K.survives_inset(rings, ROOM_LIMITS[1]), "boolean")
hull_area = ring_udf(lambda r: abs(K.ring_area(K.hull(r))) if len(r) > 2 else 0.0, "double")
clear_width = measured(K.clear_widths)


def plausible_rooms(faces: DataFrame) -> DataFrame:
    """Faces (drawing_id, face, ring, and holes if they have any) that can be rooms, numbered Space_001 on in face order.

    Islands count for area, boundary and inset; the room's ring is the outer one. Cheap tests come first.
    """
    least_area, _, short, compact, solid = ROOM_LIMITS
    whole = polygons.parts(F.col("ring"), F.col("holes") if "holes" in faces.columns else None)
    held = faces.withColumn("polygon", whole).withColumns({"area": polygons.area(F.col("polygon")), "around": polygons.perimeter(F.col("polygon"))})
    kept = held.where((F.col("area") >= least_area) & (4 * F.pi() * F.col("area") >= compact * F.pow("around", 2)))
    kept = kept.where(rectangle_of("ring")["short"] >= short).where(F.col("area") >= solid * hull_area("ring")).where(polygon_inset_left("polygon"))
    number = F.row_number().over(Window.partitionBy("drawing_id").orderBy("face"))
    return kept.withColumn("ord", number).select("drawing_id", F.format_string("Space_%03d", "ord").alias("room_id"), "ord", "ring", "polygon", "area")


def opening_edges(edges: DataFrame, openings: DataFrame, *, reach: float = 300.0, longest: float = 3500.0) -> DataFrame:
    """Edges (drawing_id, edge_id, x0, y0, x1, y1) that close an opening (drawing_id, ring).

    Both ends are within ``reach`` of the same opening, and the edge is parallel to one of its sides.
    """
    px, py, qx, qy = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    n = F.hypot(qx - px, qy - py)
    ok = edges.withColumn("n", n).where((F.col("n") >= 1e-3) & (F.col("n") <= longest))
    held = boxed(ok, F.struct(F.least(px, qx).alias("x0"), F.least(py, qy).alias("y0"), F.greatest(px, qx).alias("x1"), F.greatest(py, qy).alias("y1")), reach)
    held = held.withColumnsRenamed({"x0": "px", "y0": "py", "x1": "qx", "y1": "qy"})
    doors_ = boxed(openings.select("drawing_id", F.col("ring").alias("door")), G.bounds(F.col("door")))
    near = box_join(held, doors_).where((G.distance_to_ring(F.col("door"), F.col("px"), F.col("py")) <= reach) & (G.distance_to_ring(F.col("door"), F.col("qx"), F.col("qy")) <= reach))
    ux, uy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")

    def parallel(s: Column) -> Column:
        vx, vy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        return F.abs(ux * vy - uy * vx) <= 1e-9 * F.col("n") * F.hypot(vx, vy)

    hit = near.where(F.exists(G.segments(F.col("door")), parallel)).select("drawing_id", "edge_id").distinct()
    return edges.join(hit, ["drawing_id", "edge_id"], "left_semi")
