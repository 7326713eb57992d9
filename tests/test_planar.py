"""Polygons with holes and parts, constrained meshes and mended rings."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as G
from floorlens.functions import kernel as K
from floorlens.functions import planar, polygons
from floorlens.operators import elements as E
from floorlens.operators import mesh as M
from floorlens.operators import topology as P


def box(x, y, w, h):
    p = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return list(zip(p, p[1:] + p[:1], strict=True))


def sizes(found):
    return sorted((planar.twice_area(ring) / 2, *sorted(-planar.twice_area(h) / 2 for h in holes)) for ring, holes in found)


def test_islands_are_cut_out_of_their_rooms():
    room, island = box(0, 0, 100, 100), box(40, 40, 20, 20)
    assert sizes(planar.faces(K.node_lines(room + island))) == [(400,), (10000, 400)]
    # a wall that leads to the island, a loose end, an island in the island, one that touches the wall at a corner
    bridge, stub = [((0, 0), (40, 40))], [((100, 100), (80, 90))]
    assert sizes(planar.faces(K.node_lines(room + island + bridge + stub + box(45, 45, 5, 5)))) == [(25,), (400, 25), (10000, 400)]
    triangle = [((0, 0), (30, 10)), ((30, 10), (10, 30)), ((10, 30), (0, 0))]
    assert sizes(planar.faces(K.node_lines(room + triangle))) == [(400,), (10000, 400)]
    two = box(10, 10, 10, 10) + box(20, 20, 10, 10)  # islands that touch each other
    assert sizes(planar.faces(K.node_lines(room + two))) == [(100,), (100,), (10000, 100, 100)]
    assert planar.faces([]) == [] and planar.faces([((0, 0), (5, 5))]) == []


def test_rings_are_mended():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert planar.mended(square) == planar.mended(square[::-1]) == [(square, [])]
    assert planar.mended(square + square) == [(square, [])]
    assert planar.mended([(0, 0), (15, 0), (10, 0), (10, 10), (0, 10)]) == [(square, [])]
    assert sizes(planar.mended([(0, 0), (10, 10), (10, 0), (0, 10)])) == [(25,)]
    assert sizes(planar.mended([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)])) == [(25,), (25,)]
    # a hole that is joined to the outer ring by a slit, and one that touches it
    slit = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]
    assert sizes(planar.mended(slit)) == [(100, 4)]
    assert sizes(planar.mended([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (2, 4), (4, 2)])) == [(100, 6)]
    for nothing in ([], [(1, 1)], [(0, 0), (5, 0)], [(0, 0), (10, 0), (5, 0)], [(0, 0), (4, 4), (0, 0), (8, 8)]):
        assert planar.mended(nothing) == []


def test_mended_areas_are_those_of_the_winding_number():
    rng = random.Random(6)
    for _ in range(40):
        ring = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(3, 9))]
        points = [p for i, p in enumerate(ring) if p != ring[i - 1]]
        found = planar.mended(ring)
        sign = planar.direction(points) if len(points) > 2 else 1
        for _ in range(30):
            p = (rng.randrange(1, 1200) * 12 / 1201.7, rng.randrange(1, 1200) * 12 / 1203.1)
            wanted = len(points) > 2 and sign * planar.winding(points, p) > 0
            inside = any(planar.where(outer, p) > 0 and not any(planar.where(h, p) > 0 for h in holes) for outer, holes in found)
            assert inside == wanted


def triangles_of(mesh):
    return [np.array(t, float) for t in mesh.triangles()]


@pytest.mark.parametrize("seed", range(6))
def test_constrained_mesh_of_random_walls(seed):
    rng = random.Random(seed)
    segments = [s for _ in range(12) for s in box(rng.randrange(300), rng.randrange(300), rng.randrange(1, 90), rng.randrange(1, 90))]
    segments += [((rng.randrange(300), rng.randrange(300)), (rng.randrange(300), rng.randrange(300))) for _ in range(4 if seed % 2 else 0)]
    mesh = planar.constrained_mesh(segments)
    parts = [(planar.plain(p), planar.plain(q)) for p, q in K.node_lines(segments)]
    # Every part of a wall is a side; the triangles cover the hull; but for walls, no circle holds a neighbour's corner.
    assert mesh.fixed == {(min(p, q), max(p, q)) for p, q in parts} and all((p, q) in mesh.third or (q, p) in mesh.third for p, q in parts)
    points = {p for e in parts for p in e}
    rim = sum((b, a) not in mesh.third for a, b in mesh.third)
    assert len(mesh.triangles()) == 2 * len(points) - 2 - rim
    assert sum(K.ring_area(t) for t in triangles_of(mesh)) == pytest.approx(abs(K.ring_area(K.hull(np.array(sorted(points), float)))))
    for (a, b), c in mesh.third.items():
        assert planar.turn(a, b, c) > 0
        d = mesh.third.get((b, a))
        assert d is None or (min(a, b), max(a, b)) in mesh.fixed or not mesh._circled(a, b, c, d)


def test_meshes_of_few_points():
    assert planar.Mesh([]).triangles() == planar.Mesh([(0, 0), (1, 1), (2, 2), (5, 5)]).triangles() == []
    assert len(planar.Mesh([(0, 0), (0, 1), (0, 2), (0, 5), (3, 1)]).triangles()) == 3
    assert len(planar.Mesh([(0, 1), (2, 0), (2, 1), (2, 2)], [((0, 1), (2, 1))]).triangles()) == 2


def test_meshes_are_made_with_few_checks(monkeypatch):
    # Edges that lead to the newest point are never flipped, so only those opposite it are checked; a wall that is a side needs no flip.
    spots = [(1000 * i + 37 * k, 2000 * k + 11 * i) for i in range(12) for k in range(5)]
    checked, flipped = [], []
    circled, flip = planar.Mesh._circled, planar.Mesh._flip
    monkeypatch.setattr(planar.Mesh, "_circled", staticmethod(lambda *p: checked.append(p) or circled(*p)))
    monkeypatch.setattr(planar.Mesh, "_flip", lambda self, *e: flipped.append(e) or flip(self, *e))
    mesh = planar.Mesh(spots, [(p, q) for p, q in itertools.pairwise(spots) if p[0] < q[0] + 500 and p[1] < q[1]])
    third = mesh.third
    assert len(mesh.triangles()) > 80 and not checked and not flipped
    assert all((d := third.get((b, a))) is None or not circled(a, b, c, d) for (a, b), c in third.items())


def test_boundaries_of_one_way_are_followed_alike(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        rings = [box(20 * k + rng.randrange(5), rng.randrange(5), rng.randrange(4, 9), rng.randrange(4, 9)) for k in range(3)]
        edges = [e for r in [*rings, box(80, 0, 20, 20)] for e in r] + [(q, p) for p, q in box(85, 5, 1, 1)]
        rng.shuffle(edges)
        quick = planar.traces(edges), planar.polygons(edges)
        assert planar._cycles(edges) == quick[0] and planar._cycles([*edges, rings[0][0]]) is None
        with monkeypatch.context() as m:
            m.setattr(planar, "_cycles", lambda edges: None)
            assert (planar.traces(edges), planar.polygons(edges)) == quick


def walls_of(spark, rows):
    return spark.createDataFrame([(d, float(a), float(b), float(c), float(e)) for d, segments in rows for (a, b), (c, e) in segments], "drawing_id long, x0 double, y0 double, x1 double, y1 double")


def test_areas_of_the_mesh_are_the_faces_between_closed_walls(spark):
    rng = random.Random(8)
    rows = [(d, [s for _ in range(6) for s in box(100 * rng.randrange(20), 100 * rng.randrange(20), 100 * rng.randrange(1, 12), 100 * rng.randrange(1, 12))]) for d in range(12)]
    walls = walls_of(spark, rows)
    area = lambda df, p: sorted((r["drawing_id"], round(r["a"]), round(r["l"])) for r in df.select("drawing_id", polygons.area(p).alias("a"), polygons.perimeter(p).alias("l")).collect())
    faces = area(E.room_faces(walls), polygons.parts(F.col("ring"), F.col("holes")))
    assert area(M.enclosed_areas(walls), F.col("polygon")) == faces and len(faces) > 60


def test_areas_leak_through_gaps(spark):
    room = box(0, 0, 4000, 4000)
    gap = [((0, 0), (4000, 0)), ((4000, 0), (4000, 4000)), ((4000, 4000), (0, 4000)), ((0, 4000), (0, 2500)), ((0, 1500), (0, 0))]
    around = box(-3000, -3000, 12000, 12000)
    walls = walls_of(spark, [(1, room), (2, gap), (3, gap + around), (4, [((0, 0), (9, 9))])])
    door = spark.createDataFrame([(3,)], "drawing_id long").select("drawing_id", G.rectangle(F.lit(-100), F.lit(1500), F.lit(100), F.lit(2500)).alias("ring"))
    sized = lambda df: sorted((r["drawing_id"], round(r["a"])) for r in df.select("drawing_id", polygons.area(F.col("polygon")).alias("a")).collect())
    assert sized(M.enclosed_areas(walls)) == [(1, 16_000_000), (3, 144_000_000)]
    assert sized(M.enclosed_areas(walls, door)) == [(1, 16_000_000), (3, 16_000_000), (3, 128_000_000)]
    rooms = E.plausible_rooms(M.candidate_faces(M.enclosed_areas(walls, door))).collect()
    assert sorted((r["drawing_id"], r["room_id"], round(r["area"])) for r in rooms) == [(1, "Space_001", 16_000_000), (3, "Space_001", 128_000_000), (3, "Space_002", 16_000_000)]


def test_repeated_storeys_have_meshes_of_their_own_numbers(spark, monkeypatch):
    plan = [*box(0, 0, 5000, 4000), *box(1000, 1000, 700, 300), ((0, 2000), (900, 2500))]
    walls = walls_of(spark, [(d, plan[::-1] if d % 2 else plan) for d in range(4)] + [(9, box(0, 0, 70, 20))])
    rows = lambda d: sorted(tuple(r)[1:] for r in M.constrained_mesh(walls).where(f"drawing_id = {d}").collect())
    first = rows(0)
    assert len(first) > 10 and first == rows(1) == rows(2) == rows(3) and len(rows(9)) == 2
    monkeypatch.setattr(M, "KNOWN_WALLS", 0)
    assert rows(2) == first


def test_cells_hold_what_no_opening_can_part(spark):
    rng = random.Random(9)
    rows = [(d, [s for _ in range(5) for s in box(500 * rng.randrange(20), 500 * rng.randrange(20), 500 * rng.randrange(1, 9), 500 * rng.randrange(1, 9))]) for d in range(5)]
    rows.append((5, box(0, 0, 60000, 4000) + [s for i in range(70) for s in (((800 * i, 4000), (800 * i, 2600)), ((800 * i, 1600), (800 * i, 0)))]))
    doors = [(d, float(x), float(y), float(x + w), float(y + h)) for d in range(5) for x, y, w, h in ([500 * rng.randrange(24), 500 * rng.randrange(24), *rng.choice([(200, 900), (900, 200), (1500, 1500)])] for _ in range(9))]
    doors += [(5, 800.0 * i - 100, 1600.0, 800.0 * i + 100, 2600.0) for i in range(70)]
    doors = spark.createDataFrame(doors, "drawing_id long, x0 double, y0 double, x1 double, y1 double").select("drawing_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    walls = walls_of(spark, rows)
    cells = M.constrained_mesh(walls, doors)
    sizes = cells.select("drawing_id", "tri", M.triangle_area().alias("a")).join(M.mesh_rings(cells).select("drawing_id", "tri", G.area(F.col("ring")).alias("b")), ["drawing_id", "tri"]).collect()
    assert sizes and all(r["a"] == pytest.approx(r["b"]) and r["a"] > 0 for r in sizes)
    mesh = cells.toPandas()
    triangles = {(r["drawing_id"], r["tri"]): r for r in mesh.to_dict("records")}
    corner = lambda r, i: (r[f"x{i % 3}"], r[f"y{i % 3}"])
    behind = {(r["drawing_id"], corner(r, i), corner(r, i + 1)): k[1] for k, r in triangles.items() for i in range(3)}
    inner, links, label = [], {}, {}
    for (d, t), r in triangles.items():
        for i in range(3):
            other = behind.get((d, corner(r, i + 1), corner(r, i)))
            assert other == (None if np.isnan(r[f"other{i}"]) else r[f"other{i}"])
            assert other is None or r[f"next{i}"] == triangles[d, other]["cell"]
            if other is not None and not r[f"wall{i}"] and t < other:
                inner.append((d, (t << 31) + other, *(v / M.UNITS for p in (corner(r, i), corner(r, i + 1)) for v in p), bool(r[f"near{i}"])))
            if other is not None and not r[f"wall{i}"] and not r[f"near{i}"]:
                links.setdefault((d, t), []).append((d, other))
    for start in sorted(triangles):
        queue = [] if start in label else [start]
        while queue:
            at = queue.pop()
            if at not in label:
                label[at] = start[1]
                queue += links.get(at, [])
    assert label == {k: r["cell"] for k, r in triangles.items()}
    edges = spark.createDataFrame(inner, "drawing_id long, edge_id long, x0 double, y0 double, x1 double, y1 double, near boolean")
    closed = E.opening_edges(edges, doors).collect()
    assert len(closed) > 64 and all(r["near"] for r in closed) and not all(x[-1] for x in inner)
    # Only sides between cells, and those near openings, go on to the joins by drawing.
    rim = sum(r[f"near{i}"] or np.isnan(r[f"next{i}"]) or r[f"next{i}"] != r["cell"] for r in triangles.values() for i in range(3))
    typed = M.typed_sides(M.constrained_mesh(walls, doors), doors)
    assert typed.count() == rim < 2.5 * len(triangles) and typed.where(F.col("kind") == M.VIRTUAL_BLOCKER).count() == 2 * len(closed)


WKT = [
    ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", 96.0, "same"),
    ("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2)), ((20 0, 21 0, 21 1.5, 20 0)))", 96.75, "same"),
    ("multipolygon(((0 0,1 0,1 1,0 0)))", 0.5, "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
    ("POLYGON Z ((0 0 5, 2 0 5, 2 2 5, 0 2 5, 0 0 5))", 4.0, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"),
    ("<http://www.opengis.net/def/crs/OGC/1.3/CRS84> POLYGON ((0 0, 2 0, 2 2, 0 0))", 2.0, "POLYGON ((0 0, 2 0, 2 2, 0 0))"),
    ("POLYGON EMPTY", 0.0, "same"),
    ("POINT (1 2)", None, None),
    ("POLYGON ((0 0, a 1, 2 2, 0 0))", None, None),
    ("", None, None),
    (None, None, None),
]


def test_texts_keep_holes_and_parts(spark):
    p = polygons.from_wkt(F.col("wkt"))
    rows = spark.createDataFrame([(i, w) for i, (w, *_) in enumerate(WKT)], "i int, wkt string").select("i", polygons.area(p).alias("area"), polygons.to_wkt(p).alias("back")).orderBy("i").collect()
    for (text, area, back), r in zip(WKT, rows, strict=True):
        assert r["area"] == area and r["back"] == (text if back == "same" else back)


def test_measures_of_polygons(spark):
    ring = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    yard = [ring(0, 0, 10, 10), ring(2, 2, 4, 4), ring(20, 0, 5, 5)]
    for other, common, apart in (([ring(3, 3, 1, 1)], 0, 1), ([ring(1, 1, 3, 3)], 5, 0), ([ring(14, 0, 2, 2)], 0, 4), ([ring(-5, -5, 50, 50)], 109, 0), ([ring(-5, -5, 50, 50), ring(1, 1, 6, 6)], 89, 0), (yard, 109, 0)):
        assert K.common_region_area(yard, other) == pytest.approx(common) and K.common_region_area(other, yard) == pytest.approx(common)
        assert K.region_distance(yard, other) == K.region_distance(other, yard) == apart
    assert K.survives_inset(yard[:2], 1.9) and not K.survives_inset([ring(0, 0, 10, 10), ring(2, 2, 6, 6)], 1.5)
    held = spark.sql("select 'MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 6 2, 6 6, 2 6, 2 2)), ((20 0, 25 0, 25 5, 20 5, 20 0)))' AS w").select(polygons.from_wkt(F.col("w")).alias("p"))
    c, big = polygons.centroid(F.col("p")), polygons.largest(F.col("p"))
    none = F.lit(None).cast(polygons.PARTS)
    r = held.select(c["x"].alias("x"), c["y"].alias("y"), F.size(big["holes"]).alias("h"), P.polygon_distance("p", polygons.parts(G.rectangle(*map(F.lit, (3, 3, 4, 4))))).alias("d"), P.polygon_common_area("p", none).alias("n"), polygons.area(none).alias("a")).first()
    assert r["x"] == pytest.approx((100 * 5 - 16 * 4 + 25 * 22.5) / 109) and r["y"] == pytest.approx((100 * 5 - 16 * 4 + 25 * 2.5) / 109)
    assert (r["h"], r["d"], r["n"], r["a"]) == (1, 1.0, None, None)
    for x, y in itertools.product((2, 4, 6), repeat=2):
        assert not held.select(polygons.contains(F.col("p"), F.lit(x), F.lit(y)).alias("c")).first()["c"]
