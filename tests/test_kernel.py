"""Kernel polygons with areas worked out by hand, and invariances."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from floorlens.functions import kernel as K
from floorlens.functions import planar

L = np.array([(0, 0), (4000, 0), (4000, 3200), (2200, 3200), (2200, 5000), (0, 5000)], float)
TRAPEZOID = np.array([(0, 0), (4500, 0), (4500, 2500), (1500, 5000), (0, 5000)], float)
COLUMNS = np.array([(600, 0), (5000, 0), (5000, 3400), (4400, 3400), (4400, 4000), (0, 4000), (0, 600), (600, 600)], float)
Z = np.array([(0, 0), (3500, 0), (3500, 2000), (6500, 2000), (6500, 5000), (3000, 5000), (3000, 3000), (0, 3000)], float)


@pytest.mark.parametrize(("ring", "area", "concave"), [(L, 16_760_000, 1), (TRAPEZOID, 18_750_000, 0), (COLUMNS, 19_280_000, 2), (Z, 20_500_000, 2)])
def test_areas_and_concave_vertices(ring, area, concave):
    assert K.ring_area(ring) == area
    assert len(K.reflex(ring)) == concave
    assert sum(abs(K.ring_area(p)) for p in K.convex_parts(ring)) == pytest.approx(area)
    assert all(not len(K.reflex(K.oriented(p))) for p in K.convex_parts(ring))


def test_hull_and_solidity_of_the_l_room():
    assert K.ring_area(K.hull(L)) == 18_380_000
    assert K.solidity(L) == pytest.approx(0.9119, abs=1e-4)


def test_degenerate_rings():
    assert K.min_rectangle(np.array([(0, 0), (5, 0)], float)) == (0.0, 5.0, 0.0)
    assert K.intersection_area(L, np.array([(0, 0), (1, 1)], float)) == 0
    assert K.iou(L, L) == pytest.approx(1)
    assert K.iou(L, L[::-1]) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(1, 4000), st.integers(1, 4000), st.integers(0, 359))
def test_rectangle_overlap_under_rotation(x, y, w, h, angle):
    a = np.array([(0, 0), (2000, 0), (2000, 1500), (0, 1500)], float)
    b = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    expected = max(0, min(2000, x + w) - x) * max(0, min(1500, y + h) - y)
    t = math.radians(angle)
    turn = np.array([(math.cos(t), math.sin(t)), (-math.sin(t), math.cos(t))])
    assert K.intersection_area(a, b) == pytest.approx(expected, abs=1e-3)
    assert K.intersection_area(a @ turn, b @ turn) == pytest.approx(expected, abs=2)
    assert K.min_rectangle(b @ turn)[0] == pytest.approx(w * h, rel=1e-6)


def test_clear_width_and_insets():
    corridor = np.array([(0, 0), (9000, 0), (9000, 1100), (0, 1100)], float)
    assert K.clear_width(corridor) == 1100
    assert K.clear_width(corridor[:3]) == pytest.approx(K.min_rectangle(corridor[:3])[2])
    assert K.survives_inset(corridor, 540) and not K.survives_inset(corridor, 560)
    assert K.inscribed_radius(corridor)[2] == pytest.approx(550, abs=2)
    side, _, area = K.inscribed_square(np.array([(0, 0), (3000, 0), (3000, 2000), (0, 2000)], float), tolerance=50, step=15, grid=5)
    assert 1900 <= side <= 2000 and area == side**2


def test_shared_boundaries_and_distances():
    a = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    assert K.shared_length(a, a + [10, 4]) == 6
    assert K.shared_length(a, a + [10, 10]) == 0
    assert K.polygon_distance(a, a + [10, 10]) == 0
    assert K.polygon_distance(a, a + [13, 14]) == 5


def test_noding_and_faces():
    square = [((0, 0), (4, 0)), ((4, 0), (4, 4)), ((4, 4), (0, 4)), ((0, 4), (0, 0))]
    cross = [*square, ((2, -1), (2, 5)), ((0, 2), (4, 2)), ((1, 0), (3, 0))]
    faces = planar.faces(K.node_lines(cross))
    assert len(faces) == 4
    assert {K.ring_area(np.array(f, float)) for f, _ in faces} == {4.0} and not any(holes for _, holes in faces)
    assert len(K.node_lines(square)) == 4
    assert K.node_lines([((0, 0), (2, 0)), ((2, 0), (5, 0)), ((1, 0), (3, 0))]) == [((0, 0), (5, 0))]


def test_delaunay_has_empty_circles():
    points = [(0, 0), (7, 1), (3, 6), (9, 8), (1, 9), (5, 3)]
    triangles = planar.Mesh(points).triangles()
    hull = abs(K.ring_area(K.hull(np.array(points))))
    assert sum(abs(K.ring_area(np.array(t, float))) for t in triangles) == pytest.approx(hull)
    for t in triangles:
        x, y, r = K.circumcircle(*t)
        assert all(math.hypot(px - x, py - y) >= r - 1e-9 for px, py in points if (px, py) not in t)


def test_delaunay_covers_flat_hulls():
    points = [(0, 0), (500, 1), (1000, 0), (500, 900), (250, 1), (0, 400)]
    hull = abs(K.ring_area(K.hull(np.array(points))))
    assert sum(abs(K.ring_area(np.array(t, float))) for t in planar.Mesh(points).triangles()) == pytest.approx(hull)
    assert planar.Mesh([(0, 0), (1, 0), (2, 0), (9, 0)]).triangles() == []


def test_batches_of_pairs_are_the_single_ones():
    rng = np.random.default_rng(5)
    box = lambda: (lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float))(*rng.integers(0, 9, 2), *rng.integers(1, 6, 2))
    for make in (box, lambda: rng.integers(0, 9, (4, 2)).astype(float)):
        r = [make() for _ in range(200)]
        s = [box() if i % 2 else rng.integers(0, 12, (4, 2)).astype(float) for i in range(200)]
        line = [rng.integers(0, 12, (2, 2)).astype(float) for _ in range(200)]
        for other in (s, line):
            assert np.allclose(K.polygon_distances(np.stack(r), np.stack(other)), [K.polygon_distance(a, b) for a, b in zip(r, other, strict=True)])
        n, p, q = K.longest_chords(np.stack(s), np.stack(r), 0.1)
        for i in range(200):
            m, a, b = K.longest_chord(s[i], r[i], 0.1)
            assert np.allclose([n[i], *p[i], *q[i]], [m, *a, *b])


def test_settings_and_their_override(tmp_path, monkeypatch):
    from floorlens.settings import Settings

    file = tmp_path / "s.toml"
    file.write_text('flat = 1\n[runtime]\nmode = "SINGLE"\n[paths]\ndrawings = "in/dxf"\nreports = "/tmp/r"\n')
    s = Settings(file)
    assert s.get("runtime", "mode") == "SINGLE" and s.get("flat", "x", 2) == 2 and s.get("absent", "x") is None
    assert s.path("paths", "drawings") == tmp_path.resolve() / "in/dxf" and str(s.path("paths", "reports")) == "/tmp/r" and s.path("paths", "absent") is None
    monkeypatch.setenv("FLOORLENS_RUNTIME_MODE", "BATCH")
    assert s.get("runtime", "mode") == "BATCH"
    monkeypatch.setenv("FLOORLENS_RUNTIME_MODE", "")
    assert s.get("runtime", "mode") == "SINGLE"
    (tmp_path / "s.json").write_text('{"runtime": {"mode": "ALL"}}')
    assert Settings(tmp_path / "s.json").get("runtime", "mode") == "ALL"
    with pytest.raises(FileNotFoundError):
        Settings(tmp_path / "none.toml")


def test_whole_crossings_stay_integers():
    lattice = [((0, y), (40, y)) for y in (0, 20, 40)] + [((x, 0), (x, 40)) for x in (0, 20, 40)]
    noded = K.node_lines(lattice)
    assert len(noded) == 12 and all(type(v) is int for s in noded for p in s for v in p)
    assert K.node_lines([((0, 0), (1, 1)), ((0, 1), (1, 0))])[0][1] == (0.5, 0.5)


def test_many_polygons_share_and_stand_apart_as_one_by_one():
    rng = np.random.default_rng(7)
    sizes, others = (4, 3), (5,)

    def rings(kind):
        out = []
        for k in kind:
            turn = np.sort(rng.random(k) * 2 * math.pi)
            out.append(np.round((np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(2, 20, (k, 1)) + rng.random(2) * 30) / 2) * 2)
        return out

    one, two = [rings(sizes) for _ in range(200)], [rings(others) for _ in range(200)]
    r, s = np.stack([np.concatenate(x) for x in one]), np.stack([np.concatenate(x) for x in two])
    assert K.common_region_areas(r, sizes, s, others) == pytest.approx([K.common_region_area(a, b) for a, b in zip(one, two, strict=True)])
    assert K.region_distances(r, sizes, s, others) == pytest.approx([K.region_distance(a, b) for a, b in zip(one, two, strict=True)])


def test_shared_lengths_and_widths_of_many_rings_are_those_of_each():
    rng = np.random.default_rng(7)
    for k, m in ((4, 4), (4, 6), (6, 6), (3, 5)):
        r, s = (rng.integers(0, 5, (60, n, 2)).astype(float) for n in (k, m))
        if k == 4:
            low, high = r.min(axis=1), r.max(axis=1)
            r[:30] = np.stack([low, np.column_stack([high[:, 0], low[:, 1]]), high, np.column_stack([low[:, 0], high[:, 1]])], axis=1)[:30]
        for tolerance in (0.0, 1.0):
            assert K.shared_lengths(r, s, tolerance) == pytest.approx([K.shared_length(a, b, tolerance) for a, b in zip(r, s, strict=True)])
        assert K.clear_widths(r) == pytest.approx([K.clear_width(x) for x in r])
        assert K.min_rectangles(r) == pytest.approx(np.array([K.min_rectangle(x) for x in r]))
    assert K.shared_lengths(L[None], (L + [4000, 0])[None], 1.0) == [3200.0]


def test_rings_that_repeat_are_mended_once_a_batch(monkeypatch):
    import pandas as pd

    from floorlens.functions import planar
    from floorlens.operators import topology

    calls = []
    real = planar.mended
    monkeypatch.setattr(planar, "mended", lambda ring: calls.append(ring) or real(ring))
    crossed, flat = np.array([0, 0, 4, 4, 4, 0, 0, 4], float), np.array([0, 0, 4, 0, 2, 0], float)
    found = topology._mended(pd.Series([crossed, flat, None, crossed, flat, crossed]))
    assert len(calls) == 2
    assert found[2] is None and found[1] == [] and found[0] == found[3] == found[5]
    assert len(found[0]) == 1
