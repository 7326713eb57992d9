"""Scores against annotated rooms: overlaps, matching by its passes, labels."""

import random

import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as G
from floorlens.functions import kernel as K
from floorlens.operators import evaluate as V
from floorlens.operators.topology import as_points
from floorlens.plans import catalogue

ROOM = "drawing_id long, room_id string, ord long, ring array<struct<x: double, y: double>>, types array<string>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def some_rooms(tag, seed):
    draw = random.Random(seed)
    rows = []
    for d in range(30):
        for k in range(9):
            x, y = 100 * (k % 3) + draw.choice((-30, 0, 0, 10, 60)), 100 * (k // 3) + draw.choice((0, 0, 20))
            w, h = draw.choice((50, 100, 100, 200)), draw.choice((50, 100, 100))
            rows.append((d, f"{tag}{k}", k, box(x, y, x + w, y + h), draw.choice((["Bedroom"], ["Kitchen"], ["Corridor", "Kitchen"], []))))
    return rows


def passes(gt, pairs):
    """The three passes of match_rooms on one drawing, room by room."""
    of = {}
    cover = [p for p in pairs if p["both"] > 0.8 * p["gt_area"]]
    many = [p for p in cover if sum(q["sys_id"] == p["sys_id"] for q in cover) >= 2]
    for p in sorted(many, key=lambda p: p["sys_ord"]):
        of[p["gt_id"]] = ("under", p["sys_id"])
    used = {p["sys_id"] for p in many}
    rest = [p for p in pairs if p["gt_id"] not in of and p["sys_id"] not in used]
    parts = [p for p in rest if p["both"] > 0.8 * p["sys_area"]]
    over = {p["gt_id"] for p in parts if len([q for q in parts if q["gt_id"] == p["gt_id"]]) >= 2 and sum(q["both"] for q in parts if q["gt_id"] == p["gt_id"]) > 0.5 * p["gt_area"]}
    of |= {g: ("over", None) for g in over}
    used |= {p["sys_id"] for p in parts if p["gt_id"] in over}
    iou = lambda p: p["both"] / (p["gt_area"] + p["sys_area"] - p["both"])
    rest = [p for p in rest if p["gt_id"] not in of and p["sys_id"] not in used and iou(p) > 0.5]
    best = {g: min((p for p in rest if p["gt_id"] == g), key=lambda p: (-iou(p), p["sys_ord"])) for g in {p["gt_id"] for p in rest}}
    for s in {p["sys_id"] for p in best.values()}:
        first = min((p for p in best.values() if p["sys_id"] == s), key=lambda p: p["gt_ord"])
        of[first["gt_id"]] = ("matched", s)
    return {g: of.get(g, ("missed", None)) for g in gt}


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(some_rooms("g", 1), ROOM), spark.createDataFrame(some_rooms("s", 2), ROOM)


def test_boxes_are_measured_without_python(sides, monkeypatch):
    monkeypatch.setattr(V, "common_area", lambda a, b: F.raise_error(F.lit("a pair of boxes went to Python")).cast("double"))
    gt, sys = sides
    got = {(r["drawing_id"], r["gt_id"], r["sys_id"]): (r["both"], r["gt_area"], r["sys_area"]) for r in V.overlaps(gt, sys).collect()}
    expected = {}
    for g in gt.collect():
        for s in sys.collect():
            a, b = as_points(g["ring"]), as_points(s["ring"])
            if g["drawing_id"] == s["drawing_id"] and (both := K.intersection_area(a, b)) > 0:
                expected[g["drawing_id"], g["room_id"], s["room_id"]] = (both, abs(K.ring_area(a)), abs(K.ring_area(b)))
    assert got == expected


def test_overlaps_of_boxes_and_other_rings(spark):
    rings = {"box": box(0, 0, 4, 4), "back": box(1, 1, 3, 5)[::-1], "l": [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], "turned": [(2, 0), (4, 2), (2, 4), (0, 2)], "beside": box(4, 0, 8, 4), "flat": box(1, 1, 1, 3), "none": []}
    rows = [(1, k, i, [tuple(map(float, p)) for p in r], []) for i, (k, r) in enumerate(rings.items())]
    rooms = spark.createDataFrame([*rows, (1, "null", 9, None, [])], ROOM)
    got = {(r["gt_id"], r["sys_id"]): r for r in V.overlaps(rooms, rooms).collect()}
    solid = [k for k in rings if k not in ("flat", "none")]
    areas = {k: abs(K.ring_area(K.oriented(rings[k]))) for k in solid}
    both = {(a, b): K.intersection_area(K.oriented(rings[a]), K.oriented(rings[b])) for a in solid for b in solid}
    assert {k: r["both"] for k, r in got.items()} == pytest.approx({k: v for k, v in both.items() if v > 0})
    assert both["l", "turned"] > 0 and both["box", "beside"] == 0
    assert all((r["gt_area"], r["sys_area"]) == pytest.approx((areas[a], areas[b])) for (a, b), r in got.items())


def test_only_rectangles_are_boxes(spark):
    rings = [box(0, 0, 2, 3), box(0, 0, 2, 3)[1:] + box(0, 0, 2, 3)[:1], [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (1.0, 3.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], []]
    held = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, ring array<struct<x: double, y: double>>")
    got = [r["b"] and tuple(r["b"]) for r in held.select("i", G.as_box(F.col("ring")).alias("b")).orderBy("i").collect()]
    assert got == [(0, 0, 2, 3), (0, 0, 2, 3), None, None, None]


def test_rooms_are_matched_by_passes_that_read_the_pairs_once(spark, sides, tmp_path):
    gt, sys = sides
    V.overlaps(gt, sys).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    matched = V.match_rooms(gt, pairs)
    assert matched._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["drawing_id"], r["gt_id"]): (r["status"], r["sys_id"]) for r in matched.collect()}
    held, expected = [r.asDict() for r in pairs.collect()], {}
    for d in range(30):
        found = passes([f"g{k}" for k in range(9)], [p for p in held if p["drawing_id"] == d])
        expected |= {(d, g): v for g, v in found.items()}
    assert got == expected
    assert {status for status, _ in got.values()} == {"under", "over", "matched", "missed"}


def test_labels_of_kept_types_are_those_looked_up(spark, sides):
    gt, sys = sides
    edges = spark.createDataFrame([(d, "s0", f"s{1 + d % 8}") for d in range(30)], "drawing_id long, u string, v string")
    pairs = V.overlaps(gt, sys)
    kept, plain = (sorted(map(tuple, V.label_rows(V.match_rooms(gt, pairs, *keep), gt, sys, edges).collect()), key=str) for keep in (["types"], []))
    assert kept == plain and len(kept) == 270
    assert {r[4] for r in kept} == {None, "geometry miss", "topology breakage", "label error"}


@pytest.mark.parametrize("name", ["label_scores", "label_rates", "label_dashboard", "error_cascade", "label_macro"])
def test_label_queries_send_no_boxes_to_python(spark, monkeypatch, name):
    monkeypatch.setattr(V, "common_area", lambda a, b: F.raise_error(F.lit("a pair of boxes went to Python")).cast("double"))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
