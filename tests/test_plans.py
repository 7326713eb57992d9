"""Every registered query against its oracle in DuckDB, on the smallest tables; sources; streams."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as G
from floorlens.operators import elements as E
from floorlens.operators import enrich, graph, rules, topology
from floorlens.plans import catalogue
from floorlens.sources import dxf, jsonld, svg
from floorlens.streaming.drawings import process_folder

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows
    if name not in catalogue.ORACLES:
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_components_and_hops_of_a_path(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcde"], "drawing_id long, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "d", "e")], "drawing_id long, u string, v string")
    assert {(r["node"], r["component"]) for r in graph.components(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    seeds = nodes.where("node = 'a'")
    assert {(r["node"], r["hops"]) for r in graph.hops(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"] for r in graph.hops(edges, seeds, most=1).collect()} == {"a", "b"}


def test_paths_of_any_length(spark):
    names = [f"n{i:03}" for i in range(101)]
    rows = [(1, a, b) for a, b in zip(names, names[1:], strict=False)] + [(2, "a", "c"), (2, "d", "b"), (2, "b", "a"), (2, "c", "d"), (2, "x", "y")]
    edges = spark.createDataFrame(rows, "drawing_id long, u string, v string")
    pairs = spark.createDataFrame([(1, names[0], names[-1]), (1, names[5], names[5]), (2, "a", "d"), (2, "d", "a"), (2, "a", "x"), (3, "p", "p"), (3, "p", "q")], "drawing_id long, src string, dst string")
    got = {tuple(r)[:3]: r["path"] for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {(1, names[0], names[-1]): names, (1, names[5], names[5]): [names[5]], (2, "a", "d"): ["a", "b", "d"], (2, "d", "a"): ["d", "b", "a"], (2, "a", "x"): None, (3, "p", "p"): ["p"], (3, "p", "q"): None}
    assert graph.within(edges, pairs, 99).count() == 2 and graph.within(edges, pairs, 100).count() == 3


def test_paths_to_all_rooms_are_as_long_as_the_hops(spark):
    from floorlens.plans import derived as D

    rooms, edges = D.rooms(spark, SF), graph.undirected(D.grid_edges(spark, SF))
    pairs = rooms.select("drawing_id", F.lit("Space_000").alias("src"), F.col("room_id").alias("dst"))
    far = graph.hops(edges, rooms.where("ord = 0").select("drawing_id", F.lit("Space_000").alias("node")))
    both = graph.shortest_paths(edges, pairs).withColumnRenamed("dst", "node").join(far, ["drawing_id", "node"], "left")
    assert both.count() == rooms.count() and both.where("path is not null").count() > 0
    assert both.where("not (size(path) - 1 <=> hops) and not (path is null and hops is null)").count() == 0


def test_absent_values_conform(spark):
    nodes = spark.createDataFrame([(1, "x", ["Bedroom"], None), (1, "y", ["Bedroom"], 11.9), (1, "z", ["Bedroom"], 12.0)], "drawing_id long, node_id string, types array<string>, area_m2 double")
    chosen = [r for r in rules.RULES if r[0] in ("R11", "R23")]
    found = {(r["node_id"], r["rule_id"]) for r in rules.violations(nodes, None, rules=chosen).collect()}
    assert found == {("y", "R11"), ("y", "R23"), ("z", "R23")}


def test_covered_length_of_walls():
    import numpy as np

    wall = np.array([(0, 0), (100, 0)], float)
    assert E.covered_length(np.array([(10, 0.05), (30, 0.05)], float), wall, 0.1) == pytest.approx(20)
    assert E.covered_length(np.array([(10, 0.2), (30, 0.2)], float), wall, 0.1) == 0
    assert E.covered_length(np.array([(50, -5), (50, 5)], float), wall, 0.1) == pytest.approx(0.2)


def test_svg_scan(spark, tmp_path):
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g id="a"><circle cx="5" cy="5" r="2"/><path d="M 0 0 L 10 0 h 5 a 1 1 0 0 1 2 0"/><text x="1" y="2">卧室</text></g></svg>'
    (tmp_path / "one.svg").write_text(text, encoding="utf-8")
    rows = svg.coords_of(svg.read_primitives(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["tag"] for r in rows] == ["path", "circle"]
    assert len(rows[0]["coords"]) == 3 + 20 and len(rows[1]["coords"]) == 20
    assert svg.read_texts(spark, str(tmp_path)).first()["text"] == "卧室"


def test_dxf_scan(spark, tmp_path):
    pairs = [("0", "SECTION"), ("2", "ENTITIES"), ("0", "LWPOLYLINE"), ("8", "gt_bedroom"), ("70", "1")]
    for x, y in ((0, 0), (1000, 0), (1000, 500), (0, 500)):
        pairs += [("10", str(x)), ("20", str(y))]
    pairs += [("0", "LINE"), ("8", "0"), ("10", "0"), ("20", "0"), ("11", "5"), ("21", "5"), ("0", "ENDSEC"), ("0", "EOF")]
    (tmp_path / "p.dxf").write_text("\n".join(x for p in pairs for x in p))
    entities = dxf.read_entities(spark, str(tmp_path))
    room = dxf.annotated(entities).first()
    assert (room["thing"], room["type"], len(room["ring"])) == ("room", "Bedroom", 4)
    assert dxf.fit_scale(entities).first()["scale"] == pytest.approx(0.14)


def dxf_text(*records):
    return "\n".join(str(x) for r in records for pair in r for x in pair) + "\n"


def test_dxf_blocks_curves_and_visibility():
    line = [(0, "LINE"), (8, "0"), (10, 0), (20, 0), (11, 10), (21, 0)]
    insert = [(0, "INSERT"), (2, "B"), (8, "doors"), (10, 100), (20, 50), (41, 2), (42, 2), (50, 90)]
    text = dxf_text(
        [(0, "SECTION"), (2, "TABLES")], [(0, "LAYER"), (2, "off"), (62, -7)], [(0, "LAYER"), (2, "frozen"), (62, 7), (70, 1)], [(0, "ENDSEC")],
        [(0, "SECTION"), (2, "BLOCKS")], [(0, "BLOCK"), (2, "B"), (10, 0), (20, 0)], line, [(0, "CIRCLE"), (8, "x"), (10, 1), (20, 0), (40, 3)], [(0, "INSERT"), (2, "B"), (10, 0), (20, 0)], [(0, "ENDBLK")], [(0, "ENDSEC")],
        [(0, "SECTION"), (2, "ENTITIES")], insert, [(0, "LINE"), (8, "off"), (10, 0), (20, 0), (11, 1), (21, 1)], [(0, "LINE"), (8, "frozen"), (10, 0), (20, 0), (11, 1), (21, 1)],
        [(0, "LINE"), (8, "0"), (60, 1), (10, 0), (20, 0), (11, 1), (21, 1)],
        [(0, "ARC"), (8, "a"), (10, 0), (20, 0), (40, 2), (50, 0), (51, 90)], [(0, "ELLIPSE"), (8, "a"), (10, 0), (20, 0), (11, 4), (21, 0), (40, 0.5)],
        [(0, "SPLINE"), (8, "a"), (71, 2), *((40, k) for k in (0, 0, 0, 1, 1, 1)), (10, 0), (20, 0), (10, 1), (20, 2), (10, 2), (20, 0)],
        [(0, "INSERT"), (2, "absent"), (10, 0), (20, 0)], [(0, "ENDSEC")], [(0, "EOF")],
    )
    found = dxf.entities_of(text)
    assert [(k, layer) for k, layer, *_ in found] == [("LINE", "doors"), ("CIRCLE", "doors"), ("ARC", "a"), ("ELLIPSE", "a"), ("SPLINE", "a")]
    assert [p for q in found[0][4] for p in q] == pytest.approx([100, 50, 100, 70])
    assert found[1][3] == 6 and found[1][4][0] == pytest.approx((100, 52))
    assert found[2][4][0] == pytest.approx((2, 0)) and found[2][4][-1] == pytest.approx((0, 2))
    assert found[3][4][0] == pytest.approx((4, 0)) and max(y for _, y in found[3][4]) == pytest.approx(2, abs=0.02)
    # A spline of degree 2 without inner knots is a parabola: (2t, 4t(1 - t)).
    assert all(y == pytest.approx(2 * x * (1 - x / 2)) for x, y in found[4][4]) and found[4][4][-1] == pytest.approx((2, 0))
    assert dxf.entities_of("") == [] and dxf.entities_of("0\nEOF") == []


def test_dxf_bulges_and_weights():
    text = dxf_text(
        [(0, "SECTION"), (2, "ENTITIES")],
        [(0, "LWPOLYLINE"), (8, "a"), (70, 1), (10, 0), (20, 0), (10, 4), (20, 0), (42, 1), (10, 4), (20, 2), (10, 0), (20, 2)],
        [(0, "LWPOLYLINE"), (8, "a"), (10, 0), (20, 0), (42, -(2**0.5 - 1)), (10, 1), (20, 1)],
        [(0, "SPLINE"), (8, "a"), (71, 2), *((40, k) for k in (0, 0, 0, 1, 1, 1)), (41, 1), (41, 2**-0.5), (41, 1), (10, 1), (20, 0), (10, 1), (20, 1), (10, 0), (20, 1)],
        [(0, "ENDSEC")],
    )
    box, quarter, circle = (points for *_, points in dxf.entities_of(text))
    # A half circle to the right of the box, a quarter circle around (1, 0), one around (0, 0).
    assert len(box) == 4 + 1 + dxf.CURVE_POINTS - 2 and box[0] == box[-1] and max(x for x, _ in box) == pytest.approx(5, abs=0.01)
    assert all((x - 4) ** 2 + (y - 1) ** 2 == pytest.approx(1) for x, y in box[1 : 1 + dxf.CURVE_POINTS])
    assert all((x - 1) ** 2 + y**2 == pytest.approx(1) for x, y in quarter) and quarter[-1] == (1, 1)
    assert all(x**2 + y**2 == pytest.approx(1) for x, y in circle) and circle[-1] == pytest.approx((0, 1))


def test_rooms_of_svg(spark, tmp_path):
    rooms = spark.sql("select 1L drawing_id, 'Space_001' room_id, 1 ord, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4000D, 'y', 0D), named_struct('x', 4000D, 'y', 3000D)) ring")
    (tmp_path / "p.svg").write_text(svg.room_svgs(rooms, 0.01).first()["svg"])
    back = svg.rooms_of(svg.read_primitives(spark, str(tmp_path)), 0.01).first()
    assert (back["drawing"], back["room_id"], [tuple(p) for p in back["ring"]]) == ("p", "Space_001", [(0, 0), (4000, 0), (4000, 3000)])


def test_plain_truth(spark, tmp_path):
    text = '{"rooms":{"A":{"wkt":"POLYGON ((0 0, 1 0, 1 1, 0 0))","area":0.5,"semantic_type":"Kitchen"}},"adjacencies":[["B","A"],["A","B"],["A"]],"violations":[{"node_id":"A","rule":"R13"}]}'
    (tmp_path / "g.json").write_text(text)
    rooms, pairs, broken = jsonld.read_plain_truth(spark, str(tmp_path))
    assert [(r["room_id"], len(r["ring"]), r["area_m2"], r["short_side_m"], r["semantic_type"]) for r in rooms.collect()] == [("A", 3, 0.5, None, "Kitchen")]
    assert [tuple(r) for r in pairs.collect()] == [("g", "A", "B")] and [tuple(r) for r in broken.collect()] == [("g", "A", "R13")]


def test_jsonld_forms(spark, tmp_path):
    text = '{"@graph":[{"@id":"a","@type":"bot:Space","geo:asWKT":{"@value":"POLYGON ((0 0, 4 0, 4 4, 0 0))"},"bot:adjacentZone":[{"@id":"b"}]},{"@id":"b","@type":["bot:Space","bldg:Kitchen"],"geo:asWKT":"POLYGON ((0 0, 1 0, 1 1, 0 0))","bot:adjacentZone":{"@id":"a"}}]}'
    (tmp_path / "d.jsonld").write_text(text)
    nodes, edges = jsonld.read_graphs(spark, str(tmp_path))
    assert {(r["node_id"], tuple(r["types"]), len(r["ring"])) for r in nodes.collect()} == {("a", ("bot:Space",), 3), ("b", ("bot:Space", "bldg:Kitchen"), 3)}
    assert {(r["src"], r["pred"], r["dst"]) for r in edges.collect()} == {("a", "adjacentZone", "b"), ("b", "adjacentZone", "a")}


def test_stream_of_drawings(spark, tmp_path):
    rooms = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 3.0)], "drawing_id long, x double")
    rooms.write.parquet(str(tmp_path / "in"))
    plan = lambda df: df.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))
    q = process_folder(spark, str(tmp_path / "in"), "drawing_id long, x double", plan, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert {(r["drawing_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (2, 1)}


def test_ring_columns(spark):
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D)) r")
    r = F.col("r")
    row = df.select(G.area(r), G.perimeter(r), G.contains(r, F.lit(1.0), F.lit(1.0)), G.contains(r, F.lit(0.0), F.lit(1.0)), G.distance_to_ring(r, F.lit(7.0), F.lit(7.0)), G.to_wkt(r)).first()
    assert tuple(row) == (12.0, 14.0, True, False, 5.0, "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))")


def test_texts_without_a_mapping_take_the_default_one(spark):
    texts = spark.createDataFrame([(1, "次卧"), (2, "主卫"), (3, "x"), (4, "餐客厅")], "ord int, text string")
    assert [(r["ord"], r["std_label"]) for r in enrich.type_texts(texts).orderBy("ord").collect()] == [(1, "Bedroom"), (2, "Bathroom"), (4, "LivingRoom")]


def test_entry_registers_every_oracle():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


def test_rooms_are_cut_once_and_by_all_tasks(spark):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    ring = F.array(p(0, 0), p(4, 0), p(4, 2), p(2, 2), p(2, 4), p(0, 4))
    rooms = spark.range(100, numPartitions=1).select(F.col("id").alias("drawing_id"), F.lit("A").alias("room_id"), ring.alias("ring"), F.array(F.lit("Bedroom"), F.lit("LivingRoom")).alias("types"), F.array().cast("array<struct<text_ord:int,raw_text:string,std_label:string,x:double,y:double>>").alias("anchors"))
    parts = enrich.decompose(rooms)
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("parts(") == 1
    assert parts.select(F.spark_partition_id()).distinct().count() > 1
    assert parts.count() == 200


def test_rows_of_divided_drawings_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rooms, parts = catalogue.l_parts(spark, SF)
    for joined in (catalogue.divided_graph(spark, SF), enrich.replace_rooms(rooms, parts), topology.touching_rooms(parts.drop("room_id").withColumnRenamed("sub_id", "room_id"))):
        assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)


def test_lambda_functions_work_a_value_out_once(spark):
    from floorlens.functions import polygons

    # As each was named inside another, a ring's points were read some thirty times, and a matrix six times a point.
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    body = polygons.from_wkt(F.col("t")).alias("p")
    plan = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0))", "scale(2) translate(1,2)")], "t string, m string")
    assert text(plan.select(body)).count("split(") == 4
    line = F.array(*(G.point(F.lit(i), F.lit(i)) for i in range(3)))
    moved = plan.select(G.affine(line, G.transform_matrix(F.col("m"))).alias("p"))
    assert text(moved).count("rotate") == 1
    assert [tuple(p) for p in moved.first()["p"]] == [(2.0, 4.0), (4.0, 6.0), (6.0, 8.0)]


def test_covered_lengths_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(5)
    for k, m in ((2, 2), (3, 2), (3, 4)):
        line, wall = (rng.integers(0, 5, (80, n, 2)) / 10 for n in (k, m))
        assert E.covered_lengths(line, wall, 0.1) == pytest.approx([E.covered_length(a, b, 0.1) for a, b in zip(line, wall, strict=True)])
    line = np.array([[(0, 0), (10, 0)], [(0, 0), (0, 0)], [(0, 5), (10, 5)]], float)
    wall = np.array([[(4, 0), (20, 0)], [(0, 0), (9, 0)], [(3, 0), (3, 9)]], float)
    assert E.covered_lengths(line, wall, 0.1) == pytest.approx([6.1, 0, 0.2])


def test_rings_without_points_measure_nothing(spark):
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, []), (3, None)], f"id int, ring {G.RING}")
    found = rings.select("id", E.rectangle_of("ring").alias("m"), E.clear_width("ring").alias("w")).orderBy("id").collect()
    assert [(r["m"]["area"], r["m"]["long"], r["m"]["short"], r["w"]) for r in found] == [(12.0, 4.0, 3.0, 3.0), (0.0, 0.0, 0.0, 0.0), (None, None, None, None)]
