"""Drawing files as data sources, colours and texts of entities, rule files, prediction files, streams of pieces."""

import pickle
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlens.functions import text as T
from floorlens.functions.vocab import EXTERIOR_ID
from floorlens.operators import division, rules, shapes
from floorlens.sources import colours, dxf, files, jsonld, predictions, svg, turtle
from floorlens.streaming import drawings
from floorlens.streaming.drawings import process_pieces, whole_drawings


def dxf_text(*records):
    return "\n".join(str(x) for r in records for pair in r for x in pair) + "\n"


LINE = [(10, 0), (20, 0), (11, 5), (21, 5)]


def test_colours_come_from_entities_blocks_and_layers():
    text = dxf_text(
        [(0, "SECTION"), (2, "TABLES")], [(0, "LAYER"), (2, "red"), (62, 1)], [(0, "LAYER"), (2, "odd"), (62, 23)], [(0, "ENDSEC")],
        [(0, "SECTION"), (2, "BLOCKS")], [(0, "BLOCK"), (2, "B"), (10, 0), (20, 0)], [(0, "LINE"), (8, "odd"), (62, 0), *LINE], [(0, "LINE"), (8, "odd"), *LINE], [(0, "LINE"), (8, "odd"), (62, 3), *LINE], [(0, "ENDBLK")], [(0, "ENDSEC")],
        [(0, "SECTION"), (2, "ENTITIES")], [(0, "LINE"), (8, "odd"), *LINE], [(0, "LINE"), (8, "odd"), (62, 256), *LINE], [(0, "LINE"), (8, "odd"), (62, 5), (420, 0x0A141E), *LINE], [(0, "LINE"), (8, "none"), *LINE],
        [(0, "INSERT"), (2, "B"), (8, "red"), (10, 0), (20, 0)], [(0, "ENDSEC")],
    )
    # By layer, by layer, true colour, an unknown layer; then what a block holds: by block, by layer, by index.
    assert [e.colour for e in dxf.drawn_entities(text)] == [(165, 103, 82), (165, 103, 82), (10, 20, 30), (255, 255, 255), (255, 0, 0), (255, 0, 0), (0, 255, 0)]
    assert [colours.palette(i) for i in (10, 11, 50, 90, 130, 170, 249, 255)] == [(255, 0, 0), (255, 127, 127), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (38, 19, 24), (255, 255, 255)]


@pytest.mark.parametrize("kind", sorted(dxf.HOLDERS))
def test_holders_stand_for_their_blocks(kind):
    text = dxf_text(
        [(0, "SECTION"), (2, "BLOCKS")], [(0, "BLOCK"), (2, "*D1"), (10, 0), (20, 0)], [(0, "LINE"), (8, "0"), *LINE], [(0, "ENDBLK")], [(0, "ENDSEC")],
        [(0, "SECTION"), (2, "ENTITIES")], [(0, kind), (2, "*D1"), (8, "dims"), (10, 7), (20, 0)], [(0, "ENDSEC")],
    )
    (line,) = dxf.drawn_entities(text)
    # An insertion moves its block; a dimension's block stands where it is.
    assert (line.kind, line.layer, line.points[0]) == ("LINE", "dims", (7, 0) if kind == "INSERT" else (0, 0))


def test_shown_colours_go_by_luminance(spark):
    rows = [(255, 255, 255, 0, 0, 0), (255, 255, 0, 127, 127, 0), (255, 0, 255, 255, 0, 255), (0, 255, 255, 0, 255, 255), (200, 200, 200, 200, 200, 200), (201, 201, 201, 100, 100, 100), (10, 255, 200, 10, 255, 200), (90, 255, 240, 45, 127, 120)]
    c = T.shown_colour(F.col("r"), F.col("g"), F.col("b"))
    for r in spark.createDataFrame(rows, "r int, g int, b int, x int, y int, z int").select(c.alias("c"), "x", "y", "z", "r", "g", "b").collect():
        bright = 0.299 * r["r"] + 0.587 * r["g"] + 0.114 * r["b"] > 200
        assert tuple(r["c"]) == ((0, 0, 0) if r["r"] == r["g"] == r["b"] == 255 else tuple(v // 2 if bright else v for v in (r["r"], r["g"], r["b"])))


def test_texts_are_whole_and_without_codes():
    long = "x" * 250
    text = dxf_text(
        [(0, "SECTION"), (2, "ENTITIES")],
        [(0, "MTEXT"), (8, "a"), (10, 1), (20, 2), (3, r"{\fArial|b0|i0;" + long), (3, r" and \P"), (1, r"\H2.5x;5\S1^2; \\ \{x\}}")],
        [(0, "TEXT"), (8, "a"), (10, 1), (20, 2), (1, "45%%d %%uunder%%u %%c10 %%p1 100%%% %%065")],
        [(0, "TEXT"), (8, "a"), (10, 1), (20, 2)], [(0, "ENDSEC")],
    )
    assert [e.text for e in dxf.drawn_entities(text)] == [long + " and \n51/2 \\ {x}", "45° under ⌀10 ±1 100% A", None]


@pytest.fixture
def folder(spark, tmp_path):
    files.register(spark)
    for name, layer in (("one", "walls"), ("two", "doors")):
        text = dxf_text([(0, "SECTION"), (2, "ENTITIES")], [(0, "LINE"), (8, layer), *LINE], [(0, "CIRCLE"), (8, "0"), (10, 1), (20, 2), (40, 3)], [(0, "ENDSEC")])
        (tmp_path / f"{name}.dxf").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "other.txt").write_text("0\nLINE\n")
    return tmp_path


def entities(df):
    return sorted((r["drawing"], r["kind"], r["layer"], len(r["coords"])) for r in df.collect())


def test_dxf_folder_as_a_source(spark, folder):
    read = lambda **options: spark.read.format("floorlens_dxf").options(**options).load(str(folder))
    everything = [("one", "CIRCLE", "0", 1), ("one", "LINE", "walls", 2), ("two", "CIRCLE", "0", 1), ("two", "LINE", "doors", 2)]
    assert entities(read()) == entities(dxf.read_entities(spark, str(folder))) == everything
    assert entities(read(groupBytes="1")) == everything and read(groupBytes="1").rdd.getNumPartitions() == 2
    assert entities(read(kinds="LINE")) == [everything[1], everything[3]] and entities(read(layers="doors,0", drawings="two")) == everything[2:]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read(pushdown="true").where("drawing = 'one' AND kind IN ('LINE', 'ARC') AND size(coords) > 1")
        assert entities(pushed) == [everything[1]]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert entities(spark.read.format("floorlens_dxf").load(str(folder / "absent"))) == []


def test_dxf_folder_as_a_stream(spark, folder, tmp_path_factory):
    out, log = (str(tmp_path_factory.mktemp(x) / "x") for x in ("out", "log"))

    def run():
        stream = spark.readStream.format("floorlens_dxf").load(str(folder)).select("drawing", "kind", "layer", "coords")
        stream.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination(120)
        return entities(spark.read.parquet(out))

    assert len(run()) == 4
    time.sleep(0.05)
    (folder / "three.dxf").write_text(dxf_text([(0, "SECTION"), (2, "ENTITIES")], [(0, "LINE"), (8, "new"), *LINE], [(0, "ENDSEC")]))
    assert len(run()) == 5


def test_svg_documents_are_declared_and_read_back(spark, tmp_path):
    files.register(spark)
    rooms = spark.sql("select 1L drawing_id, 'Space_000' room_id, 0 ord, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 400D, 'y', 0D), named_struct('x', 400D, 'y', 300D)) ring")
    documents = svg.room_svgs(rooms, 0.1).select(F.lit("plan").alias("drawing"), F.col("svg").alias("value"))
    documents.write.format("floorlens_documents").option("suffix", ".svg").mode("append").save(str(tmp_path))
    assert (tmp_path / "plan.svg").read_text(encoding="utf-8").startswith('<?xml version="1.0" encoding="UTF-8"?>')
    for found in (spark.read.format("floorlens_svg").load(str(tmp_path)), svg.read_primitives(spark, str(tmp_path))):
        room = svg.rooms_of(found, 0.1).first()
        assert (room["drawing"], room["room_id"], len(room["ring"])) == ("plan", "Space_000", 3)


def test_graphs_keep_holes(spark, tmp_path):
    wkt = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    (tmp_path / "a.jsonld").write_text('{"@graph": [{"@id": "inst:S", "@type": ["bot:Space"], "geo:asWKT": {"@value": "' + wkt + '"}}]}')
    node = jsonld.read_graphs(spark, str(tmp_path))[0].first()
    assert len(node["ring"]) == 4 and len(node["polygon"]) == 1 and len(node["polygon"][0]["holes"]) == 1


def test_graphs_and_tables_are_written(spark, tmp_path):
    documents = spark.createDataFrame([(1, '{"@graph":[{"@id":"inst:é","@type":"bot:Space"}]}'), (2, '{"@graph":[]}')], "drawing_id long, json string")
    jsonld.write_graphs(documents, str(tmp_path / "graphs"))
    (one,) = (tmp_path / "graphs" / "drawing_id=1").glob("part-*")
    assert one.read_text(encoding="utf-8").strip() == documents.where("drawing_id = 1").first()["json"]
    jsonld.write_table_csv(spark.createDataFrame([("客厅", 3)], "label string, n int").coalesce(1), str(tmp_path / "csv"))
    (table,) = (tmp_path / "csv").glob("part-*.csv")
    assert table.read_bytes().startswith(b"\xef\xbb\xbf") and table.read_text(encoding="utf-8-sig").splitlines() == ["label,n", "客厅,3"]


# ------------------------------------------------------------- rule files


def as_turtle(rows):
    """The rows as shapes, in another layout than the given rule files have."""
    out = ["@prefix s: <http://www.w3.org/ns/shacl#> .\n@prefix x: <http://example.org/any/> .\n@prefix r: <http://www.w3.org/2000/01/rdf-schema#> ."]
    path_of = {v: k for k, v in shapes._COLUMNS.items()} | {"door_width_mm": "hasShortSide"}
    bounds = {v: k for k, v in shapes._BOUNDS.items()}
    for rule, _, targets, kind, path, among, threshold in rows:
        names = " , ".join(f"x:{t}" for t in targets)
        if kind in bounds:
            body = f"s:property [ s:{bounds[kind]} {threshold} ; s:path x:{path_of[path]} ; ]"
        elif kind == "min_if":
            out.append(f"x:No{rule} a s:NodeShape ; s:not [ s:class x:{among[0]} ] .")
            body = f"s:or ( x:No{rule} [ s:property [ s:path x:{path_of[path]} ; s:minInclusive {threshold} ] ] )"
        elif kind == "some_type":
            body = f"s:property [ s:path x:{path} ; s:qualifiedValueShape [ s:class x:{among[0]} ] ; s:qualifiedMinCount 1 ; s:message 'm' ]".replace("'", '"')
        elif kind == "some_label":
            listed = " ".join(f'"{a}"' for a in among)
            asked = f"s:in ( {listed} )" if len(among) > 1 else f"s:hasValue {listed}"
            body = f"s:property [ s:path x:{path} ; s:qualifiedMinCount 1 ; s:qualifiedValueShape [ s:property [ {asked} ; s:path r:label ] ] ]"
        else:
            body = f"s:property [ s:path x:{path} ; s:node [ s:not [ s:class x:{among[0]} ] ] ]"
        out.append(f"x:{rule} s:targetClass {names} ; # targets first\n  {body} ;\n  a s:NodeShape .")
    return "\n".join(out)


def test_the_fixed_rules_are_those_of_their_shapes():
    found = shapes.compile_shapes(turtle.statements(as_turtle(rules.RULES)), "any", lambda shape, k: shape if k == 1 else f"{shape}.{k}")
    assert [(*r[:1], *r[2:]) for r in found.rules] == [(*r[:1], *r[2:]) for r in rules.RULES]


def test_a_changed_threshold_changes_the_result(spark):
    nodes = spark.createDataFrame([(1, "a", ["Bedroom"], None, 12.5), (1, "b", ["Bedroom", "LivingRoom"], None, 13.5), (1, "c", ["Bedroom"], None, None)], "drawing_id long, node_id string, types array<string>, label string, area_m2 double")
    found = lambda text: sorted((r["node_id"], r["rule_id"]) for r in rules.violations(nodes, None, rules=shapes.compile_shapes(turtle.statements(text), "x").rules).collect())
    one = as_turtle([("R", "x", ["Bedroom"], "min", "area_m2", [], 12.5)])
    assert found(one) == [] and found(one.replace("12.5", "13.0")) == [("a", "R.1")] and found(one.replace("minInclusive", "minExclusive")) == [("a", "R.1")]
    assert found(one.replace("minInclusive", "maxExclusive")) == [("a", "R.1"), ("b", "R.1")]
    assert found(as_turtle([("R", "x", ["Bedroom"], "min_if", "area_m2", ["LivingRoom"], 20.0)])) == [("b", "R.1")]


def test_counts_and_classes_of_neighbours(spark):
    nodes = spark.createDataFrame([(1, "a", ["Hall"], None), (1, "b", ["Bed"], None), (1, "c", ["Bed", "Den"], None), (1, "d", ["Den"], "sink")], "drawing_id long, node_id string, types array<string>, label string")
    edges = spark.createDataFrame([(1, "a", "near", x) for x in "bcd"] + [(1, "a", "near", "b")], "drawing_id long, src string, pred string, dst string")
    for kind, among, threshold, others in (("some_type", ["Bed"], 2.0, []), ("some_type", ["Bed"], 3.0, [None]), ("few_type", ["Bed"], 2.0, []), ("few_type", ["Bed"], 1.0, [None]), ("few_label", ["sink"], 0.0, [None]), ("none_type", ["Den"], None, ["c", "d"]), ("all_type", ["Bed"], None, ["d"])):
        got = rules.violations(nodes, edges, rules=[("R", "x", ["Hall"], kind, "near", among, threshold)]).collect()
        assert sorted((r["other"] for r in got), key=str) == others, (kind, threshold)
    with pytest.raises(ValueError, match="unknown kinds"):
        rules.violations(nodes, edges, rules=[("R", "x", ["Hall"], "odd", "near", [], None)])


def test_turtle_terms():
    text = '@prefix : <http://e/#> . @prefix p: <http://e/p/> .\n<http://e/s> a :T , p:a.b ; :v 1 , -2.5e1 , .5 , true , "q\\"\\u00e9"@en , """a "b"\nc"""^^<http://www.w3.org/2001/XMLSchema#string> , "7"^^<http://www.w3.org/2001/XMLSchema#integer> ; . # end\n_:x :l ( 1 ( ) [ ] ) .'
    got = turtle.statements(text)
    assert [s.object for s in got] == ["http://e/#T", "http://e/p/a.b", 1.0, -25.0, 0.5, True, 'q"é', 'a "b"\nc', 7.0, (1.0, (), "_:1")]
    assert got[0].predicate == turtle.TYPE and got[0].object.local == "T" and turtle.statements("") == []
    for bad in ("a b", ":a :b :c .", "<x> <y> <z>", "<x> <y> { } .", "<x> <y> [ <z> ."):
        with pytest.raises(ValueError):
            turtle.statements(bad)


@pytest.mark.parametrize("body", ["s:closed true", "s:property [ s:path x:a ; s:pattern \"z\" ]", "s:property [ s:path x:a ]", "s:or ( [ s:not [ s:class x:B ] ] )", "s:property [ s:path x:a ; s:node [ s:not [ s:datatype x:B ] ] ]"])
def test_unknown_constraints_are_errors(body):
    with pytest.raises(ValueError):
        shapes.compile_shapes(turtle.statements(f"@prefix s: <http://www.w3.org/ns/shacl#> . @prefix x: <http://e/> . x:S s:targetClass x:T ; {body} ."), "x")


# --------------------------------------------------------------- settings

YAML = """# a deployment
---
paths:
  in: ./data/in   # relative
  "out dir": 'it''s # here'
limits:
    area: 2.5e6
    steps: 12
    on: true
    off: no
    nothing:
    names: [a, "b, c", 3]
    list:
    - x
    - 'y'
    deep:
      more: "\\u00e9"
last: word of several
"""


def test_yaml_settings(tmp_path, monkeypatch):
    from floorlens.settings import Settings, parse_yaml

    want = {"paths": {"in": "./data/in", "out dir": "it's # here"}, "limits": {"area": 2.5e6, "steps": 12, "on": True, "off": False, "nothing": None, "names": ["a", "b, c", 3], "list": ["x", "y"], "deep": {"more": "é"}}, "last": "word of several"}
    assert parse_yaml(YAML) == want and parse_yaml("") == {} and parse_yaml("# x\n") == {}
    (tmp_path / "s.yaml").write_text(YAML, encoding="utf-8")
    held = Settings(tmp_path / "s.yaml")
    monkeypatch.setenv("FLOORLENS_LIMITS_STEPS", "13")
    assert held.get("limits", "steps") == "13" and held.get("limits", "area") == 2.5e6 and held.path("paths", "in") == tmp_path.resolve() / "data/in" and held.get("last", "x", 5) == 5
    for bad in ("a: &x 1", "a: {b: 1}", "a: |\n  text", "- x", "a: 1\n   b: 2", "just words", "a: 'open"):
        with pytest.raises(ValueError):
            parse_yaml(bad)


# ------------------------------------------------------- prediction files


class Bad:
    def __reduce__(self):
        return print, ("run",)


def test_predictions_let_in_plain_values_only(spark, tmp_path):
    mask = np.array([True, False, True])
    plain = [{"masks": mask, "labels": np.int64(3), "scores": np.float32(0.5)}, {"masks": [0, 1, 1], "labels": 4}]
    for protocol in range(2, pickle.HIGHEST_PROTOCOL + 1):
        assert predictions.instances_of(pickle.dumps(plain, protocol)) == [(0, [True, False, True], 3, 0.5), (1, [False, True, True], 4, None)]
    (tmp_path / "plan.pkl").write_bytes(pickle.dumps(plain))
    got = predictions.read_predictions(spark, str(tmp_path)).orderBy("instance_id").collect()
    assert [tuple(r) for r in got] == [("plan", 0, [True, False, True], 3, 0.5), ("plan", 1, [False, True, True], 4, None)]
    for bad in (Bad(), [{"masks": np.array([Bad()], object), "labels": 1}], [{"masks": mask, "labels": Bad()}], {"a": {1, 2}, "b": object()}):
        with pytest.raises(pickle.UnpicklingError):
            predictions.instances_of(pickle.dumps(bad))


# ------------------------------------------------- streams of pieces, division


PIECE = "drawing_id long, piece int, n_pieces int, v int"


def test_pieces_of_drawings_are_put_together_over_runs(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, PIECE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = lambda batch: batch.groupBy("drawing_id", "complete").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))

    def run():
        q = process_pieces(spark, str(tmp_path / "in"), PIECE, plan, str(tmp_path / "out"), str(tmp_path / "log"), files=1)
        assert q.awaitTermination(120)
        return sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).select("drawing_id", "complete", "v", "n").collect())

    write([(1, 0, 2, 1), (1, 0, 2, 2), (2, 0, 1, 5), (3, 1, 2, 7)])
    assert run() == [(2, True, 5, 1)]
    write([(1, 0, 2, 100)])  # a piece that comes again
    write([(1, 1, 2, 4), (4, 0, 2, 9)])
    assert run() in ([(1, True, 7, 3), (2, True, 5, 1)], [(1, True, 104, 2), (2, True, 5, 1)])


def test_drawings_that_wait_too_long_are_let_go(spark, tmp_path):
    spark.createDataFrame([(1, 0, 2, 3)], PIECE).write.parquet(str(tmp_path / "in"))
    stream = whole_drawings(spark.readStream.schema(PIECE).parquet(str(tmp_path / "in")), wait_ms=500)
    q = stream.writeStream.format("memory").queryName("late_drawings").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            if (got := spark.table("late_drawings").collect()) or not q.isActive:
                break
            time.sleep(1)
        assert [tuple(r) for r in got] == [(1, 0, 2, 3, False)]
    finally:
        q.stop()


def test_the_state_holds_many_drawings_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drawings, "GROUPS", 2)
    big = 2**53 + 1
    rows = [(big + 2 * d, n, 2, big + d if n else None) for d in range(50) for n in (0, 1)] + [(None, 0, 2, 1), (None, 1, 2, big), (7, 0, 2, 8), (8, None, 1, 8), (9, 0, None, 9)]
    seen = []
    for some in (rows[::2], rows[1::2]):
        spark.createDataFrame(some, PIECE.replace("v int", "v long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = process_pieces(spark, str(tmp_path / "in"), PIECE.replace("v int", "v long"), lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "log"))
        assert q.awaitTermination(120)
        seen.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert seen[0] == 2 and seen[1] <= 2
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("drawing_id", "piece", "n_pieces", "v", "complete").collect()]
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted(got, key=key) == sorted([(*r, True) for r in rows[:102]], key=key)


def test_of_a_group_only_drawings_that_wait_too_long_are_let_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drawings, "GROUPS", 1)
    spark.createDataFrame([(1, 0, 2, 3), (2, 0, 2, 4), (2, 1, 2, 5), (3, 1, 2, 6)], PIECE).write.parquet(str(tmp_path / "in"))
    stream = whole_drawings(spark.readStream.schema(PIECE).parquet(str(tmp_path / "in")), wait_ms=500)
    q = stream.writeStream.format("memory").queryName("late_of_group").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            if len(got := spark.table("late_of_group").collect()) >= 4 or not q.isActive:
                break
            time.sleep(1)
        assert sorted(tuple(r) for r in got) == [(1, 0, 2, 3, False), (2, 0, 2, 4, True), (2, 1, 2, 5, True), (3, 1, 2, 6, False)]
    finally:
        q.stop()


def test_division_leaves_other_rooms_alone(spark):
    ring = lambda x: f"array(named_struct('x', {x}D, 'y', 0D), named_struct('x', {x + 100}D, 'y', 0D), named_struct('x', {x + 100}D, 'y', 100D), named_struct('x', {x}D, 'y', 100D))"
    rooms = spark.sql(" UNION ALL ".join(f"SELECT {d}L drawing_id, '{r}' room_id, {i} ord, array('A') types, {ring(x)} ring" for d, r, i, x in ((1, "a", 0, 0), (1, "b", 1, 200), (1, "c", 2, 300), (2, "a", 0, 0), (2, "b", 1, 100))))
    parts = spark.sql(f"SELECT 1L drawing_id, 'b' room_id, 'b_Sub_1' sub_id, 1 ord, array('A') types, {ring(200).replace('300D', '250D')} ring UNION ALL SELECT 1L, 'b', 'b_Sub_2', 2, array('B'), {ring(250).replace('350D', '300D')} UNION ALL SELECT 2L, 'b', 'b', 1, array('A'), {ring(100)}")
    bound = spark.createDataFrame([(1, "D", ["b", EXTERIOR_ID]), (1, "E", ["a", "b"]), (1, "N", []), (2, "D", ["a", "b"])], "drawing_id long, uid string, ends array<string>")
    doors = spark.sql(f"SELECT drawing_id, uid, {ring(150).replace('250D', '190D')} ring FROM VALUES (1L, 'D'), (1L, 'E'), (1L, 'N'), (2L, 'D') AS t(drawing_id, uid)")
    held = spark.createDataFrame([(1, "f", "b", 260.0, 50.0), (1, "g", "b", 250.0, 50.0), (1, "h", "c", 350.0, 50.0)], "drawing_id long, uid string, room_id string, x double, y double")
    edges = spark.createDataFrame([(1, "a", "b", "door"), (1, "b", "c", "touch"), (2, "a", "b", "door")], "drawing_id long, u string, v string, kind string")
    got = division.divided(division.Graph(rooms, bound, held.select("drawing_id", "uid", "room_id"), edges), doors, held, parts)
    rows = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    assert rows(got.rooms, "drawing_id", "ord", "room_id") == [(1, 1, "a"), (1, 2, "b_Sub_1"), (1, 3, "b_Sub_2"), (1, 4, "c"), (2, 1, "a"), (2, 2, "b")]
    assert rows(got.bound, "drawing_id", "uid", "ends") == [(1, "D", ["b_Sub_1", EXTERIOR_ID]), (1, "E", ["a", "b_Sub_1"]), (1, "N", []), (2, "D", ["a", "b"])]
    assert rows(got.held, "drawing_id", "uid", "room_id") == [(1, "f", "b_Sub_2"), (1, "h", "c")]
    assert rows(got.edges, "drawing_id", "u", "v", "kind") == [(1, "a", "b_Sub_1", "door"), (1, "b_Sub_1", "b_Sub_2", "touch"), (1, "b_Sub_2", "c", "touch"), (2, "a", "b", "door")]
