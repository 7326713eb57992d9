"""Registered queries of the floor-plan operators and their oracle SQL.

Each query derives its plans from the driver's tables (see ``derived``) and runs the library's
operators on all of them. Each oracle derives the same plans in SQL and computes the answer by
formulas of its own. Values are whole numbers or strings, so that both sides hash alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygons
from ..functions import text as T
from ..functions.vocab import EXTERIOR_ID, LABELS, PRIVATE_SEEDS, PUBLIC_BLOCKERS, PUBLIC_SEEDS
from ..operators import division as X
from ..operators import elements as E
from ..operators import enrich as N
from ..operators import evaluate as V
from ..operators import graph, rules, shapes
from ..operators import mesh as M
from ..operators import topology as P
from ..sources import dxf, files, jsonld, predictions, svg
from ..sources.shared import fresh_path, materialise, materialise_rows, spread
from ..streaming.drawings import process_pieces
from . import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def whole(c) -> F.Column:
    """A double that is a whole number but for rounding errors, as a bigint."""
    return F.rint(c).cast("bigint")


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# ------------------------------------------------------------ shared SQL

ROOM = f"""room AS (SELECT event_id // 12 AS drawing_id, event_id % 12 AS ord, 'Space_' || lpad(CAST(event_id % 12 AS VARCHAR), 3, '0') AS room_id,
 4000 * (event_id % 12 % 4) AS x0, 3500 * (event_id % 12 // 4) AS y0,
 4000 * (event_id % 12 % 4) + 4000 - CASE WHEN user_id % 3 = 0 THEN 500 ELSE 0 END AS x1,
 3500 * (event_id % 12 // 4) + 3500 - CASE WHEN user_id % 5 = 0 THEN 500 ELSE 0 END AS y1,
 {_list(D.TYPES)}[1 + CAST(round(value * 100) AS BIGINT) % 15] AS sem, event_id, user_id FROM events)"""
FURNITURE = f"""furniture AS (SELECT p_partkey % n AS drawing_id, 'F_' || p_partkey AS uid, {_list(LABELS)}[1 + p_partkey % 35] AS specific_type,
 4000 * (p_size % 12 % 4) + 500 + 37 * p_partkey % 3000 AS x, 3500 * (p_size % 12 // 4) + 500 + 53 * p_partkey % 2500 AS y
 FROM part, (SELECT count(*) // 12 AS n FROM events))"""
IN_ROOM = "in_room AS (SELECT f.drawing_id, f.uid, f.specific_type, r.room_id, r.ord FROM furniture f JOIN room r ON f.drawing_id = r.drawing_id AND x > x0 AND x < x1 AND y > y0 AND y < y1)"
DOOR = """door AS (SELECT drawing_id, 'D_' || event_id AS uid, 4000 * (ord % 4 + 1) AS xc, y0 + 1000 AS lo, y0 + 1700 + 100 * (user_id % 3) AS hi FROM room WHERE ord % 4 < 3 AND user_id % 2 = 0
 UNION ALL SELECT drawing_id, 'E_' || event_id, 0, y0 + 1000, y0 + 1700 + 100 * (user_id % 3) FROM room WHERE ord % 4 = 0 AND user_id % 7 = 0)"""
BOUND = f"""met AS (SELECT d.drawing_id, d.uid, r.room_id, r.ord FROM door d JOIN room r ON d.drawing_id = r.drawing_id AND r.x0 <= xc + 300 AND r.x1 >= xc - 300 AND 2 * r.y0 <= lo + hi AND 2 * r.y1 >= lo + hi),
 bound AS (SELECT d.drawing_id, d.uid, count(room_id) AS n, min_by(room_id, ord) AS a, max_by(room_id, ord) AS b FROM door d LEFT JOIN met m ON d.drawing_id = m.drawing_id AND d.uid = m.uid GROUP BY ALL),
 ends AS (SELECT drawing_id, uid, n, CASE n WHEN 0 THEN [] WHEN 1 THEN [a, '{EXTERIOR_ID}'] ELSE [a, b] END AS e FROM bound)"""
GRID = """edge AS (SELECT r.drawing_id, r.room_id AS u, s.room_id AS v FROM room r JOIN room s ON s.event_id = r.event_id + 1 AND r.ord % 4 < 3 AND r.user_id % 2 = 0
 UNION ALL SELECT r.drawing_id, r.room_id, s.room_id FROM room r JOIN room s ON s.event_id = r.event_id + 4 AND r.ord < 8 AND r.user_id % 3 = 0),
 arc AS (SELECT drawing_id, u AS src, v AS dst FROM edge UNION SELECT drawing_id, v, u FROM edge)"""
PUBLIC = f"""far AS (SELECT drawing_id, room_id AS node, sem IN {tuple(PUBLIC_SEEDS)} AS pub, 0 AS hops FROM room WHERE sem IN {tuple(PUBLIC_SEEDS + PRIVATE_SEEDS)}
 UNION SELECT f.drawing_id, dst, pub, hops + 1 FROM far f JOIN arc ON f.drawing_id = arc.drawing_id AND f.node = arc.src WHERE hops < 12),
 ruled AS (SELECT r.drawing_id, r.room_id, min(hops) FILTER (pub) AS d_public, min(hops) FILTER (NOT pub) AS d_private FROM room r LEFT JOIN far f ON r.drawing_id = f.drawing_id AND r.room_id = f.node WHERE sem = 'Corridor' GROUP BY ALL),
 public AS (SELECT *, d_public IS NOT NULL AND (d_private IS NULL OR d_public <= d_private) AS is_public FROM ruled),
 typed AS (SELECT r.*, CASE WHEN sem = 'Unknown' THEN [] WHEN coalesce(is_public, false) THEN [sem, 'PublicCorridor'] ELSE [sem] END AS types FROM room r LEFT JOIN public p ON r.drawing_id = p.drawing_id AND r.room_id = p.room_id)"""
SUITE = f"""free AS (SELECT drawing_id, room_id, ord FROM typed WHERE len(types) > 0 AND NOT list_has_any(types, {_list(PUBLIC_BLOCKERS)})),
 reach AS (SELECT drawing_id, ord AS start, room_id FROM free
 UNION SELECT r.drawing_id, start, dst FROM reach r JOIN arc a ON r.drawing_id = a.drawing_id AND r.room_id = a.src JOIN free f ON f.drawing_id = a.drawing_id AND f.room_id = dst),
 first AS (SELECT drawing_id, room_id, min(start) AS first FROM reach GROUP BY ALL),
 suite AS (SELECT drawing_id, 'Suite_' || lpad(CAST(dense_rank() OVER (PARTITION BY drawing_id ORDER BY first) AS VARCHAR), 2, '0') AS suite_id, room_id FROM first)"""
DOOR_TYPE = f"""side AS (SELECT drawing_id, uid, n, unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS room_id FROM ends),
 seen AS (SELECT s.drawing_id, s.uid, count(s.room_id) AS n, count(*) FILTER (s.room_id = '{EXTERIOR_ID}' OR list_has_any(t.types, {_list([*PUBLIC_SEEDS, "PublicCorridor"])})) AS pub,
 coalesce(bool_or(sem = 'Kitchen'), false) AS k, coalesce(bool_or(sem = 'Bathroom'), false) AS w, coalesce(bool_or(sem = 'Bedroom'), false) AS b FROM side s LEFT JOIN typed t ON s.drawing_id = t.drawing_id AND s.room_id = t.room_id GROUP BY ALL),
 dtype AS (SELECT drawing_id, uid, CASE WHEN n < 2 OR pub = 1 THEN 'EntranceDoor' WHEN k THEN 'KitchenDoor' WHEN w THEN 'BathroomDoor' WHEN b THEN 'BedroomDoor' ELSE 'InteriorDoor' END AS door_type FROM seen)"""
CORRIDOR = """beside AS (SELECT a.drawing_id, a.src AS room_id, bool_or(sem IN ('Bedroom', 'LivingRoom')) AS main, bool_or(sem IN ('Kitchen', 'Bathroom')) AS second FROM arc a JOIN room r ON a.drawing_id = r.drawing_id AND a.dst = r.room_id GROUP BY ALL),
 enter AS (SELECT DISTINCT s.drawing_id, s.room_id FROM side s JOIN dtype d ON s.drawing_id = d.drawing_id AND s.uid = d.uid AND door_type = 'EntranceDoor'),
 ctype AS (SELECT t.drawing_id, t.room_id, list_filter([CASE WHEN 'PublicCorridor' IN types AND e.room_id IS NOT NULL THEN 'EntranceCorridor' END, CASE WHEN 'PublicCorridor' NOT IN types AND main THEN 'MainCorridor' END,
 CASE WHEN 'PublicCorridor' NOT IN types AND second THEN 'SecondaryCorridor' END], lambda x: x IS NOT NULL) AS added
 FROM typed t LEFT JOIN beside b ON t.drawing_id = b.drawing_id AND t.room_id = b.room_id LEFT JOIN enter e ON t.drawing_id = e.drawing_id AND t.room_id = e.room_id WHERE sem = 'Corridor')"""
TRUTH = """pair AS (SELECT r.*, s.x1 AS nx1, r.event_id % 11 = 0 AND r.ord % 4 < 3 AND s.x1 IS NOT NULL AS merged FROM room r LEFT JOIN room s ON s.drawing_id = r.drawing_id AND s.ord = r.ord + 1),
 left_over AS (SELECT * FROM pair p WHERE NOT EXISTS (SELECT 1 FROM pair q WHERE q.merged AND q.drawing_id = p.drawing_id AND q.ord + 1 = p.ord)),
 moved AS (SELECT drawing_id, ord, sem, y0, y1, x0 + 200 * (event_id % 5) AS a, CASE WHEN merged THEN nx1 ELSE x1 END + 200 * (event_id % 5) AS b, event_id % 13 = 0 AND NOT merged AS cut FROM left_over),
 gt AS (SELECT drawing_id, 2 * ord AS ord, sem, a AS x0, y0, b AS x1, y1 FROM moved WHERE NOT cut UNION ALL SELECT drawing_id, 2 * ord, sem, a, y0, (a + b) // 2, y1 FROM moved WHERE cut
 UNION ALL SELECT drawing_id, 2 * ord + 1, sem, (a + b) // 2, y0, b, y1 FROM moved WHERE cut),
 lap AS (SELECT * FROM (SELECT g.drawing_id, g.ord AS g, r.ord AS s, greatest(0, least(g.x1, r.x1) - greatest(g.x0, r.x0)) * greatest(0, least(g.y1, r.y1) - greatest(g.y0, r.y0)) AS i,
 (g.x1 - g.x0) * (g.y1 - g.y0) AS ga, (r.x1 - r.x0) * (r.y1 - r.y0) AS sa FROM gt g JOIN room r ON g.drawing_id = r.drawing_id) WHERE i > 0)"""
MATCH = """cov AS (SELECT *, count(*) OVER (PARTITION BY drawing_id, s) AS n FROM lap WHERE 10 * i > 8 * ga),
 under AS (SELECT drawing_id, g, max(s) AS s FROM cov WHERE n >= 2 GROUP BY ALL),
 rest AS (SELECT * FROM lap l WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.drawing_id = l.drawing_id AND u.g = l.g) AND NOT EXISTS (SELECT 1 FROM cov c WHERE c.n >= 2 AND c.drawing_id = l.drawing_id AND c.s = l.s)),
 over AS (SELECT drawing_id, g FROM rest WHERE 10 * i > 8 * sa GROUP BY drawing_id, g, ga HAVING count(*) >= 2 AND 2 * sum(i) > ga),
 rest2 AS (SELECT * FROM rest l WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.drawing_id = l.drawing_id AND o.g = l.g) AND NOT EXISTS (SELECT 1 FROM rest p JOIN over o ON o.drawing_id = p.drawing_id AND o.g = p.g WHERE 10 * p.i > 8 * p.sa AND p.drawing_id = l.drawing_id AND p.s = l.s)),
 one AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, g ORDER BY i / (ga + sa - i) DESC, s) AS a FROM rest2 WHERE 2 * i > ga + sa - i),
 two AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, s ORDER BY g) AS b FROM one WHERE a = 1),
 matched AS (SELECT gt.drawing_id, gt.ord AS g, gt.sem, coalesce(u.s, t.s) AS s, CASE WHEN u.g IS NOT NULL THEN 'under' WHEN o.g IS NOT NULL THEN 'over' WHEN t.g IS NOT NULL THEN 'matched' ELSE 'missed' END AS status
 FROM gt LEFT JOIN under u ON u.drawing_id = gt.drawing_id AND u.g = gt.ord LEFT JOIN over o ON o.drawing_id = gt.drawing_id AND o.g = gt.ord LEFT JOIN two t ON t.drawing_id = gt.drawing_id AND t.g = gt.ord AND b = 1)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + select


# --------------------------------------------------------------- geometry


@query(_with(ROOM, select="SELECT drawing_id, 'R11' AS rule_id, count(*) AS n FROM room WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000 GROUP BY drawing_id UNION ALL SELECT drawing_id, 'R13', count(*) FROM room WHERE sem = 'Kitchen' AND (x1 - x0) * (y1 - y0) < 3500000 GROUP BY drawing_id UNION ALL SELECT drawing_id, 'R14', count(*) FROM room WHERE sem = 'Bathroom' AND (x1 - x0) * (y1 - y0) < 2500000 GROUP BY drawing_id"))
def room_area_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.rooms(spark, sf_dir).select("drawing_id", F.col("room_id").alias("node_id"), "types", (G.area(F.col("ring")) / 1e6).alias("area_m2"))
    chosen = [r for r in rules.RULES if r[0] in ("R11", "R13", "R14")]
    return rules.violations(nodes, None, rules=chosen).groupBy("drawing_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(_with(ROOM, select="SELECT drawing_id, room_id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, x0 + x1 AS cx2, y0 + y1 AS cy2, x0 AS bx0, y1 AS by1 FROM room"))
def room_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.col("ring")
    c, b = G.centroid(ring), G.bounds(ring)
    return D.rooms(spark, sf_dir).select("drawing_id", "room_id", whole(G.area(ring)).alias("area"), whole(G.perimeter(ring)).alias("perimeter"), whole(2 * c["x"]).alias("cx2"), whole(2 * c["y"]).alias("cy2"), whole(b["x0"]).alias("bx0"), whole(b["y1"]).alias("by1"))


@query(_with(ROOM, select="SELECT drawing_id, room_id, (x1 - x0) * (y1 - y0) AS area, greatest(x1 - x0, y1 - y0) AS long_mm, least(x1 - x0, y1 - y0) AS short_mm, least(x1 - x0, y1 - y0) AS clear_mm, true AS inset_left FROM room"))
def rectangle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.rooms(spark, sf_dir).withColumn("m", E.rectangle_of("ring"))
    return r.select("drawing_id", "room_id", whole(F.col("m.area")).alias("area"), whole(F.col("m.long")).alias("long_mm"), whole(F.col("m.short")).alias("short_mm"), whole(E.clear_width("ring")).alias("clear_mm"), E.inset_left("ring").alias("inset_left"))


def l_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.rooms(spark, sf_dir).withColumns({"xm": F.expr("(x0 + x1) div 2"), "ym": F.expr("(2 * y0 + y1) div 3")})
    p = lambda x, y: G.point(F.col(x), F.col(y))
    return r.withColumn("ring", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "ym"), p("xm", "ym"), p("xm", "y1"), p("x0", "y1")))


L_ROOM = "l AS (SELECT *, (x0 + x1) // 2 AS xm, (2 * y0 + y1) // 3 AS ym FROM room)"


@query(_with(ROOM, L_ROOM, select="SELECT drawing_id, room_id, (x1 - x0) * (ym - y0) + (xm - x0) * (y1 - ym) AS area, CAST(1 AS BIGINT) AS n_concave, xm AS cx, ym AS cy, least(xm - x0, x1 - xm, ym - y0, y1 - ym) AS clear_mm FROM l"))
def l_room_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.col("ring")
    c = G.concave_points(ring)
    return spread(l_rooms(spark, sf_dir), "drawing_id", "room_id").select("drawing_id", "room_id", whole(G.area(ring)).alias("area"), F.size(c).cast("bigint").alias("n_concave"), whole(F.element_at(c, 1)["x"]).alias("cx"), whole(F.element_at(c, 1)["y"]).alias("cy"), whole(E.clear_width("ring")).alias("clear_mm"))


@query(_with(ROOM, L_ROOM, select="""SELECT drawing_id, room_id, CAST(2 AS BIGINT) AS n_parts, (x1 - x0) * (ym - y0) + (xm - x0) * (y1 - ym) AS area,
 CASE WHEN xm - x0 < ym - y0 THEN least((x1 - x0) * (ym - y0), (xm - x0) * (y1 - ym)) ELSE least((xm - x0) * (y1 - y0), (x1 - xm) * (ym - y0)) END AS least_part FROM l"""))
def acd_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = l_rooms(spark, sf_dir).select("drawing_id", "room_id", "ring", F.array(F.lit("LivingRoom"), F.lit("DiningRoom")).alias("types"))
    rooms = rooms.withColumn("anchors", F.array().cast("array<struct<text_ord:int,raw_text:string,std_label:string,x:double,y:double>>"))
    parts = N.decompose(rooms).withColumn("a", G.area(F.col("ring")))
    return parts.groupBy("drawing_id", "room_id").agg(F.count(F.lit(1)).alias("n_parts"), whole(F.sum("a")).alias("area"), whole(F.min("a")).alias("least_part"))


HALVES = """half AS (SELECT *, xm - x0 < ym - y0 AS flat, CASE WHEN xm - x0 < ym - y0 THEN (x1 - x0) * (ym - y0) ELSE (x1 - xm) * (ym - y0) END AS low,
 CASE WHEN xm - x0 < ym - y0 THEN (xm - x0) * (y1 - ym) ELSE (xm - x0) * (y1 - y0) END AS high FROM l)"""


def l_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """L-shaped rooms, each its own drawing, and the parts of every second one; the others have Suite and one type."""
    types = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("LivingRoom"), F.lit("DiningRoom"))).otherwise(F.array(F.lit("LivingRoom"), F.lit("Suite")))
    anchors = F.array().cast("array<struct<text_ord:int,raw_text:string,std_label:string,x:double,y:double>>")
    rooms = l_rooms(spark, sf_dir).withColumns({"drawing_id": F.col("event_id"), "types": types, "anchors": anchors})
    return rooms, materialise_rows(N.decompose(rooms), "parts")


@query(_with(ROOM, L_ROOM, HALVES, select="SELECT event_id AS drawing_id, unnest(CASE WHEN event_id % 2 = 0 THEN [low, high] ELSE [low + high] END) AS area FROM half"))
def divided_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of rooms once the divided ones are replaced by their parts."""
    rooms, parts = l_parts(spark, sf_dir)
    return N.replace_rooms(rooms, parts).select("drawing_id", whole(G.area(F.col("ring"))).alias("area"))


@query(_with(ROOM, L_ROOM, HALVES, select="SELECT event_id AS drawing_id, 'top' AS uid, high AS area FROM half WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'low', low FROM half WHERE event_id % 2 = 0"))
def divided_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors at the upper left and the lower right of divided rooms, with the area of the part they go to."""
    rooms, parts = l_parts(spark, sf_dir)
    at = lambda uid, x, y: rooms.select("drawing_id", "room_id", F.lit(uid).alias("uid"), G.rectangle(x - 100, y - 50, x + 100, y + 50).alias("ring"))
    doors = at("top", F.col("x0") + 200, F.col("y1")).unionByName(at("low", F.col("x1") - 200, F.col("y0")))
    size = parts.select("drawing_id", "sub_id", whole(G.area(F.col("ring"))).alias("area"))
    return N.rehome_doors(doors, parts).join(size, ["drawing_id", "sub_id"]).select("drawing_id", "uid", "area")


@query(_with(ROOM, L_ROOM, HALVES, select="SELECT event_id AS drawing_id, 'top' AS uid, high AS area FROM half WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'low', low FROM half WHERE event_id % 2 = 0"))
def divided_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of divided rooms with the area of the part around their centre; one on the outer wall has none."""
    rooms, parts = l_parts(spark, sf_dir)
    at = lambda uid, x, y: rooms.select("drawing_id", "room_id", F.lit(uid).alias("uid"), x.alias("x"), y.alias("y"))
    held = at("top", F.col("x0") + 200, F.col("y1") - 200).unionByName(at("low", F.col("x1") - 200, F.col("y0") + 200)).unionByName(at("wall", F.col("x0"), F.col("y0") + 200))
    size = parts.select("drawing_id", "sub_id", whole(G.area(F.col("ring"))).alias("area"))
    return N.rehome_elements(held, parts).join(size, ["drawing_id", "sub_id"]).select("drawing_id", "uid", "area")


@query(_with(ROOM, """part AS (SELECT drawing_id, room_id, unnest(CASE WHEN event_id % 2 = 1 THEN ['Bedroom|LivingRoom'] ELSE ['Bedroom', 'LivingRoom'] END) AS types, event_id % 2 = 0 AS cut, (x1 - x0) * (y1 - y0) AS area FROM room)""",
    select="SELECT drawing_id, room_id, types, CASE WHEN cut THEN area // 2 ELSE area END AS area FROM part"))
def anchored_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with two types: cut halfway between two anchors, across the axis on which they are further apart; three anchors cut nothing."""
    p = lambda i, label, x, y: F.struct(F.lit(i).alias("text_ord"), F.lit("t").alias("raw_text"), F.lit(label).alias("std_label"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    beside = (p(0, "Bedroom", "x0 + 500", "y0 + 500"), p(1, "LivingRoom", "x1 - 500", "y0 + 900"))
    above = (p(0, "Bedroom", "x0 + 500", "y1 - 500"), p(1, "LivingRoom", "x0 + 900", "y0 + 500"))
    anchors = F.when(F.col("event_id") % 2 == 1, F.array(*beside, p(2, "Bedroom", "x0 + 700", "y1 - 700"))).when(F.col("user_id") % 3 == 0, F.array(*above)).otherwise(F.array(*beside))
    rooms = D.rooms(spark, sf_dir).withColumns({"types": F.array(F.lit("Bedroom"), F.lit("LivingRoom")), "anchors": anchors})
    return N.decompose(rooms).select("drawing_id", "room_id", F.array_join("types", "|").alias("types"), whole(G.area(F.col("ring"))).alias("area"))


@query(_with(ROOM, L_ROOM, HALVES, select="SELECT event_id AS drawing_id, CASE WHEN flat THEN xm - x0 ELSE ym - y0 END AS shared FROM half WHERE event_id % 2 = 0"))
def divided_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wall that the two parts of a divided room share."""
    _, parts = l_parts(spark, sf_dir)
    found = P.touching_rooms(parts.select("drawing_id", F.col("sub_id").alias("room_id"), "ord", "ring"), min_shared=10.0, tolerance=1.0)
    return found.select("drawing_id", whole(F.col("shared")).alias("shared"))


@query(_with(ROOM, L_ROOM, """rect AS (SELECT drawing_id, ord, room_id, event_id % 2 = 0 AS cut, unnest([{'a': x0, 'b': y0, 'c': xm, 'd': y1}, {'a': xm, 'b': y0, 'c': x1, 'd': ym}]) AS q, x0, y0 FROM l),
 unit AS (SELECT *, room_id || ':' || CASE WHEN cut THEN q.a || ',' || q.b ELSE x0 || ',' || y0 END AS name FROM rect),
 wall AS (SELECT x.drawing_id, x.name AS a, y.name AS b, bool_or(x.cut OR y.cut) AS cut, bool_or(x.q.a <= y.q.c AND y.q.a <= x.q.c AND x.q.b <= y.q.d AND y.q.b <= x.q.d) AS touch,
 sum(CASE WHEN x.q.a = y.q.c OR x.q.c = y.q.a THEN greatest(0, least(x.q.d, y.q.d) - greatest(x.q.b, y.q.b)) ELSE 0 END + CASE WHEN x.q.b = y.q.d OR x.q.d = y.q.b THEN greatest(0, least(x.q.c, y.q.c) - greatest(x.q.a, y.q.a)) ELSE 0 END) AS shared
 FROM unit x JOIN unit y ON x.drawing_id = y.drawing_id AND x.name < y.name GROUP BY ALL),
 gate AS (SELECT l.drawing_id, 'D_' || l.event_id AS uid, l.ord, 4000 * (l.ord % 4 + 1) AS x, l.y0 + 200 AS lo, l.y0 + 800 AS hi FROM l JOIN l n ON n.event_id = l.event_id + 1 WHERE l.ord % 4 < 3 AND l.user_id % 2 = 0),
 far AS (SELECT g.drawing_id, uid, u.ord, name, min(greatest(0, q.a - x - 100, x - 100 - q.c) ** 2 + greatest(0, q.b - hi, lo - q.d) ** 2) AS d FROM gate g JOIN unit u ON u.drawing_id = g.drawing_id AND u.ord IN (g.ord, g.ord + 1) GROUP BY ALL),
 fin AS (SELECT drawing_id, uid, ord, min_by(name, d) AS name FROM far GROUP BY ALL),
 door AS (SELECT DISTINCT x.drawing_id, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b FROM fin x JOIN fin y ON x.drawing_id = y.drawing_id AND x.uid = y.uid AND x.ord < y.ord)""",
    select="""SELECT drawing_id, 'door' AS what, a, b FROM door UNION ALL SELECT drawing_id, 'touch', a, b FROM wall w WHERE (CASE WHEN cut THEN shared > 10 ELSE touch END) AND NOT EXISTS (SELECT 1 FROM door d WHERE d.drawing_id = w.drawing_id AND d.a = w.a AND d.b = w.b)
 UNION ALL SELECT drawing_id, 'end', uid, name FROM fin UNION ALL SELECT drawing_id, 'holds', spot || ord, name FROM unit, (SELECT unnest(['T', 'L']) AS spot) WHERE CASE WHEN spot = 'T' THEN q.a = x0 ELSE q.a > x0 END UNION ALL SELECT drawing_id, 'holds', 'W' || ord, name FROM unit WHERE NOT cut AND q.a = x0"""))
def divided_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, door ends and held elements of drawings of L-shaped rooms, every second of which is divided into its parts.

    Rooms and parts are named by their lower left corner. Elements stand in the upper arm, in the lower one, and on the
    line between the parts.
    """
    types = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("LivingRoom"), F.lit("DiningRoom"))).otherwise(F.array(F.lit("LivingRoom")))
    anchors = F.array().cast("array<struct<text_ord:int,raw_text:string,std_label:string,x:double,y:double>>")
    rooms = materialise_rows(l_rooms(spark, sf_dir).withColumns({"types": types, "anchors": anchors}), "rooms")
    most = rooms.agg(F.max("event_id").alias("most"))
    gates = rooms.join(F.broadcast(most)).where("ord % 4 < 3 AND user_id % 2 = 0 AND event_id < most").withColumn("x", 4000 * (F.col("ord") % 4 + 1))
    gates = gates.select("drawing_id", F.concat(F.lit("D_"), "event_id").alias("uid"), G.rectangle(F.col("x") - 100, F.col("y0") + 200, F.col("x") + 100, F.col("y0") + 800).alias("ring"), F.array("room_id", F.format_string("Space_%03d", F.col("ord") + 1)).alias("ends"))
    spot = lambda tag, x, y: F.struct(F.concat(F.lit(tag), "ord").alias("uid"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    held = rooms.select("drawing_id", "room_id", F.inline(F.array(spot("T", "x0 + 200", "y1 - 200"), spot("L", "x1 - 200", "y0 + 200"), spot("W", "(x0 + x1) div 2", "y0 + 200"))))
    bound = gates.select("drawing_id", "uid", "ends")
    found = X.divided(X.Graph(rooms, bound, held.select("drawing_id", "uid", "room_id"), P.adjacency(rooms, bound)), gates, held, N.decompose(rooms))
    low = G.bounds(F.col("ring"))
    name = F.concat_ws(":", F.regexp_replace("room_id", "_Sub_.*", ""), F.concat_ws(",", whole(low["x0"]), whole(low["y0"])))
    named = materialise_rows(found.rooms.select("drawing_id", "room_id", name.alias("name")), "names")
    of = lambda rows, column: rows.join(named.withColumnsRenamed({"room_id": column, "name": f"{column}_name"}), ["drawing_id", column])
    edges = of(of(found.edges, "u"), "v").select("drawing_id", F.col("kind").alias("what"), F.least("u_name", "v_name").alias("a"), F.greatest("u_name", "v_name").alias("b"))
    ends = of(found.bound.select("drawing_id", F.col("uid").alias("a"), F.explode("ends").alias("room")), "room").select("drawing_id", F.lit("end").alias("what"), "a", F.col("room_name").alias("b"))
    holds = of(found.held.withColumnRenamed("room_id", "room"), "room").select("drawing_id", F.lit("holds").alias("what"), F.col("uid").alias("a"), F.col("room_name").alias("b"))
    return edges.unionByName(ends).unionByName(holds)


@query(_with(ROOM, select="SELECT drawing_id, room_id, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS wkt, (x1 - x0) * (y1 - y0) AS area_back FROM room"))
def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.rooms(spark, sf_dir).withColumn("wkt", G.to_wkt(F.col("ring")))
    return r.select("drawing_id", "room_id", "wkt", whole(polygons.area(polygons.from_wkt(F.col("wkt")))).alias("area_back"))


@query(_with(ROOM, select="SELECT drawing_id, room_id, CAST(5 AS BIGINT) AS n_points, 10 * x0 AS wx, 10 * (140000 - y0) AS wy, 2 * x1 + 7 AS tx, 2 * y1 - 3 AS ty FROM room"))
def svg_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.format_string("M %d %d L %d %d L %d,%d L %d %d Z", "x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    r = spread(D.rooms(spark, sf_dir), "drawing_id", "room_id").withColumn("p", G.path_points(d))
    w = F.element_at(G.svg_to_world(F.col("p"), F.lit(0.1), 140000.0), 1)
    t = F.element_at(G.affine(F.col("p"), G.transform_matrix(F.lit("translate(7,-3) scale(2)"))), 3)
    return r.select("drawing_id", "room_id", F.size("p").cast("bigint").alias("n_points"), whole(w["x"]).alias("wx"), whole(w["y"]).alias("wy"), whole(t["x"]).alias("tx"), whole(t["y"]).alias("ty"))


@query("""WITH n AS (SELECT unnest(range(0, 20)) AS i), c AS (SELECT p_partkey, i, CAST(round_even(p_partkey + (100 + p_size) * cos(i * (2 * 3.141592653589793 / 19)), 0) AS BIGINT) AS x, CAST(round_even(2 * p_partkey + (200 + p_size) * sin(i * (2 * 3.141592653589793 / 19)), 0) AS BIGINT) AS y FROM part, n)
 SELECT p_partkey, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y * i) AS BIGINT) AS sy, count(*) AS n FROM c GROUP BY p_partkey""")
def ellipse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    pts = p.select("p_partkey", F.posexplode(G.circle_points(k, 2 * k, 100 + s, 200 + s)).alias("i", "p"))
    return pts.groupBy("p_partkey").agg(F.sum(whole(F.col("p.x"))).alias("sx"), F.sum(whole(F.col("p.y")) * F.col("i")).alias("sy"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_kept, CAST(2 AS BIGINT) AS n_snapped FROM orders")
def point_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near points dropped, coordinates snapped to integers."""
    k = F.col("o_orderkey")
    far = F.when(F.col("o_custkey") % 2 == 0, 0.2).otherwise(0.00005)
    line = F.array(G.point(k, k), G.point(k + far, k), G.point(k + far, k + 0.00004), G.point(k + 9, k))
    o = D.table(spark, sf_dir, "orders").withColumn("line", line)
    return o.select("o_orderkey", F.size(G.drop_close(F.col("line"))).cast("bigint").alias("n_kept"), F.size(G.snap(F.col("line"))).cast("bigint").alias("n_snapped"))


# ------------------------------------------------------ elements and texts


@query(f"""SELECT l_orderkey % 50 AS drawing_id, 'FUNCTIONALELEMENT_' || l_orderkey AS uid, {_list(LABELS)}[1 + l_orderkey % 35] AS specific_type,
 greatest(max(l_partkey + 10 * l_linenumber) - min(l_partkey), max(l_suppkey + 5 * l_linenumber) - min(l_suppkey)) AS length_mm, least(max(l_partkey + 10 * l_linenumber) - min(l_partkey), max(l_suppkey + 5 * l_linenumber) - min(l_suppkey)) AS width_mm, count(*) AS n_elements FROM lineitem GROUP BY l_orderkey""")
def instance_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.table(spark, sf_dir, "lineitem")
    x, y, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    label = E.label_of((F.col("l_orderkey") % 35).cast("int"), F.lit(1))
    el = li.select((F.col("l_orderkey") % 50).alias("drawing_id"), F.col("l_orderkey").alias("instance_id"), n.alias("elem_id"), label.alias("type"), F.array(G.point(x, y), G.point(x + 10 * n, y + 5 * n)).alias("coords"))
    return E.group_instances(el, "FunctionalElement").select("drawing_id", "uid", "specific_type", "length_mm", "width_mm", "n_elements")


@query(f"""SELECT {_list(LABELS)}[1 + p_partkey % 35] AS label, bool_or(p_partkey % 35 IN (32, 33, 34, 6, 7, 8)) AS is_wall, bool_or(p_partkey % 35 IN (0, 1, 2, 3, 4, 5, 9)) AS is_door, bool_or(p_partkey % 35 IN (6, 7, 8)) AS is_window, bool_or(p_partkey % 35 BETWEEN 10 AND 31) AS is_furniture, count(*) AS n FROM part GROUP BY p_partkey % 35""")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select(E.label_of((F.col("p_partkey") % 35).cast("int"), F.lit(1)).alias("type"))
    counts = p.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    for name, keep in (("is_wall", E.walls), ("is_door", E.doors), ("is_window", E.windows), ("is_furniture", E.furniture)):
        counts = counts.join(keep(p).select("type").distinct().withColumn(name, F.lit(True)), "type", "left").na.fill(False, [name])
    return counts.select(F.col("type").alias("label"), "is_wall", "is_door", "is_window", "is_furniture", "n")


MASK = "bit AS (SELECT s_suppkey % 10 AS drawing_id, s_suppkey AS instance_id, unnest(range(0, 16)) AS ord FROM supplier), hit AS (SELECT drawing_id, ord, max(instance_id) AS instance_id FROM bit WHERE (7 * instance_id + 3 * ord) % 5 = 0 GROUP BY ALL)"


@query(_with(MASK, select="SELECT d AS drawing_id, o AS ord, coalesce(instance_id, -1) AS instance_id, CAST(coalesce(instance_id % 35, -1) AS BIGINT) AS label_id FROM (SELECT unnest(range(0, 10)) AS d), (SELECT unnest(range(0, 16)) AS o) LEFT JOIN hit ON d = drawing_id AND o = ord"))
def mask_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (7 * F.col("s_suppkey") + 3 * i) % 5 == 0)
    inst = D.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("drawing_id"), F.col("s_suppkey").alias("instance_id"), bits.alias("masks"), (F.col("s_suppkey") % 35).alias("label_id"), F.lit(None).cast("double").alias("score"))
    prim = spark.range(160).select(F.expr("id div 16").alias("drawing_id"), (F.col("id") % 16).cast("int").alias("ord"))
    return E.inject_instances(prim, inst).select("drawing_id", F.col("ord").cast("bigint").alias("ord"), "instance_id", F.col("label_id").cast("bigint").alias("label_id"))


@query(_with(MASK, "place AS (SELECT DISTINCT drawing_id, instance_id, dense_rank() OVER (PARTITION BY drawing_id ORDER BY instance_id) - 1 AS i FROM bit)",
    select="SELECT drawing_id, ord, i AS instance_id, instance_id % 35 AS label_id, CASE WHEN instance_id % 2 = 0 THEN instance_id END AS score FROM hit JOIN place USING (drawing_id, instance_id)"))
def prediction_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives under a mask of prediction files, which are written as pickles and read back."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (7 * F.col("s_suppkey") + 3 * i) % 5 == 0)
    key = F.col("s_suppkey")
    inst = D.table(spark, sf_dir, "supplier").select((key % 10).cast("string").alias("drawing"), key.alias("instance_id"), bits.alias("masks"), (key % 35).alias("label_id"), F.when(key % 2 == 0, key.cast("double")).alias("score"))
    found = predictions.read_predictions(spark, filed(predictions.prediction_files(inst), ".pkl")).withColumnRenamed("drawing", "drawing_id")
    prim = found.select("drawing_id", F.posexplode("masks").alias("ord", "bit")).select("drawing_id", "ord").distinct()
    hit = E.inject_instances(prim, found).where("instance_id >= 0")
    return hit.select(F.col("drawing_id").cast("bigint").alias("drawing_id"), F.col("ord").cast("bigint").alias("ord"), F.col("instance_id").cast("bigint").alias("instance_id"), F.col("label_id").cast("bigint").alias("label_id"), F.col("score").cast("bigint").alias("score"))


@query(_with(ROOM, select="SELECT drawing_id, count(*) AS n_rooms, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM room GROUP BY drawing_id HAVING drawing_id % 5 > 0 OR count(*) FILTER (ord % 3 = 1) = 0"))
def streamed_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that arrive in three pieces, as a stream puts them together; of every fifth the second piece never comes."""
    piece = F.col("ord") % 3
    rooms = D.rooms(spark, sf_dir).withColumns({"piece": piece, "n_pieces": F.size(F.collect_set(piece).over(Window.partitionBy("drawing_id")))})
    rooms = materialise(rooms.where("piece <> 1 OR drawing_id % 5 > 0").select("drawing_id", "piece", "n_pieces", G.area(F.col("ring")).alias("area")), "pieces")
    path, sink, log = (fresh_path(spark, label) for label in ("pieces-in", "pieces-out", "pieces-log"))
    plan = lambda batch: batch.where("complete").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_rooms"), whole(F.sum("area")).alias("area"))
    for n in range(3):
        # Written by all tasks; a drawing's piece is in one file, so that it comes in one micro-batch.
        rooms.where(F.col("piece") == n).repartition("drawing_id").write.mode("append").parquet(path)
        process_pieces(spark, path, rooms.schema.simpleString()[7:-1].replace(":", " "), plan, sink, log).awaitTermination()
    return spark.read.schema("drawing_id bigint, n_rooms bigint, area bigint").parquet(sink).select("drawing_id", "n_rooms", "area")


TEXT = "txt AS (SELECT p_name AS t FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part), good AS (SELECT trim(t) AS t FROM txt WHERE length(trim(t)) >= 2 AND NOT regexp_full_match(trim(t), '[a-zA-Z0-9.]+')), map AS (SELECT DISTINCT p_name AS raw, ['Unknown', 'Kitchen', 'Bedroom', 'Balcony'][1 + length(p_name) % 4] AS std FROM part)"


@query(_with(TEXT, select="SELECT std AS std_label, count(*) AS n FROM good JOIN map ON t = raw AND std <> 'Unknown' GROUP BY std UNION ALL SELECT '(kept)', count(*) FROM good"))
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    texts = p.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("text"))
    label = F.element_at(F.array(*(F.lit(x) for x in ("Unknown", "Kitchen", "Bedroom", "Balcony"))), 1 + F.length("p_name") % 4)
    mapping = p.select(F.col("p_name").alias("raw_text"), label.alias("std_label")).distinct()
    good = E.room_texts(texts)
    typed = N.type_texts(good, mapping).groupBy("std_label").agg(F.count(F.lit(1)).alias("n"))
    return typed.unionByName(good.agg(F.lit("(kept)").alias("std_label"), F.count(F.lit(1)).alias("n")))


@query("SELECT p_partkey, p_partkey + CASE WHEN p_size % 2 = 0 THEN 0 ELSE CAST(trunc(length(p_name) * 10 * 0.8 / 2) AS BIGINT) END AS x, p_partkey - 5 AS y, regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g') AS safe, CAST(p_size AS VARCHAR) || '.1' AS rule_no, CASE WHEN p_size % 2 = 0 THEN 'gas stove' ELSE 'toilet' END AS facility, CASE WHEN p_size % 3 = 0 THEN 'v' ELSE '-' END AS reply FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    k, even = F.col("p_partkey"), F.col("p_size") % 2 == 0
    centre = E.text_centre(k, k, F.col("p_name"), F.lit(10), F.when(even, "middle").otherwise("start"))
    message = F.concat(F.lit("【违规 "), F.col("p_size").cast("string"), F.lit(".1】 x"))
    reply = F.when(F.col("p_size") % 3 == 0, '```json\n{"a": "v"}\n```').otherwise("no json")
    return p.select("p_partkey", centre["x"].alias("x"), centre["y"].alias("y"), T.safe_id(F.col("p_name")).alias("safe"), rules.rule_number(message).alias("rule_no"), T.facility_label(F.when(even, "GasStove").otherwise("Toilet")).alias("facility"), F.coalesce(F.try_element_at(T.parse_reply(reply), F.lit("a")), F.lit("-")).alias("reply"))


LINE = "line AS (SELECT o_orderkey // 20 AS drawing_id, o_orderkey AS elem_id, o_orderkey % 20 AS i, o_custkey % 5 = 0 AS gap, o_custkey % 4 = 0 AS wall FROM orders)"


@query("""SELECT p_partkey, p_name AS name, CAST(CASE WHEN white THEN 0 WHEN 299 * r + 587 * g + 114 * b > 200000 THEN r // 2 ELSE r END AS BIGINT) AS r, CAST(CASE WHEN white THEN 0 WHEN 299 * r + 587 * g + 114 * b > 200000 THEN g // 2 ELSE g END AS BIGINT) AS g, CAST(CASE WHEN white THEN 0 WHEN 299 * r + 587 * g + 114 * b > 200000 THEN b // 2 ELSE b END AS BIGINT) AS b
 FROM (SELECT p_partkey, p_name, p_partkey % 10 = 0 AS white, CASE WHEN p_partkey % 10 = 0 THEN 255 ELSE 7 * p_partkey % 256 END AS r, CASE WHEN p_partkey % 10 = 0 THEN 255 ELSE 255 - p_partkey % 40 END AS g, CASE WHEN p_partkey % 10 = 0 THEN 255 ELSE 5 * p_size END AS b FROM part)""")
def shown_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as drawn on white paper, and names without their prefix."""
    p = D.table(spark, sf_dir, "part")
    white = F.col("p_partkey") % 10 == 0
    r, g, b = (F.when(white, 255).otherwise(c) for c in (7 * F.col("p_partkey") % 256, 255 - F.col("p_partkey") % 40, 5 * F.col("p_size")))
    c = T.shown_colour(r, g, b)
    return p.select("p_partkey", T.strip_prefix(F.concat(F.lit("bldg:"), "p_name")).alias("name"), *(c[k].cast("bigint").alias(k) for k in "rgb"))


@query(_with(FURNITURE, select="SELECT drawing_id, uid, ord, CAST(CASE WHEN ord IN (0, 3) THEN x - 100 ELSE x + 100 END AS BIGINT) AS px, CAST(CASE WHEN ord < 2 THEN y - 100 ELSE y + 100 END AS BIGINT) AS py, CAST(CASE WHEN ord < 2 THEN x + 100 ELSE x - 100 END AS BIGINT) AS qx, CAST(CASE WHEN ord IN (0, 3) THEN y - 100 ELSE y + 100 END AS BIGINT) AS qy FROM furniture, (SELECT unnest(range(4)) AS ord)"))
def component_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.component_segments(D.furniture(spark, sf_dir))
    return s.select("drawing_id", "uid", F.col("ord").cast("bigint").alias("ord"), *(whole(F.element_at("coords", i)[k]).alias(n + k) for i, n in ((1, "p"), (2, "q")) for k in "xy"))


@query(_with(LINE, select="SELECT drawing_id, elem_id, CASE WHEN bool_or(wall) OVER (PARTITION BY drawing_id, chain) THEN 'wall' ELSE 'background' END AS type FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY i) AS chain FROM line)"))
def wall_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diffuse_walls(D.lines(spark, sf_dir)).select("drawing_id", "elem_id", "type")


@query("SELECT o_orderkey // 20 AS drawing_id, 3 * o_orderkey + 2 AS elem_id, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 3 = 2 AND 1 + o_custkey % 30 <= 14 THEN 'wall' ELSE 'background' END AS type FROM orders")
def overlapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background lines that end where walls end: those that lead on become walls, those that run along one do not.

    By o_custkey a line leads on, runs back along its wall, or runs along it by 1 to 30 mm and then up to another wall's
    end; more than 15 mm of overlap forbid it.
    """
    along = 1 + F.col("o_custkey") % 30
    o = D.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 20").alias("drawing_id"), "o_orderkey", "o_custkey", (1000 * (F.col("o_orderkey") % 20)).alias("y"))
    at = lambda x, up=0: G.point(F.lit(x) if isinstance(x, int) else x, F.col("y") + up)
    kind = F.col("o_custkey") % 3
    ground = F.when(kind == 0, F.array(at(1000), at(1200))).when(kind == 1, F.array(at(1000), at(1000 - along))).otherwise(F.array(at(1000 - along), at(1000), at(1000, 500)))
    item = lambda i, label, coords: F.struct((3 * F.col("o_orderkey") + i).alias("elem_id"), F.lit(label).alias("type"), coords.alias("coords"))
    lines = o.select("drawing_id", F.inline(F.array(item(0, "wall", F.array(at(0), at(1000))), item(1, "wall", F.array(at(1000, 500), at(2000, 500))), item(2, "background", ground))))
    return E.diffuse_walls(lines).where("elem_id % 3 = 2").select("drawing_id", "elem_id", "type")


@query(_with(LINE, select="SELECT drawing_id, count(*) FILTER (wall) AS n_wall, count(*) FILTER (NOT wall) AS n_background, min(100 * i + CASE WHEN gap THEN 10 ELSE 0 END) AS x0, max(100 * i + 100) AS x1 FROM line GROUP BY drawing_id"))
def drawing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of types and extents of each drawing."""
    x = D.lines(spark, sf_dir).withColumn("b", G.bounds(F.col("coords")))
    return x.groupBy("drawing_id").agg(F.count_if(F.col("type") == "wall").alias("n_wall"), F.count_if(F.col("type") == "background").alias("n_background"), whole(F.min("b.x0")).alias("x0"), whole(F.max("b.x1")).alias("x1"))


@query(_with(LINE, select="SELECT drawing_id, count(*) AS n, CAST(round(1000 * sum(sqrt(pow(100 - CASE WHEN gap THEN 10 ELSE 0 END, 2) + 2500))) AS BIGINT) AS length_um FROM line GROUP BY drawing_id"))
def wall_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noded, merged wall segments of each drawing."""
    cleaned = E.clean_walls(D.lines(spark, sf_dir))
    return cleaned.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"), whole(1000 * F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).alias("length_um"))


@query()
def closed_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms found again as the closed areas between all rooms' sides."""
    sides = D.rooms(spark, sf_dir).select("drawing_id", F.explode(G.segments(F.col("ring"))).alias("s"))
    sides = sides.select("drawing_id", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))
    found = E.plausible_rooms(E.room_faces(sides))
    return found.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_rooms"), whole(F.sum(G.area(F.col("ring")))).alias("area"))


@query(_with(ROOM, """cell AS (SELECT drawing_id, ord, ord // 4 AS row, sum(CASE WHEN ord % 4 > 0 AND open THEN 0 ELSE 1 END) OVER (PARTITION BY drawing_id ORDER BY ord) AS run
 FROM (SELECT drawing_id, ord, lag(user_id) OVER (PARTITION BY drawing_id ORDER BY ord) % 2 = 0 AS open FROM room))""",
    select="SELECT drawing_id, 'Space_' || lpad(CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY x, y) AS VARCHAR), 3, '0') AS place, x, y, area FROM (SELECT drawing_id, run, 4000 * min(ord % 4) AS x, 3500 * min(row) AS y, 14000000 * count(*) AS area FROM cell GROUP BY drawing_id, run)"))
def open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a lattice of walls, in which a wall between rooms k and k + 1 of a row is missing if k's user_id is even.

    Every cell also has a stub of wall that ends inside it, which closes nothing.
    """
    r = D.rooms(spark, sf_dir).withColumns({"a": 4000 * (F.col("ord") % 4), "b": F.expr("3500 * (ord div 4)"), "shut": F.expr("ord % 4 = 3 or user_id % 2 = 1")})
    r = r.withColumn("last", F.max("ord").over(Window.partitionBy("drawing_id"))).withColumn("shut", F.expr("shut or ord = last"))
    wall = lambda x0, y0, x1, y1, when="true": F.when(F.expr(when), F.struct(F.expr(x0).alias("x0"), F.expr(y0).alias("y0"), F.expr(x1).alias("x1"), F.expr(y1).alias("y1")))
    four = F.array_compact(F.array(wall("a", "b", "a + 4000", "b"), wall("a", "b + 3500", "a + 4000", "b + 3500"), wall("a", "b", "a", "b + 3500", "ord % 4 = 0"), wall("a + 4000", "b", "a + 4000", "b + 3500", "shut"), wall("a + 2000", "b", "a + 2000", "b + 900")))
    rooms = E.plausible_rooms(E.room_faces(r.select("drawing_id", F.inline(four))))
    box = G.bounds(F.col("ring"))
    found = rooms.select("drawing_id", whole(box["x0"]).alias("x"), whole(box["y0"]).alias("y"), whole(G.area(F.col("ring"))).alias("area"))
    return P.numbered(found, "Space_%03d", ["drawing_id"], ["x", "y"], "place")


@query(_with(ROOM, select="SELECT drawing_id, event_id AS edge_id FROM room WHERE ord % 4 < 3 AND user_id % 2 = 0"))
def opening_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("4000 * (ord % 4 + 1)")
    edges = D.rooms(spark, sf_dir).select("drawing_id", F.col("event_id").alias("edge_id"), x.alias("x0"), (F.col("y0") + 900).alias("y0"), x.alias("x1"), (F.col("y0") + 1900).alias("y1"))
    edges = edges.select("drawing_id", "edge_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return E.opening_edges(edges, D.doors(spark, sf_dir)).select("drawing_id", "edge_id")


@query(_with(ROOM, FURNITURE, "spot AS (SELECT DISTINCT drawing_id, x, y FROM furniture)", select="SELECT drawing_id, 2 * count(*) + 2 AS n_triangles, CAST(336000000 AS BIGINT) AS area2 FROM spot GROUP BY drawing_id"))
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles between the places of a drawing's furniture and the corners of its sheet."""
    spots = D.furniture(spark, sf_dir).select("drawing_id", "x", "y")
    corners = F.array(*(F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for x in (0, 16000) for y in (0, 10500)))
    mesh = E.mesh(spots.unionByName(spots.select("drawing_id").distinct().select("drawing_id", F.inline(corners))))
    return mesh.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_triangles"), whole(2 * F.sum(G.area(F.col("ring")))).alias("area2"))


# --------------------------------------------- polygons with holes, meshes

YARD = """yard AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, user_id % 2 = 0 AS two, event_id % 5 AS d FROM room),
 wkt AS (SELECT *, '((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '), (' || x0 + 500 || ' ' || y0 + 500 || ', ' || x0 + 1500 || ' ' || y0 + 500 || ', ' || x0 + 1500 || ' ' || y0 + 1700 || ', ' || x0 + 500 || ' ' || y0 + 1700 || ', ' || x0 + 500 || ' ' || y0 + 500 || '))' AS one,
 '((' || x1 + 100 || ' ' || y0 || ', ' || x1 + 300 || ' ' || y0 || ', ' || x1 + 300 || ' ' || y0 + 400 || ', ' || x1 + 100 || ' ' || y0 + 400 || ', ' || x1 + 100 || ' ' || y0 || '))' AS more FROM yard)"""


def yards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms with a courtyard of 1000 by 1200, half of them with a second part of 200 by 400 beside them."""
    box = lambda a, b, c, d: G.rectangle(*map(F.expr, (a, b, c, d)))
    main = polygons.part(F.col("ring"), F.array(box("x0 + 500", "y0 + 500", "x0 + 1500", "y0 + 1700")))
    beside = polygons.part(box("x1 + 100", "y0", "x1 + 300", "y0 + 400"))
    return D.rooms(spark, sf_dir).withColumn("polygon", F.when(F.col("user_id") % 2 == 0, F.array(main, beside)).otherwise(F.array(main)))


@query(_with(ROOM, YARD, select="""SELECT drawing_id, room_id, w * h - 1200000 + CASE WHEN two THEN 80000 ELSE 0 END AS area, 2 * (w + h) + 4400 + CASE WHEN two THEN 1200 ELSE 0 END AS around,
 CASE WHEN two THEN x1 + 300 ELSE x1 END AS right_end, false AS in_yard, true AS in_room, two AS in_second, CAST(500 AS BIGINT) AS from_yard, CAST(CASE WHEN two THEN 0 ELSE 200 END AS BIGINT) AS from_second,
 CASE WHEN two THEN 'MULTIPOLYGON (' || one || ', ' || more || ')' ELSE 'POLYGON ' || one END AS wkt FROM wkt"""))
def courtyard_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, boundary, points and texts of polygons with holes and two parts; areas are those of the text read back."""
    r = spread(yards(spark, sf_dir), "drawing_id", "room_id").withColumn("wkt", polygons.to_wkt(F.col("polygon"))).withColumn("back", polygons.from_wkt(F.col("wkt")))
    p = F.col("back")
    at = lambda f, x, y: f(p, F.expr(x), F.expr(y))
    yard, second = ("x0 + 1000", "y0 + 1000"), ("x1 + 200", "y0 + 200")
    return r.select(
        "drawing_id", "room_id", whole(polygons.area(p)).alias("area"), whole(polygons.perimeter(p)).alias("around"), whole(polygons.bounds(p)["x1"]).alias("right_end"),
        at(polygons.contains, *yard).alias("in_yard"), at(polygons.contains, "x0 + 2000", "y0 + 2000").alias("in_room"), at(polygons.contains, *second).alias("in_second"),
        whole(at(polygons.distance_to, *yard)).alias("from_yard"), whole(at(polygons.distance_to, *second)).alias("from_second"), "wkt",
    )


@query(_with(ROOM, YARD, select="SELECT drawing_id, room_id, 2250000 - (500 - 100 * d) * 700 AS common, 400 - 50 * d AS apart FROM yard"))
def courtyard_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a box over the courtyard's edge shares with the room, and how far a post in the yard stands from it."""
    d = F.col("event_id") % 5
    box = lambda x, y, w: polygons.parts(G.rectangle(x, y, x + w, y + w))
    r = spread(yards(spark, sf_dir), "drawing_id", "room_id").withColumns({"over": box(F.col("x0") + 1000 + 100 * d, F.col("y0") + 1000, 1500), "post": box(F.col("x0") + 900 + 50 * d, F.col("y0") + 900, 200)})
    return r.select("drawing_id", "room_id", whole(P.polygon_common_area("polygon", "over")).alias("common"), whole(P.polygon_distance("polygon", "post")).alias("apart"))


def _box_walls(x: str, y: str, w: int, h: int, when: str = "true") -> list[str]:
    """Expressions of the four walls of a box, null where it is not there."""
    corners = [(x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + {h}"), (x, f"{y} + {h}")]
    return [_wall(*p, *q, when) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]


def _wall(x0: str, y0: str, x1: str, y1: str, when: str = "true") -> str:
    return f"IF({when}, named_struct('x0', {x0}, 'y0', {y0}, 'x1', {x1}, 'y1', {y1}), NULL)"


def _walls(cells: DataFrame, *walls: str) -> DataFrame:
    return cells.select("drawing_id", F.inline(F.array_compact(F.array(*map(F.expr, walls)))))


@query(_with(ROOM, """cell AS (SELECT drawing_id, ord, event_id, user_id, ord // 4 AS row, sum(CASE WHEN ord % 4 > 0 AND NOT shut THEN 0 ELSE 1 END) OVER (PARTITION BY drawing_id ORDER BY ord) AS run
 FROM (SELECT drawing_id, ord, event_id, user_id, lag(user_id) OVER (PARTITION BY drawing_id ORDER BY ord) % 4 IN (1, 3) AS shut FROM room)),
 area AS (SELECT drawing_id, 4000 * min(ord % 4) AS x, 3500 * min(row) AS y, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS pillars, bool_or(ord % 4 = 0 AND user_id % 7 = 0) AS leaks FROM cell GROUP BY drawing_id, run)""",
    select="SELECT drawing_id, 'Space_' || lpad(CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY x, y) AS VARCHAR), 3, '0') AS room_id, x, y, 14000000 * n - 160000 * pillars AS area, 2 * (4000 * n + 3500) + 1600 * pillars AS around, pillars AS n_holes FROM area WHERE NOT leaks"))
def walled_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms grown over the constrained mesh of a lattice of walls, with pillars cut out of them.

    Between rooms k and k + 1 of a row the wall is missing, whole, with a gap, or with a gap and a door in it, by k's
    user_id. A gap in the outer wall leaks, door or not. Every cell has a stub of wall that ends inside it.
    """
    r = D.rooms(spark, sf_dir).withColumn("last", F.max("ord").over(Window.partitionBy("drawing_id")))
    r = r.selectExpr("*", "4000 * (ord % 4) AS a", "3500 * (ord div 4) AS b", "IF(ord % 4 = 3 OR ord = last, 1, user_id % 4) AS right", "ord % 4 = 0 AND user_id % 7 = 0 AS leaks")
    walls = _walls(
        r, _wall("a", "b", "a + 4000", "b"), _wall("a", "b + 3500", "a + 4000", "b + 3500"), _wall("a + 4000", "b", "a + 4000", "b + 3500", "right = 1"), _wall("a", "b", "a", "b + 3500", "ord % 4 = 0 AND NOT leaks"),
        *(_wall(x, f"b + {lo}", x, f"b + {hi}", when) for x, when in (("a + 4000", "right > 1"), ("a", "leaks")) for lo, hi in ((0, 1000), (1900, 3500))),
        _wall("a + 2000", "b", "a + 2000", "b + 900"), *_box_walls("a + 2900", "b + 1500", 400, 400, "event_id % 3 = 0"),
    )
    doors = r.where("right = 3").selectExpr("drawing_id", "a + 4000 AS x", "b AS y").unionByName(r.where("leaks AND event_id % 2 = 0").selectExpr("drawing_id", "a AS x", "b AS y"))
    doors = doors.select("drawing_id", G.rectangle(F.col("x") - 100, F.col("y") + 1000, F.col("x") + 100, F.col("y") + 1900).alias("ring"))
    found = E.plausible_rooms(M.candidate_faces(M.enclosed_areas(walls, doors)))
    box, p = G.bounds(F.col("ring")), F.col("polygon")
    return found.select("drawing_id", "room_id", whole(box["x0"]).alias("x"), whole(box["y0"]).alias("y"), whole(F.col("area")).alias("area"), whole(polygons.perimeter(p)).alias("around"), F.size(polygons.holes(p)).cast("bigint").alias("n_holes"))


@query(_with(ROOM, "n AS (SELECT drawing_id, count(*) AS k, count(*) FILTER (ord % 4 = 0) AS r FROM room GROUP BY drawing_id)",
    select="SELECT drawing_id, 2 * (4 + 4 * k + 2 * r) - 6 AS n_triangles, 4 + 4 * k + r AS n_walls, CAST(4 AS BIGINT) AS n_rim, CAST(336000000 AS BIGINT) AS area2, k + 1 AS n_areas, k AS n_holes FROM n"))
def wall_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with posts just under long walls, which a plain Delaunay mesh would cross: triangles, sides that are walls, and areas."""
    r = D.rooms(spark, sf_dir).selectExpr("*", "4000 * (ord % 4) AS a", "3500 * (ord div 4) AS b")
    mesh = materialise_rows(M.constrained_mesh(_walls(r, *_box_walls("0", "0", 16000, 10500, "ord = 0"), _wall("100", "b + 3400", "15900", "b + 3400", "ord % 4 = 0"), *_box_walls("a + 1000 + event_id % 1000", "b + 2980", 400, 400))), "mesh")
    typed = materialise_rows(M.typed_sides(mesh), "mesh-sides")
    side = lambda i: F.when(F.col(f"wall{i}"), F.when(F.col(f"other{i}").isNull(), 2).otherwise(1)).otherwise(0)
    rim = lambda i: F.col(f"other{i}").isNull().cast("int")
    sides = (F.sum(side(0) + side(1) + side(2)).alias("w"), F.sum(rim(0) + rim(1) + rim(2)).alias("n_rim"))
    size = mesh.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_triangles"), whole(2 * F.sum(M.triangle_area())).alias("area2"), *sides)
    areas = M.area_polygons(typed, M.filled(typed).where("not exterior")).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_areas"), F.sum(F.size(polygons.holes(F.col("polygon")))).alias("n_holes"))
    return size.join(areas, "drawing_id").select("drawing_id", "n_triangles", F.expr("w div 2").alias("n_walls"), "n_rim", "area2", "n_areas", "n_holes")


# ----------------------------------------------------------- spatial joins


@query(_with(ROOM, FURNITURE, IN_ROOM, select="SELECT drawing_id, uid, specific_type, room_id FROM in_room"))
def furniture_in_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.furniture_in_rooms(D.furniture(spark, sf_dir), D.rooms(spark, sf_dir)).select("drawing_id", "uid", "specific_type", "room_id")


@query(_with(ROOM, select="SELECT drawing_id, room_id, CASE WHEN event_id % 9 = 0 THEN CASE WHEN sem IN ('Unknown', 'Corridor') THEN 'Corridor' ELSE sem || '|Corridor' END WHEN sem = 'Unknown' THEN '' ELSE sem END AS types, CAST(CASE WHEN sem = 'Unknown' THEN 0 ELSE 1 END + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_anchors FROM room"))
def text_in_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(f"t:{t}", t) for t in sorted(set(D.TYPES))], "raw_text string, std_label string")
    typed = N.type_texts(D.room_texts(spark, sf_dir), mapping)
    rooms = D.rooms(spark, sf_dir).select("drawing_id", "room_id", "ord", "ring")
    return N.types_from_texts(rooms, typed).select("drawing_id", "room_id", F.array_join("types", "|").alias("types"), F.coalesce(F.size("anchors"), F.lit(0)).cast("bigint").alias("n_anchors"))


@query(_with(ROOM, select="""SELECT w.drawing_id, 'W_' || w.event_id AS uid, r.room_id FROM room w JOIN room r ON w.drawing_id = r.drawing_id AND w.event_id % 2 = 0
 AND pow(greatest(r.x0 - w.x1, w.x1 - r.x1, 0), 2) + pow(greatest(r.y0 - (w.y0 + w.y1) / 2, (w.y0 + w.y1) / 2 - r.y1, 0), 2) < 90000"""))
def window_near_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.rooms(spark, sf_dir)
    y = (F.col("y0") + F.col("y1")) / 2
    w = r.where("event_id % 2 = 0").select("drawing_id", F.concat(F.lit("W_"), F.col("event_id").cast("string")).alias("uid"), G.rectangle(F.col("x1") - 50, y - 600, F.col("x1") + 50, y + 600).alias("ring"))
    return P.windows_of_rooms(w, r).select("drawing_id", "uid", "room_id")


@query(_with(ROOM, DOOR, select="""SELECT drawing_id, uid, room_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, uid ORDER BY d2, ord) AS rank FROM (SELECT d.drawing_id, d.uid, r.room_id, r.ord,
 pow(greatest(r.x0 - xc - 100, xc - 100 - r.x1, 0), 2) + pow(greatest(r.y0 - hi, lo - r.y1, 0), 2) AS d2 FROM door d JOIN room r ON d.drawing_id = r.drawing_id) WHERE d2 <= 0.25) WHERE rank = 1 OR rank = 2 AND d2 < 0.16"""))
def door_nearest_two_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.nearest_rooms(D.doors(spark, sf_dir), D.rooms(spark, sf_dir))
    return found.select("drawing_id", "uid", "room_id", F.col("rank").cast("bigint").alias("rank"))


TOUCH = """touch AS (SELECT a.drawing_id, a.room_id AS u, b.room_id AS v, CASE WHEN a.x1 = b.x0 OR a.x0 = b.x1 THEN greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0 END + CASE WHEN a.y1 = b.y0 OR a.y0 = b.y1 THEN greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) ELSE 0 END AS shared
 FROM room a JOIN room b ON a.drawing_id = b.drawing_id AND a.ord < b.ord AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""


@query(_with(ROOM, TOUCH, select="SELECT drawing_id, u, v, shared FROM touch"))
def room_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.touching_rooms(D.rooms(spark, sf_dir)).select("drawing_id", "u", "v", whole(F.col("shared")).alias("shared"))


@query(_with(ROOM, TOUCH, select="SELECT drawing_id, u, v, shared FROM touch WHERE shared > 1"))
def shared_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.touching_rooms(D.rooms(spark, sf_dir), min_shared=1.0).select("drawing_id", "u", "v", whole(F.col("shared")).alias("shared"))


@query(_with(ROOM, """gap AS (SELECT r.drawing_id, r.room_id AS u, s.room_id AS v, CASE WHEN abs(s.x0 - r.x1 + 1) <= 1 THEN greatest(0, least(r.y1, s.y1) - greatest(r.y0, s.y0)) ELSE 0 END
 + CASE WHEN abs(s.y0 - r.y1) <= 1 THEN greatest(0, least(r.x1, s.x1) - 1 - greatest(r.x0, s.x0)) ELSE 0 END AS shared FROM room r JOIN room s ON r.drawing_id = s.drawing_id AND r.ord < s.ord)""", select="SELECT * FROM gap WHERE shared > 10"))
def near_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls that rooms share if a millimetre may lie between them; every room ends one before its right side."""
    r = D.rooms(spark, sf_dir).withColumn("ring", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1")))
    return P.touching_rooms(r, min_shared=10.0, tolerance=1.0).select("drawing_id", "u", "v", whole(F.col("shared")).alias("shared"))


@query(_with(ROOM, DOOR, BOUND, select="SELECT drawing_id, uid, array_to_string(e, '|') AS ends FROM ends"))
def door_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = P.bind_doors(D.doors(spark, sf_dir), D.rooms(spark, sf_dir))
    return bound.select("drawing_id", "uid", F.array_join("ends", "|").alias("ends"))


@query(_with(ROOM, DOOR, BOUND, TOUCH, select=f"SELECT DISTINCT drawing_id, e[1] AS u, e[2] AS v, 'door' AS kind FROM ends WHERE len(e) = 2 AND e[2] <> '{EXTERIOR_ID}' UNION ALL SELECT drawing_id, u, v, 'touch' FROM touch t WHERE NOT EXISTS (SELECT 1 FROM ends x WHERE x.drawing_id = t.drawing_id AND x.e[1] = u AND x.e[2] = v)"))
def adjacency_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = D.rooms(spark, sf_dir)
    return P.adjacency(rooms, P.bind_doors(D.doors(spark, sf_dir), rooms)).select("drawing_id", "u", "v", "kind")


@query(_with(ROOM, FURNITURE, select="""SELECT drawing_id, uid, min_by(room_id, ord) AS room_id FROM (SELECT f.drawing_id, f.uid, r.room_id, r.ord, pow(greatest(r.x0 - x, x - r.x1, 0), 2) + pow(greatest(r.y0 - y, y - r.y1, 0), 2) AS d2
 FROM furniture f JOIN room r ON f.drawing_id = r.drawing_id) WHERE d2 < 25 GROUP BY ALL"""))
def facility_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.furniture(spark, sf_dir).select("drawing_id", "uid", "x", "y")
    return P.first_room(points, D.rooms(spark, sf_dir)).select("drawing_id", "uid", "room_id")


# -------------------------------------------------------------- enrichment


@query(_with(ROOM, FURNITURE, IN_ROOM, GRID, select="""SELECT drawing_id, room_id, CASE
 WHEN list_contains(it, 'bed') AND list_has_any(it, ['sofa', 'TV cabinet']) THEN 'Bedroom|LivingRoom' WHEN list_contains(it, 'bed') THEN 'Bedroom'
 WHEN list_has_any(it, ['toilet', 'squat toilet', 'bath', 'bath tub', 'urinal']) THEN 'Bathroom' WHEN list_contains(it, 'stairs') THEN 'Stairwell' WHEN list_contains(it, 'elevator') THEN 'ElevatorShaft'
 WHEN list_has_any(it, ['gas stove', 'sink', 'refrigerator']) THEN 'Kitchen' WHEN list_contains(it, 'sofa') AND list_contains(it, 'table') THEN 'LivingRoom|DiningRoom' WHEN list_has_any(it, ['sofa', 'TV cabinet']) THEN 'LivingRoom'
 WHEN list_contains(it, 'table') AND list_contains(it, 'chair') THEN 'DiningRoom' WHEN list_has_any(it, ['washing machine', 'railing']) THEN CASE WHEN a >= 20000000 THEN 'Garden' ELSE 'Balcony' END
 WHEN len(it) > 0 AND len(list_filter(it, lambda x: x NOT IN ('Wardrobe', 'cabinet'))) = 0 AND bed THEN 'Cloakroom' WHEN len(it) > 0 AND len(list_filter(it, lambda x: x <> 'cabinet')) = 0 THEN 'Entrance'
 WHEN len(it) = 0 AND a < 2000000 THEN 'StorageRoom' WHEN len(it) = 0 THEN 'Corridor' ELSE 'Unknown' END AS types
 FROM (SELECT r.drawing_id, r.room_id, (x1 - x0) * (y1 - y0) AS a, coalesce((SELECT list(specific_type) FROM in_room i WHERE i.drawing_id = r.drawing_id AND i.room_id = r.room_id AND specific_type NOT ILIKE '%door%' AND specific_type NOT ILIKE '%window%' AND specific_type <> 'unknown'), []) AS it,
 EXISTS (SELECT 1 FROM arc JOIN room s ON s.drawing_id = arc.drawing_id AND s.room_id = arc.dst WHERE arc.drawing_id = r.drawing_id AND arc.src = r.room_id AND s.sem = 'Bedroom') AS bed FROM room r)"""))
def room_type_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = D.rooms(spark, sf_dir)
    context = N.room_context(rooms, P.furniture_in_rooms(D.furniture(spark, sf_dir), rooms), D.grid_edges(spark, sf_dir))
    return N.infer_types(context.withColumn("types", F.array().cast("array<string>"))).select("drawing_id", "room_id", F.array_join("types", "|").alias("types"))


@query(_with(ROOM, GRID, PUBLIC, select="SELECT drawing_id, room_id, CAST(d_public AS BIGINT) AS d_public, CAST(d_private AS BIGINT) AS d_private, is_public FROM public"))
def public_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = N.public_corridors(D.rooms(spark, sf_dir), D.grid_edges(spark, sf_dir))
    return ruled.select("drawing_id", "room_id", F.col("d_public").cast("bigint").alias("d_public"), F.col("d_private").cast("bigint").alias("d_private"), "is_public")


def typed_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = D.rooms(spark, sf_dir).select("drawing_id", "room_id", "ord", "types", "ring")
    return materialise(N.with_public(rooms, N.public_corridors(rooms, D.grid_edges(spark, sf_dir))), "typed")


@query(_with(ROOM, GRID, PUBLIC, DOOR, BOUND, DOOR_TYPE, select="SELECT drawing_id, uid, door_type FROM dtype"))
def door_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = P.bind_doors(D.doors(spark, sf_dir), D.rooms(spark, sf_dir))
    return N.door_types(bound, typed_rooms(spark, sf_dir))


@query(_with(ROOM, GRID, PUBLIC, DOOR, BOUND, DOOR_TYPE, CORRIDOR, select="SELECT drawing_id, room_id, array_to_string(added, '|') AS added FROM ctype"))
def corridor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound, rooms = materialise(P.bind_doors(D.doors(spark, sf_dir), D.rooms(spark, sf_dir)), "bound"), typed_rooms(spark, sf_dir)
    found = N.corridor_types(rooms, D.grid_edges(spark, sf_dir), bound, N.door_types(bound, rooms))
    return found.select("drawing_id", "room_id", F.array_join("added", "|").alias("added"))


@query(_with(ROOM, DOOR, BOUND, select="SELECT e.drawing_id, e.uid, CASE WHEN r.sem = 'Bathroom' THEN r.room_id ELSE s.room_id END AS bathroom, CASE WHEN r.sem = 'Kitchen' THEN r.room_id ELSE s.room_id END AS kitchen FROM ends e JOIN room r ON r.drawing_id = e.drawing_id AND r.room_id = e.e[1] JOIN room s ON s.drawing_id = e.drawing_id AND s.room_id = e.e[2] WHERE (r.sem, s.sem) IN (('Bathroom', 'Kitchen'), ('Kitchen', 'Bathroom'))"))
def bathroom_kitchen_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = D.rooms(spark, sf_dir)
    return N.doors_into_kitchens(P.bind_doors(D.doors(spark, sf_dir), rooms), rooms)


@query(_with(ROOM, GRID, PUBLIC, SUITE, select="SELECT drawing_id, suite_id, room_id FROM suite"))
def suite_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.suites(typed_rooms(spark, sf_dir), D.grid_edges(spark, sf_dir)).select("drawing_id", "suite_id", "room_id")


@query(_with(ROOM, GRID, "far AS (SELECT drawing_id, room_id, 0 AS hops FROM room WHERE ord = 0 UNION SELECT f.drawing_id, dst, hops + 1 FROM far f JOIN arc ON arc.drawing_id = f.drawing_id AND src = f.room_id WHERE hops < 12)", select="SELECT r.drawing_id, r.room_id AS dst, CAST(min(hops) AS BIGINT) AS hops, coalesce(min(hops) BETWEEN 1 AND 2, false) AS near FROM room r LEFT JOIN far f ON r.drawing_id = f.drawing_id AND r.room_id = f.room_id WHERE ord = 11 OR ord = 5 GROUP BY ALL"))
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = D.rooms(spark, sf_dir).where("ord in (5, 11)").select("drawing_id", F.lit("Space_000").alias("src"), F.col("room_id").alias("dst"))
    edges = materialise(graph.undirected(D.grid_edges(spark, sf_dir)), "grid")
    near = graph.within(edges, pairs, 2).withColumn("near", F.lit(True))
    found = graph.shortest_paths(edges, pairs).join(near, ["drawing_id", "src", "dst"], "left")
    return found.select("drawing_id", "dst", (F.size("path") - 1).cast("bigint").alias("hops"), F.coalesce("near", F.lit(False)).alias("near"))


NODE_JSON = """'{"@id":"' || room_id || '","@type":[' || CASE WHEN sem = 'Unknown' THEN '' ELSE '"' || sem || '"' END || '],"geo:asWKT":"POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))"' ||
 coalesce(',"bot:adjacentZone":[' || (SELECT string_agg('{"@id":"' || dst || '"}', ',' ORDER BY dst) FROM arc WHERE arc.drawing_id = room.drawing_id AND src = room_id) || ']', '') || '}'"""


@query(_with(ROOM, GRID, select=f"SELECT drawing_id, room_id, {NODE_JSON} AS json FROM room"))
def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_bodies(spark, sf_dir).select("drawing_id", F.col("node_id").alias("room_id"), "json")


def node_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.rooms(spark, sf_dir).select("drawing_id", F.col("room_id").alias("node_id"), "ord", "types", F.lit(None).cast("string").alias("label"), "ring")
    edges = graph.both_ways(D.grid_edges(spark, sf_dir)).withColumn("pred", F.lit("adjacentZone"))
    return jsonld.node_json(nodes, edges)


@query(_with(ROOM, GRID, select=f"""SELECT drawing_id, '{{"@context":{{"bot":"https://w3id.org/bot#","geo":"http://www.opengis.net/ont/geosparql#"}},"@graph":[' || string_agg(json, ',' ORDER BY ord) || ']}}' AS json FROM (SELECT drawing_id, ord, {NODE_JSON} AS json FROM room) GROUP BY drawing_id"""))
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole graph documents, one for each drawing."""
    return jsonld.graph_json(node_bodies(spark, sf_dir)).select("drawing_id", "json")


# ------------------------------------------------------- reports and views


@query("SELECT p_partkey, p_partkey - 2 * 3 AS x, 3 * p_size + 5 AS y FROM part")
def svg_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform attribute of three calls, applied to the point (p_size, 3)."""
    p = spread(D.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    text = F.concat(F.lit("translate("), F.col("p_partkey").cast("string"), F.lit(" 5) scale(2,3) matrix(0 1 -1 0 0 0)"))
    moved = F.element_at(G.affine(F.array(G.point(F.col("p_size"), F.lit(3))), G.transform_matrix(text)), 1)
    return p.select("p_partkey", whole(moved["x"]).alias("x"), whole(moved["y"]).alias("y"))


@query(_with(ROOM, DOOR, select="""SELECT drawing_id, 'LWPOLYLINE' AS kind, count(*) AS n FROM room GROUP BY drawing_id UNION ALL SELECT drawing_id, 'LINE', count(*) FROM door GROUP BY drawing_id"""))
def entity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.kind_counts(entities(spark, sf_dir)).select(F.col("drawing").cast("bigint").alias("drawing_id"), "kind", "n")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms as polylines and doors as lines, in the columns of the DXF source."""
    none = [F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("radius")]
    make = lambda df, kind, layer, coords: df.select(F.col("drawing_id").cast("string").alias("drawing"), F.lit(0).alias("ord"), F.lit(kind).alias("kind"), layer.alias("layer"), *none, coords.alias("coords"))
    rooms = make(D.rooms(spark, sf_dir), "LWPOLYLINE", F.concat(F.lit("gt_"), "sem"), F.concat("ring", F.slice("ring", 1, 1)))
    x = (F.col("x0") + F.col("x1")) / 2
    doors = make(D.doors(spark, sf_dir), "LINE", F.lit("gt_door"), F.array(G.point(x, F.col("y0")), G.point(x, F.col("y1"))))
    return rooms.unionByName(doors)


@query(_with(ROOM, DOOR, """box AS (SELECT drawing_id, min(x0) AS x0, min(y0) AS y0, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM (SELECT drawing_id, x0, y0, x1, y1 FROM room UNION ALL SELECT drawing_id, xc, lo, xc, hi FROM door) GROUP BY drawing_id)""",
    select="SELECT drawing_id, greatest(w, h) AS longest, greatest(w, h) - w - 2 * x0 AS dx2, greatest(w, h) - h - 2 * y0 AS dy2 FROM box"))
def drawing_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and offsets that fit a drawing into the square; offsets doubled, as whole numbers."""
    e = entities(spark, sf_dir)
    moved = dxf.calibration(e).join(dxf.fit_scale(e).select("drawing", "scale"), "drawing")
    return moved.select(F.col("drawing").cast("bigint").alias("drawing_id"), whole(140 / F.col("scale")).alias("longest"), whole(2 * F.col("delta_x")).alias("dx2"), whole(2 * F.col("delta_y")).alias("dy2"))


@query(_with(ROOM, DOOR, """p AS (SELECT drawing_id, x0 AS x, y0 AS y FROM room UNION ALL SELECT drawing_id, x1, y1 FROM room UNION ALL SELECT drawing_id, xc, lo FROM door UNION ALL SELECT drawing_id, xc, hi FROM door),
 box AS (SELECT drawing_id, min(x) AS a, min(y) AS b, max(x) - min(x) AS w, max(y) - min(y) AS h, least(140 / (max(x) - min(x)), 140 / (max(y) - min(y))) AS k FROM p GROUP BY drawing_id)""",
    select="SELECT drawing_id, CAST(sum(round_even(1000 * ((x - a) * k + (140 - w * k) / 2), 0)) AS BIGINT) AS x, CAST(sum(round_even(1000 * (140 - ((y - b) * k + (140 - h * k) / 2)), 0)) AS BIGINT) AS y FROM p JOIN box USING (drawing_id) GROUP BY drawing_id"))
def square_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the corners of rooms (two of each) and the ends of doors, in thousandths of the square's units."""
    held = dxf.to_svg_units(entities(spark, sf_dir))
    ends = F.when(F.col("kind") == "LINE", F.col("coords")).otherwise(F.array(F.element_at("coords", 1), F.element_at("coords", 3)))
    p = held.select(F.col("drawing").cast("bigint").alias("drawing_id"), F.explode(ends).alias("p"))
    return p.groupBy("drawing_id").agg(F.sum(whole(1000 * F.col("p.x"))).alias("x"), F.sum(whole(1000 * F.col("p.y"))).alias("y"))


# ------------------------------------------------------- drawing files

PALETTE = """tone AS (SELECT i, CASE WHEN i BETWEEN 10 AND 249 THEN [list_transform([i // 10 - 1, i // 10 + 15, i // 10 + 7], lambda k: 255 * least(4, greatest(0, 8 - least(k % 24, (24 - k % 24) % 24))) // 4)] END AS vivid, [255, 165, 127, 76, 38][i % 10 // 2 + 1] AS level FROM (SELECT unnest(range(1, 256)) AS i)),
 colour AS (SELECT i, CASE WHEN i < 10 THEN [[255, 0, 0], [255, 255, 0], [0, 255, 0], [0, 255, 255], [0, 0, 255], [255, 0, 255], [255, 255, 255], [128, 128, 128], [192, 192, 192]][i] WHEN i > 249 THEN list_transform([0, 0, 0], lambda x: [51, 80, 105, 130, 190, 255][i - 249])
 ELSE list_transform(vivid[1], lambda c: (2 * level * CASE WHEN i % 2 = 1 THEN (c + 255) // 2 ELSE c END + 255) // 510) END AS c FROM tone)"""
FILED = """item AS (SELECT drawing_id, 'LWPOLYLINE' AS kind, 'L' || ord AS layer, '' AS text, 5 AS n_points, x0 AS x, CASE WHEN user_id % 4 = 0 THEN 1 + 7 * event_id % 255 WHEN user_id % 4 <> 2 THEN 1 + event_id % 255 END AS i, 65537 * event_id % 16777216 AS rgb FROM room
 UNION ALL SELECT drawing_id, 'LINE', 'L' || ord, '', 2, x0, 1 + event_id % 255, NULL FROM room WHERE ord % 3 = 0 UNION ALL SELECT DISTINCT drawing_id, 'MTEXT', '0', 'Plan' || chr(10) || 'no ' || drawing_id, 1, 0, 7, NULL FROM room),
 hue AS (SELECT item.*, coalesce(c, [rgb // 65536, rgb // 256 % 256, rgb % 256]) AS c FROM item LEFT JOIN colour USING (i)),
 seen AS (SELECT *, CASE WHEN c = [255, 255, 255] THEN [0, 0, 0] WHEN 299 * c[1] + 587 * c[2] + 114 * c[3] > 200000 THEN list_transform(c, lambda x: x // 2) ELSE c END AS s FROM hue)"""


def dxf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing, value: DXF texts of rooms in colours of all kinds, lines in a block that is inserted on every third room's layer, and a title."""
    pairs = lambda *p: F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    number, layer = F.col("event_id"), F.concat(F.lit("L"), F.col("ord"))
    kind = F.col("user_id") % 4
    colour = F.when(kind == 0, pairs("62", 1 + 7 * number % 255)).when(kind == 2, pairs("420", 65537 * number % 16777216)).when(kind == 3, F.lit("62\n256"))
    corners = F.array_join(F.transform("ring", lambda p: pairs("10", p["x"], "20", p["y"])), "\n")
    room = pairs("0", "LWPOLYLINE", "8", layer, colour, "70", "1", corners)
    insert = F.when(F.col("ord") % 3 == 0, pairs("0", "INSERT", "2", "B", "8", layer, "10", F.col("x0"), "20", F.col("y0")))
    rows = D.rooms(spark, sf_dir).select("drawing_id", "ord", pairs("0", "LAYER", "2", layer, "62", 1 + number % 255).alias("table"), F.concat_ws("\n", room, insert).alias("body"))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda r: r[c]), "\n")
    block = F.lit("0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n10\n0\n20\n0\n0\nLINE\n8\n0\n62\n0\n10\n0\n20\n0\n11\n10\n21\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES")
    title = F.concat(F.lit("0\nMTEXT\n8\n0\n10\n0\n20\n0\n3\n{\\fArial|b0;Plan\\P\n1\nno "), F.col("drawing_id").cast("string"), F.lit("}"))
    text = F.concat_ws("\n", F.lit("0\nSECTION\n2\nTABLES"), listed("table"), block, listed("body"), F.any_value(title), F.lit("0\nENDSEC\n0\nEOF"))
    return rows.groupBy("drawing_id").agg(text.alias("value")).select(F.col("drawing_id").cast("string").alias("drawing"), "value")


def filed(documents: DataFrame, suffix: str) -> str:
    """The folder in which the documents now stand as files."""
    files.register(documents.sparkSession)
    path = fresh_path(documents.sparkSession, "drawings")
    documents.write.format("floorlens_documents").option("suffix", suffix).mode("append").save(path)
    return path


@query(_with(ROOM, PALETTE, FILED, select="SELECT drawing_id, kind, layer, text, CAST(n_points AS BIGINT) AS n_points, CAST(x AS BIGINT) AS x, CAST(s[1] AS BIGINT) AS r, CAST(s[2] AS BIGINT) AS g, CAST(s[3] AS BIGINT) AS b FROM seen"))
def drawing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of DXF files, written and read through the data sources: places, texts and colours as shown."""
    found = spark.read.format("floorlens_dxf").load(filed(dxf_documents(spark, sf_dir), ".dxf"))
    shown = T.shown_colour(F.col("rgb.r"), F.col("rgb.g"), F.col("rgb.b"))
    return found.select(F.col("drawing").cast("bigint").alias("drawing_id"), "kind", "layer", F.coalesce("text", F.lit("")).alias("text"), F.size("coords").cast("bigint").alias("n_points"), whole(F.element_at("coords", 1)["x"]).alias("x"), *(shown[k].cast("bigint").alias(k) for k in "rgb"))


@query(_with(ROOM, select="SELECT drawing_id, room_id, (x1 - x0) * (y1 - y0) AS area, x0, y1 AS top FROM room"))
def svg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of SVG files, written and read through the data sources."""
    documents = svg.room_svgs(D.rooms(spark, sf_dir), 0.01).select(F.col("drawing_id").cast("string").alias("drawing"), F.col("svg").alias("value"))
    found = svg.rooms_of(spark.read.format("floorlens_svg").option("tags", "path").load(filed(documents, ".svg")), 0.01)
    box = G.bounds(F.col("ring"))
    return found.select(F.col("drawing").cast("bigint").alias("drawing_id"), "room_id", whole(G.area(F.col("ring"))).alias("area"), whole(box["x0"]).alias("x0"), whole(box["y1"]).alias("top"))


@query(_with(ROOM, """made AS (SELECT drawing_id, room_id, event_id % 6 AS kind, (x1 - x0) * (y1 - y0) AS whole FROM room)""",
    select="SELECT drawing_id, room_id, ['sound', 'mended', 'lost', 'mended', 'mended', 'mended'][1 + kind] AS state, CAST([1, 1, 0, 1, 2, 1][1 + kind] AS BIGINT) AS n_parts, CASE kind WHEN 1 THEN whole // 4 WHEN 2 THEN NULL WHEN 4 THEN whole // 2 ELSE whole END AS area FROM made"))
def annotated_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with a repeated corner (sound), crossed, flat, with a spike, pinched at a side, and gone around twice."""
    p = lambda x, y: G.point(F.expr(x), F.expr(y))
    a, b, c, d, pinch = p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("(x0 + x1) div 2", "y0")
    kinds = F.array(F.array(a, b, b, c, d, a), F.array(a, c, b, d), F.array(a, b, pinch), F.array(a, p("x1 + 500", "y0"), b, c, d), F.array(a, b, c, pinch, d), F.array(a, b, c, d, a, b, c, d))
    r = spread(D.rooms(spark, sf_dir), "drawing_id", "room_id").select("drawing_id", "room_id", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("ring"))
    found = dxf.mended_rings(r)
    return found.select("drawing_id", "room_id", "state", F.size("polygon").cast("bigint").alias("n_parts"), F.when(F.col("state") != "lost", whole(polygons.area(F.col("polygon")))).alias("area"))


@query(_with(ROOM, DOOR, select=f"""SELECT drawing_id, thing, type, count(*) AS n, CAST(sum(a) AS BIGINT) AS area FROM (SELECT drawing_id, 'room' AS thing, sem AS type, (x1 - x0) * (y1 - y0) AS a FROM room WHERE sem <> 'Unknown'
 UNION ALL SELECT drawing_id, 'door', NULL, 0 FROM door) GROUP BY ALL"""))
def annotated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dxf.annotated(entities(spark, sf_dir)).groupBy("drawing", "thing", "type").agg(F.count(F.lit(1)).alias("n"), whole(F.sum(G.area(F.col("ring")))).alias("area"))
    return found.select(F.col("drawing").cast("bigint").alias("drawing_id"), "thing", "type", "n", "area")


@query(_with(ROOM, GRID, select="""SELECT r.drawing_id, r.room_id, CASE WHEN r.ord % 3 > 0 THEN 1 ELSE (SELECT count(*) FROM arc a JOIN room s ON s.drawing_id = a.drawing_id AND s.room_id = a.dst AND s.ord % 3 > 0 WHERE a.drawing_id = r.drawing_id AND a.src = r.room_id) END AS n_rings,
 CAST(CASE WHEN r.ord % 3 > 0 THEN (r.x1 - r.x0) * (r.y1 - r.y0) ELSE coalesce((SELECT sum((s.x1 - s.x0) * (s.y1 - s.y0)) FROM arc a JOIN room s ON s.drawing_id = a.drawing_id AND s.room_id = a.dst AND s.ord % 3 > 0 WHERE a.drawing_id = r.drawing_id AND a.src = r.room_id), 0) END AS BIGINT) AS area
 FROM room r WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000"""))
def report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that a report draws for small bedrooms; every third room has no ring of its own."""
    nodes = D.rooms(spark, sf_dir).select("drawing_id", F.col("room_id").alias("node_id"), "types", (G.area(F.col("ring")) / 1e6).alias("area_m2"), F.when(F.col("ord") % 3 > 0, F.col("ring")).alias("ring"))
    edges = D.grid_edges(spark, sf_dir).select("drawing_id", F.col("u").alias("src"), F.col("v").alias("dst"))
    broken = materialise(rules.violations(nodes, None, rules=[r for r in rules.RULES if r[0] == "R11"]), "broken")
    area = F.aggregate("rings", F.lit(0.0), lambda a, r: a + G.area(r))
    return rules.report_shapes(broken, nodes, edges).select("drawing_id", F.col("node_id").alias("room_id"), F.size("rings").cast("bigint").alias("n_rings"), whole(area).alias("area"))


@query(_with(ROOM, select="""SELECT count(*) FILTER (n = 0) AS n_passed, count(*) FILTER (n > 0) AS n_failed, CAST(sum(n) AS BIGINT) AS n_violations FROM
 (SELECT drawing_id, count(*) FILTER (sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000) AS n FROM room GROUP BY drawing_id)"""))
def drawing_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many drawings pass the area rule of bedrooms."""
    nodes = D.rooms(spark, sf_dir).select("drawing_id", F.col("room_id").alias("node_id"), "types", (G.area(F.col("ring")) / 1e6).alias("area_m2"))
    return rules.tally(nodes, rules.violations(nodes, None, rules=[r for r in rules.RULES if r[0] == "R11"]))


@query(_with(ROOM, DOOR, BOUND, GRID, select="""SELECT drawing_id, room_id AS u, NULL AS v, 'space' AS kind FROM room UNION ALL SELECT drawing_id, uid, NULL, 'door' FROM ends WHERE len(e) > 0
 UNION ALL SELECT DISTINCT drawing_id, least(u, v), greatest(u, v), 'adjacent' FROM edge UNION ALL SELECT drawing_id, uid, room_id, 'interface' FROM (SELECT drawing_id, uid, unnest(e) AS room_id FROM ends) WHERE room_id LIKE 'Space%'"""))
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (v is null) and edges of rooms and doors."""
    rooms = D.rooms(spark, sf_dir)
    bound = materialise(P.bind_doors(D.doors(spark, sf_dir), rooms), "bound")
    nodes, edges = P.graph_view(rooms, bound, D.grid_edges(spark, sf_dir))
    return nodes.select("drawing_id", F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), "kind").unionByName(edges)


@query(_with(ROOM, DOOR, GRID, PUBLIC, SUITE, select="""SELECT r.drawing_id, count(*) AS n_rooms, (SELECT count(*) FROM door d WHERE d.drawing_id = r.drawing_id) AS n_doors,
 (SELECT count(*) FROM (SELECT DISTINCT u, v FROM edge e WHERE e.drawing_id = r.drawing_id)) AS n_edges, (SELECT count(DISTINCT suite_id) FROM suite s WHERE s.drawing_id = r.drawing_id) AS n_suites FROM room r GROUP BY r.drawing_id"""))
def drawing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = D.grid_edges(spark, sf_dir)
    return P.drawing_summary(D.rooms(spark, sf_dir), D.doors(spark, sf_dir), edges, N.suites(typed_rooms(spark, sf_dir), edges))


@query(_with(ROOM, select=f"SELECT r.drawing_id, 'N_' || r.event_id AS uid, CASE WHEN r.event_id % 2 = 0 THEN r.room_id ELSE s.room_id END AS a, CASE WHEN r.event_id % 2 = 0 THEN s.room_id ELSE '{EXTERIOR_ID}' END AS b FROM room r JOIN room s ON s.event_id = r.event_id + 1 WHERE r.ord % 4 < 3 AND r.user_id % 3 = 0"))
def unhit_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors in the gaps between rooms, which touch no wall: what is nearer than 300 mm is theirs, on both sides or on one."""
    rooms = D.rooms(spark, sf_dir)
    most = rooms.agg(F.max("event_id").alias("most"))
    gaps = rooms.join(F.broadcast(most)).where("ord % 4 < 3 AND user_id % 3 = 0 AND event_id < most").withColumns({"lo": F.expr("x1 + IF(event_id % 2 = 0, 150, 320)"), "hi": F.expr("x1 + IF(event_id % 2 = 0, 350, 450)")})
    doors = gaps.select("drawing_id", F.concat(F.lit("N_"), "event_id").alias("uid"), G.rectangle(F.col("lo"), F.col("y0") + 1000, F.col("hi"), F.col("y0") + 1700).alias("ring"))
    return P.bind_doors(doors, rooms).select("drawing_id", "uid", F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"))


@query(_with(ROOM, DOOR, select="""SELECT d.drawing_id, d.uid, count(r.room_id) = 1 AND max(hi - lo) >= 850 AND NOT bool_or(r.sem = 'Balcony') AS is_entrance FROM door d LEFT JOIN room r ON d.drawing_id = r.drawing_id
 AND pow(greatest(r.x0 - xc - 100, xc - 100 - r.x1, 0), 2) + pow(greatest(r.y0 - hi, lo - r.y1, 0), 2) < 0.16 GROUP BY ALL"""))
def outer_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms, doors = D.rooms(spark, sf_dir), D.doors(spark, sf_dir)
    return N.outer_doors(P.nearest_rooms(doors, rooms), doors, rooms)


@query(_with(ROOM, FURNITURE, IN_ROOM, GRID, select="""SELECT drawing_id, '[' || string_agg('{"room_id":"' || room_id || '","area":' || CAST((x1 - x0) * (y1 - y0) / 1e6 AS DOUBLE) || ',"furniture":[' || it || '],"neighbours":[' || near || ']}', ',' ORDER BY ord) || ']' AS prompt
 FROM (SELECT *, coalesce((SELECT string_agg('"' || specific_type || '"', ',' ORDER BY specific_type) FROM in_room i WHERE i.drawing_id = r.drawing_id AND i.room_id = r.room_id AND specific_type NOT ILIKE '%door%' AND specific_type NOT ILIKE '%window%' AND specific_type <> 'unknown'), '') AS it,
 coalesce((SELECT string_agg('"' || dst || '"', ',' ORDER BY dst) FROM arc a WHERE a.drawing_id = r.drawing_id AND a.src = r.room_id), '') AS near
 FROM room r WHERE sem = 'Unknown') GROUP BY drawing_id"""))
def room_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = D.rooms(spark, sf_dir)
    return N.room_prompts(N.room_context(rooms, P.furniture_in_rooms(D.furniture(spark, sf_dir), rooms), D.grid_edges(spark, sf_dir)))


@query(_with(ROOM, FURNITURE, IN_ROOM, select="""SELECT kind, shown, count(*) AS n FROM (SELECT 'space' AS kind, sem AS shown FROM room UNION ALL SELECT CASE WHEN specific_type LIKE '%door%' THEN 'door' ELSE 'facility' END, specific_type FROM furniture) GROUP BY ALL"""))
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes split into spaces, doors and facilities."""
    tag = F.transform("types", lambda t: F.concat(F.lit("bldg:"), t))
    spaces = D.rooms(spark, sf_dir).select("drawing_id", F.col("room_id").alias("node_id"), F.concat(F.array(F.lit("bot:Space")), tag).alias("types"), "ring")
    word = F.when(F.col("specific_type").contains("door"), F.concat(F.lit("Door "), "specific_type")).otherwise(F.col("specific_type"))
    things = D.furniture(spark, sf_dir).select("drawing_id", F.col("uid").alias("node_id"), F.array(F.lit("bot:Element"), F.concat(F.lit("beo:"), word)).alias("types"), "ring")
    kinds = jsonld.node_kinds(spaces.unionByName(things).withColumnRenamed("drawing_id", "drawing"))
    return kinds.groupBy("kind", F.regexp_replace("shown", "^(bldg:|beo:(Door )?)", "").alias("shown")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- rules


def rule_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (rooms, doors, furniture, suites) with measures, and edges, of the enriched plans."""
    rooms, grid = typed_rooms(spark, sf_dir), D.grid_edges(spark, sf_dir)
    bound = materialise(P.bind_doors(D.doors(spark, sf_dir), rooms), "bound")
    kinds = materialise(N.door_types(bound, rooms), "door-types")
    rooms = N.measure_rooms(N.with_types(rooms, N.corridor_types(rooms, grid, bound, kinds)))
    no = F.lit(None).cast("double")
    nodes = rooms.select("drawing_id", F.col("room_id").alias("node_id"), "types", F.lit(None).cast("string").alias("label"), "area_m2", "short_side_m", "clear_width_m", no.alias("door_width_mm"))
    doors = N.measure_doors(D.doors(spark, sf_dir)).join(kinds, ["drawing_id", "uid"])
    nodes = nodes.unionByName(doors.select("drawing_id", F.col("uid").alias("node_id"), F.array("door_type").alias("types"), F.lit("single door").alias("label"), no.alias("area_m2"), no.alias("short_side_m"), no.alias("clear_width_m"), (1000 * F.col("clear_width_m")).alias("door_width_mm")))
    things = D.furniture(spark, sf_dir)
    nodes = nodes.unionByName(things.select("drawing_id", F.col("uid").alias("node_id"), F.array(F.lit("Element")).alias("types"), F.col("specific_type").alias("label"), *(no.alias(c) for c in ("area_m2", "short_side_m", "clear_width_m", "door_width_mm"))))
    suites = N.suites(rooms, grid)
    nodes = nodes.unionByName(suites.select("drawing_id", F.col("suite_id").alias("node_id")).distinct().select("*", F.array(F.lit("Suite")).alias("types"), F.lit(None).cast("string").alias("label"), *(no.alias(c) for c in ("area_m2", "short_side_m", "clear_width_m", "door_width_mm"))))
    edges = graph.both_ways(grid).select("drawing_id", "src", F.lit("adjacentZone").alias("pred"), "dst")
    edges = edges.unionByName(suites.select("drawing_id", F.col("suite_id").alias("src"), F.lit("hasSpace").alias("pred"), F.col("room_id").alias("dst")))
    held = P.furniture_in_rooms(things, rooms)
    edges = edges.unionByName(held.select("drawing_id", F.col("room_id").alias("src"), F.lit("containsElement").alias("pred"), F.col("uid").alias("dst")))
    return materialise(nodes, "nodes"), materialise(edges, "edges")


def _level(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    nodes, edges = rule_tables(spark, sf_dir)
    found = rules.violations(nodes, edges, [level])
    return found.groupBy("drawing_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node"))


ALL = (ROOM, GRID, PUBLIC, SUITE, DOOR, BOUND, DOOR_TYPE, CORRIDOR, FURNITURE, IN_ROOM)
_TALLY = "SELECT drawing_id, rule_id, count(*) AS n, min(node_id) AS first_node FROM ({}) GROUP BY drawing_id, rule_id"


def _some(rule: str, sem: str, labels: list[str]) -> str:
    return f"SELECT drawing_id, '{rule}' AS rule_id, room_id AS node_id FROM room r WHERE sem = '{sem}' AND NOT EXISTS (SELECT 1 FROM in_room i WHERE i.drawing_id = r.drawing_id AND i.room_id = r.room_id AND specific_type IN ({', '.join(repr(x) for x in labels)}))"


def _beside(rule: str, sem: str, other: str) -> str:
    return f"SELECT drawing_id, '{rule}' AS rule_id, room_id AS node_id FROM room r WHERE sem = '{sem}' AND NOT EXISTS (SELECT 1 FROM arc a JOIN room s ON s.drawing_id = a.drawing_id AND s.room_id = a.dst WHERE a.drawing_id = r.drawing_id AND a.src = r.room_id AND s.sem = '{other}')"


def _has(rule: str, sem: str) -> str:
    return f"SELECT drawing_id, '{rule}' AS rule_id, suite_id AS node_id FROM suite s JOIN room r USING (drawing_id, room_id) GROUP BY ALL HAVING count(*) FILTER (sem = '{sem}') = 0"


L1 = " UNION ALL ".join([*(_has(f"R{i + 1}", t) for i, t in enumerate(("Bedroom", "LivingRoom", "Kitchen", "Bathroom", "Entrance"))), _some("R6", "Kitchen", ["sink"]), _some("R7", "Kitchen", ["gas stove"]), _some("R8", "Bathroom", ["toilet", "squat toilet"]), _some("R9", "Bathroom", ["bath", "bath tub"]), _some("R10", "Bathroom", ["sink"])])
L2 = """SELECT drawing_id, 'R11' AS rule_id, room_id AS node_id FROM room WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000
 UNION ALL SELECT d.drawing_id, CASE door_type WHEN 'EntranceDoor' THEN 'R16' WHEN 'BedroomDoor' THEN 'R17' ELSE 'R18' END, d.uid FROM door d JOIN dtype t ON d.drawing_id = t.drawing_id AND d.uid = t.uid WHERE door_type = 'EntranceDoor' AND hi - lo < 900 OR door_type = 'BedroomDoor' AND hi - lo < 800 OR door_type IN ('KitchenDoor', 'BathroomDoor') AND hi - lo < 700"""
L3 = "SELECT a.drawing_id, 'R19' AS rule_id, a.src AS node_id FROM arc a JOIN room r ON r.drawing_id = a.drawing_id AND r.room_id = a.src AND r.sem = 'Bathroom' JOIN room s ON s.drawing_id = a.drawing_id AND s.room_id = a.dst AND s.sem = 'Kitchen'"
EXP = " UNION ALL ".join(["SELECT drawing_id, 'R23' AS rule_id, room_id AS node_id FROM room WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) <= 12000000", _beside("R24", "LivingRoom", "Balcony"), _beside("R25", "Kitchen", "DiningRoom"), _some("R26", "Kitchen", ["sink"]), _some("R27", "Kitchen", ["gas stove"])])


@query(_with(*ALL, select=_TALLY.format(L1)))
def rules_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, "L1")


@query(_with(*ALL, select=_TALLY.format(L2)))
def rules_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, "L2")


@query(_with(*ALL, select=_TALLY.format(L3)))
def rules_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, "L3")


@query(_with(*ALL, select=_TALLY.format(EXP)))
def rules_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, "exp")


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix bot: <https://w3id.org/bot#> .
@prefix props: <http://example.org/props/> . @prefix bldg: <http://example.org/bldg/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
bldg:Sizes a sh:NodeShape ; sh:targetClass bldg:Bedroom , bldg:DiningRoom ; sh:property [ sh:path props:hasArea ; sh:minInclusive 12.25 ; sh:maxExclusive 14.0 ] .
bldg:Cooking a sh:NodeShape ; sh:targetClass bldg:Kitchen ;
  sh:property [ sh:path bot:containsElement ; sh:qualifiedValueShape [ sh:property [ sh:path rdfs:label ; sh:in ( "sink" "gas stove" ) ] ] ; sh:qualifiedMinCount 1 ] ;
  sh:property [ sh:path bot:adjacentZone ; sh:node [ sh:not [ sh:class bldg:Bathroom ] ] ; sh:message "not beside a bathroom" ] .
bldg:Living a sh:NodeShape ; sh:targetClass bldg:LivingRoom ; # two bedrooms at least, one corridor at most
  sh:property [ sh:path bot:adjacentZone ; sh:qualifiedValueShape [ sh:class bldg:Bedroom ] ; sh:qualifiedMinCount 2 ] ;
  sh:property [ sh:path bot:adjacentZone ; sh:qualifiedValueShape [ sh:class bldg:Corridor ] ; sh:qualifiedMaxCount 1 ] .
"""
_AROUND = "around AS (SELECT r.drawing_id, r.room_id, r.sem, count(*) FILTER (s.sem = 'Bedroom') AS beds, count(*) FILTER (s.sem = 'Corridor') AS ways, count(*) FILTER (s.sem = 'Bathroom') AS baths FROM room r LEFT JOIN arc a ON a.drawing_id = r.drawing_id AND a.src = r.room_id LEFT JOIN room s ON s.drawing_id = a.drawing_id AND s.room_id = a.dst GROUP BY ALL)"


@query(_with(ROOM, GRID, FURNITURE, IN_ROOM, _AROUND, select="SELECT drawing_id, rule_id, count(*) AS n, min(node_id) AS first_node FROM (" + " UNION ALL ".join([
    "SELECT drawing_id, room_id AS node_id, unnest(list_filter([CASE WHEN (x1 - x0) * (y1 - y0) < 12250000 THEN 'own:Sizes.1' END, CASE WHEN (x1 - x0) * (y1 - y0) >= 14000000 THEN 'own:Sizes.2' END], lambda x: x IS NOT NULL)) AS rule_id FROM room WHERE sem IN ('Bedroom', 'DiningRoom')",
    "SELECT drawing_id, node_id, rule_id FROM (" + _some("own:Cooking.1", "Kitchen", ["sink", "gas stove"]) + ")",
    "SELECT drawing_id, room_id, 'own:Cooking.2' FROM (SELECT drawing_id, room_id, unnest(range(baths)) FROM around WHERE sem = 'Kitchen')",
    "SELECT drawing_id, room_id, unnest(list_filter([CASE WHEN beds < 2 THEN 'own:Living.1' END, CASE WHEN ways > 1 THEN 'own:Living.2' END], lambda x: x IS NOT NULL)) FROM around WHERE sem = 'LivingRoom'",
]) + ") GROUP BY drawing_id, rule_id"))
def shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a Turtle file, read, compiled and checked on the derived rooms."""
    files.register(spark)
    path = fresh_path(spark, "rules")
    spark.createDataFrame([("own", SHAPES)], "drawing string, value string").write.format("floorlens_documents").option("suffix", ".ttl").mode("append").save(path)
    nodes, edges = rule_tables(spark, sf_dir)
    found = rules.violations(nodes, edges, rules=shapes.read_shapes(spark, path).rules)
    return found.groupBy("drawing_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node"))


@query(_with(ROOM, """small AS (SELECT *, (x1 - x0) * (2 + event_id % 9) // 10 AS w, (y1 - y0) * (2 + user_id % 9) // 10 AS h FROM room),
 bad AS (SELECT drawing_id, room_id, unnest(list_filter([CASE WHEN sem = 'Bedroom' AND w * h < 12000000 THEN 'R11' END, CASE WHEN sem = 'Bedroom' AND event_id % 2 = 0 AND w * h < 9000000 THEN 'R12' END,
 CASE WHEN sem = 'Kitchen' AND w * h < 3500000 THEN 'R13' END, CASE WHEN sem = 'Bathroom' AND w * h < 2500000 THEN 'R14' END, CASE WHEN sem = 'Bedroom' AND least(w, h) < 1800 THEN 'R15' END,
 CASE WHEN sem = 'Corridor' AND event_id % 3 = 0 AND least(w, h) < 1100 THEN 'R20' END, CASE WHEN sem = 'Corridor' AND event_id % 3 = 1 AND least(w, h) < 1000 THEN 'R21' END,
 CASE WHEN sem = 'Corridor' AND event_id % 3 = 2 AND least(w, h) < 900 THEN 'R22' END], lambda x: x IS NOT NULL)) AS rule_id FROM small)""", select="SELECT drawing_id, rule_id, room_id FROM bad"))
def rules_small_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms shrunk to a fifth to the whole of their sides, every second bedroom also a living room, corridors of three kinds."""
    r = D.rooms(spark, sf_dir).withColumns({"w": F.expr("(x1 - x0) * (2 + event_id % 9) div 10"), "h": F.expr("(y1 - y0) * (2 + user_id % 9) div 10")})
    kinds = F.array(*(F.lit(k) for k in ("EntranceCorridor", "MainCorridor", "SecondaryCorridor")))
    more = F.when(F.col("sem") == "Corridor", F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int"))).when((F.col("sem") == "Bedroom") & (F.col("event_id") % 2 == 0), "LivingRoom")
    r = r.select("drawing_id", "room_id", F.array_compact(F.array_append("types", more)).alias("types"), G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("ring"))
    nodes = N.measure_rooms(r).withColumnRenamed("room_id", "node_id")
    chosen = [x for x in rules.RULES if x[0] in ("R11", "R12", "R13", "R14", "R15", "R20", "R21", "R22")]
    return rules.violations(nodes, None, rules=chosen).select("drawing_id", "rule_id", F.col("node_id").alias("room_id"))


@query(_with(ROOM, select="""SELECT w.drawing_id, r.room_id, CAST(sum(120000) AS BIGINT) AS window_mm2 FROM room w JOIN room r ON w.drawing_id = r.drawing_id AND w.event_id % 2 = 0
 AND pow(greatest(r.x0 - w.x1, w.x1 - r.x1, 0), 2) + pow(greatest(r.y0 - (w.y0 + w.y1) / 2, (w.y0 + w.y1) / 2 - r.y1, 0), 2) < 90000 GROUP BY ALL"""))
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the windows of each room."""
    r = D.rooms(spark, sf_dir)
    y = (F.col("y0") + F.col("y1")) / 2
    w = r.where("event_id % 2 = 0").select("drawing_id", F.concat(F.lit("W_"), F.col("event_id").cast("string")).alias("uid"), G.rectangle(F.col("x1") - 50, y - 600, F.col("x1") + 50, y + 600).alias("ring"))
    held = P.windows_of_rooms(w, r).select("drawing_id", "uid", "room_id").join(w, ["drawing_id", "uid"])
    return N.window_totals(held).select("drawing_id", "room_id", whole(1e6 * F.col("window_m2")).alias("window_mm2"))


@query(_with(*ALL, select=f"SELECT drawing_id, level, count(*) AS n_violations, count(DISTINCT node_id) AS n_nodes FROM (SELECT *, 'L1' AS level FROM ({L1}) UNION ALL SELECT *, 'L2' FROM ({L2}) UNION ALL SELECT *, 'L3' FROM ({L3}) UNION ALL SELECT *, 'exp' FROM ({EXP})) GROUP BY ROLLUP (drawing_id, level)"))
def violation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = rule_tables(spark, sf_dir)
    return rules.rollup(rules.violations(nodes, edges))


# -------------------------------------------------------------- evaluation


def truth_and_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt, sys = D.truth_rooms(spark, sf_dir), D.rooms(spark, sf_dir)
    return gt, sys, V.overlaps(gt, sys)


@query(_with(ROOM, TRUTH, MATCH, select="SELECT drawing_id, 'GT_' || lpad(CAST(g AS VARCHAR), 3, '0') AS gt_id, status, 'Space_' || lpad(CAST(s AS VARCHAR), 3, '0') AS sys_id FROM matched"))
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _, pairs = truth_and_pairs(spark, sf_dir)
    return V.match_rooms(gt, pairs).select("drawing_id", "gt_id", "status", "sys_id")


@query(_with(ROOM, TRUTH, MATCH, select="SELECT drawing_id, count(*) AS n_rooms, count(*) FILTER (status = 'matched') AS n_matched, count(*) FILTER (status = 'under') AS n_under, count(*) FILTER (status = 'over') AS n_over, count(*) FILTER (status = 'missed') AS n_missed FROM matched GROUP BY drawing_id"))
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _, pairs = truth_and_pairs(spark, sf_dir)
    return V.match_rates(V.match_rooms(gt, pairs), ["drawing_id"]).drop("mean_iou")


def millionths(c) -> F.Column:
    return whole(1e6 * F.col(c)).alias(c)


@query(_with(ROOM, TRUTH, MATCH, select="SELECT m.drawing_id, CAST(round_even(1000000 * coalesce(avg(i / (ga + sa - i)), 0), 0) AS BIGINT) AS mean_iou FROM matched m LEFT JOIN lap l ON l.drawing_id = m.drawing_id AND l.g = m.g AND l.s = m.s AND status = 'matched' GROUP BY m.drawing_id"))
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IoU of the matched rooms of each drawing, in millionths."""
    gt, _, pairs = truth_and_pairs(spark, sf_dir)
    return V.match_rates(V.match_rooms(gt, pairs), ["drawing_id"]).select("drawing_id", millionths("mean_iou"))


@query(_with(ROOM, TRUTH, MATCH, select="""SELECT count(*) AS n, CAST(round_even(avg(abs((g.x1 - g.x0) * (g.y1 - g.y0) - (r.x1 - r.x0) * (r.y1 - r.y0))), 0) AS BIGINT) AS mae_area,
 CAST(round_even(1000 * avg(abs(least(g.x1 - g.x0, g.y1 - g.y0) - least(r.x1 - r.x0, r.y1 - r.y0))), 0) AS BIGINT) AS mae_short_side FROM matched m JOIN gt g ON g.drawing_id = m.drawing_id AND g.ord = m.g JOIN room r ON r.drawing_id = m.drawing_id AND r.ord = m.s"""))
def computation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors of area and short side, in square millimetres and micrometres."""
    gt, sys, pairs = truth_and_pairs(spark, sf_dir)
    sized = lambda r: r.select("drawing_id", "room_id", (G.area(F.col("ring")) / 1e6).alias("area_m2"), (E.rectangle_of("ring")["short"] / 1000).alias("short_side_m"))
    found = V.computation_errors(V.match_rooms(gt, pairs), sized(gt), sized(sys))
    return found.select("n", millionths("mae_area"), millionths("mae_short_side"))


TRUTH_EDGE = "tedge AS (SELECT drawing_id, ord AS u, lead(ord) OVER (PARTITION BY drawing_id ORDER BY ord) AS v FROM gt)"


def truth_edges(gt: DataFrame) -> DataFrame:
    return gt.withColumn("v", F.lead("room_id").over(Window.partitionBy("drawing_id").orderBy("ord"))).where(F.col("v").isNotNull()).select("drawing_id", F.col("room_id").alias("u"), "v")


@query(_with(ROOM, TRUTH, GRID, TRUTH_EDGE, """held AS (SELECT drawing_id, g, s FROM lap WHERE 10 * i > 3 * least(ga, sa)), e2 AS (SELECT * FROM tedge WHERE v IS NOT NULL),
 hit AS (SELECT DISTINCT t.drawing_id, u, v FROM e2 t JOIN held a ON a.drawing_id = t.drawing_id AND a.g = t.u JOIN held b ON b.drawing_id = t.drawing_id AND b.g = t.v AND a.s <> b.s JOIN arc ON arc.drawing_id = t.drawing_id AND src = 'Space_' || lpad(CAST(a.s AS VARCHAR), 3, '0') AND dst = 'Space_' || lpad(CAST(b.s AS VARCHAR), 3, '0')),
 judged AS (SELECT e.drawing_id, e.u, e.v, bool_or(a.g = b.g OR EXISTS (SELECT 1 FROM e2 t WHERE t.drawing_id = e.drawing_id AND (t.u = a.g AND t.v = b.g OR t.u = b.g AND t.v = a.g))) AS ok FROM edge e JOIN held a ON a.drawing_id = e.drawing_id AND 'Space_' || lpad(CAST(a.s AS VARCHAR), 3, '0') = e.u JOIN held b ON b.drawing_id = e.drawing_id AND 'Space_' || lpad(CAST(b.s AS VARCHAR), 3, '0') = e.v GROUP BY ALL)""",
    select="SELECT d.drawing_id, (SELECT count(*) FROM hit h WHERE h.drawing_id = d.drawing_id) AS tp, (SELECT count(*) FROM judged j WHERE NOT ok AND j.drawing_id = d.drawing_id) AS fp, (SELECT count(*) FROM e2 t WHERE t.drawing_id = d.drawing_id) - (SELECT count(*) FROM hit h WHERE h.drawing_id = d.drawing_id) AS fn FROM (SELECT drawing_id FROM e2 UNION SELECT drawing_id FROM edge) d"))
def topology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _, pairs = truth_and_pairs(spark, sf_dir)
    return V.topology_counts(truth_edges(gt), materialise(D.grid_edges(spark, sf_dir), "grid"), pairs)


LABEL = """label AS (SELECT m.drawing_id, m.g, m.sem AS truth, CASE WHEN r.sem = m.sem AND m.sem <> 'Unknown' THEN m.sem WHEN r.sem IS NULL THEN 'Unknown' ELSE r.sem END AS predicted,
 CASE WHEN m.s IS NULL THEN 'geometry miss' WHEN r.sem = m.sem AND m.sem <> 'Unknown' THEN NULL WHEN NOT EXISTS (SELECT 1 FROM arc WHERE arc.drawing_id = r.drawing_id AND src = r.room_id) THEN 'topology breakage' ELSE 'label error' END AS cause
 FROM matched m LEFT JOIN room r ON r.drawing_id = m.drawing_id AND r.ord = m.s)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, sys, pairs = truth_and_pairs(spark, sf_dir)
    return materialise(V.label_rows(V.match_rooms(gt, pairs, "types"), gt, sys, D.grid_edges(spark, sf_dir)).select("truth", "predicted", "cause"), "labels")


@query(_with(ROOM, TRUTH, MATCH, GRID, LABEL, select="SELECT cause, count(*) AS n FROM label WHERE cause IS NOT NULL GROUP BY cause"))
def error_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.error_cascade(labelled(spark, sf_dir)).select("cause", "n")


@query(_with(ROOM, TRUTH, MATCH, GRID, LABEL, select="SELECT l AS label, count(*) FILTER (truth = l AND predicted = l) AS tp, count(*) FILTER (truth <> l AND predicted = l) AS fp, count(*) FILTER (truth = l AND predicted <> l) AS fn FROM label, (SELECT truth AS l FROM label UNION SELECT predicted FROM label) GROUP BY l"))
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.class_scores(labelled(spark, sf_dir)).select("label", "tp", "fp", "fn")


SCORE = """score AS (SELECT l AS label, count(*) FILTER (truth = l AND predicted = l) AS tp, count(*) FILTER (truth <> l AND predicted = l) AS fp, count(*) FILTER (truth = l AND predicted <> l) AS fn FROM label, (SELECT truth AS l FROM label UNION SELECT predicted FROM label) GROUP BY l),
 rate AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM score))"""


@query(_with(ROOM, TRUTH, MATCH, GRID, LABEL, SCORE, select="SELECT label, CAST(round_even(1000000 * p, 0) AS BIGINT) AS precision, CAST(round_even(1000000 * r, 0) AS BIGINT) AS recall, CAST(round_even(1000000 * f, 0) AS BIGINT) AS f1 FROM rate"))
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of every label, in millionths."""
    return V.class_scores(labelled(spark, sf_dir)).select("label", *map(millionths, ("precision", "recall", "f1")))


MACRO = "SELECT (SELECT count(*) FROM label) AS n, (SELECT CAST(round_even(1000000 * count(*) FILTER (truth = predicted) / count(*), 0) AS BIGINT) FROM label) AS accuracy, CAST(round_even(1000000 * avg(p), 0) AS BIGINT) AS macro_precision, CAST(round_even(1000000 * avg(r), 0) AS BIGINT) AS macro_recall, CAST(round_even(1000000 * avg(f), 0) AS BIGINT) AS macro_f1 FROM rate"


@query(_with(ROOM, TRUTH, MATCH, GRID, LABEL, SCORE, select=MACRO))
def label_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro averages over labels, in millionths."""
    return V.macro(labelled(spark, sf_dir)).select("n", *map(millionths, ("accuracy", "macro_precision", "macro_recall", "macro_f1")))


@query(_with(ROOM, TRUTH, MATCH, GRID, LABEL, SCORE, "m AS (SELECT n, accuracy, macro_f1 FROM (" + MACRO + "))", select="SELECT unnest(['n', 'accuracy', 'macro_f1']) AS metric, unnest([n, accuracy, macro_f1]) AS value FROM m"))
def label_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms, accuracy and macro F1 (in millionths) as rows of metric and value."""
    return V.dashboard(label_macro(spark, sf_dir).select("n", "accuracy", "macro_f1")).select("metric", whole(F.col("value")).alias("value"))


@query(_with(ROOM, TRUTH, MATCH, """gv AS (SELECT drawing_id, 'GT_' || lpad(CAST(ord AS VARCHAR), 3, '0') AS node FROM gt WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000),
 name AS (SELECT drawing_id, s, min('GT_' || lpad(CAST(g AS VARCHAR), 3, '0')) AS gid FROM matched WHERE s IS NOT NULL GROUP BY ALL),
 sv AS (SELECT DISTINCT r.drawing_id, coalesce(gid, room_id) AS node FROM room r LEFT JOIN name n ON n.drawing_id = r.drawing_id AND n.s = r.ord WHERE sem = 'Bedroom' AND (x1 - x0) * (y1 - y0) < 12000000),
 cmp AS (SELECT coalesce(g.drawing_id, s.drawing_id) AS drawing_id, g.node AS g, s.node AS s FROM gv g FULL JOIN sv s ON g.drawing_id = s.drawing_id AND g.node = s.node)""",
    select="SELECT drawing_id, CAST(count(*) FILTER (g IS NOT NULL AND s IS NOT NULL) AS BIGINT) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (s IS NULL) AS fn FROM cmp GROUP BY ROLLUP (drawing_id)"))
def compliance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, sys, pairs = truth_and_pairs(spark, sf_dir)
    matched = V.match_rooms(gt, pairs)
    rule = [r for r in rules.RULES if r[0] == "R11"]

    def broken(rooms: DataFrame) -> DataFrame:
        nodes = rooms.select("drawing_id", F.col("room_id").alias("node_id"), "types", (G.area(F.col("ring")) / 1e6).alias("area_m2"))
        return rules.violations(nodes, None, rules=rule).select("drawing_id", "node_id", F.lit("11").alias("rule_no"))

    return V.with_total(V.compliance_counts(broken(gt), broken(sys), matched)).select("drawing_id", "tp", "fp", "fn")


@query("""SELECT 'plan' || c_custkey AS base, '/gt/plan' || c_custkey || '_gt.jsonld' AS gt, '/sys/plan' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.jsonld' ELSE '.json' END AS sys, CASE WHEN c_custkey % 5 = 0 THEN '/vio/plan' || c_custkey || '_violations.json' END AS violations FROM customer WHERE c_custkey % 7 <> 0""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("plan"), F.col("c_custkey").cast("string"))
    key = F.col("c_custkey")
    paths = F.array_compact(F.array(
        F.concat(F.lit("/gt/"), name, F.lit("_gt.jsonld")),
        F.when(key % 7 != 0, F.concat(F.lit("/sys/"), name, F.lit(".json"))),
        F.when((key % 7 != 0) & (key % 3 == 0), F.concat(F.lit("/sys/"), name, F.lit(".jsonld"))),
        F.when(key % 5 == 0, F.concat(F.lit("/vio/"), name, F.lit("_violations.json"))),
    ))
    return V.pair_files(D.table(spark, sf_dir, "customer").select(F.explode(paths).alias("path")))
