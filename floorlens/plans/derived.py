"""Synthetic floor plans derived from the driver's tables by integer arithmetic.

``events`` gives drawings of twelve rooms on a grid of four by three, ``part`` their furniture,
``orders`` wall and background lines. The same formulas stand as SQL in ``catalogue``, from which the
oracles derive the plans on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import LABELS

TYPES = ["Bedroom", "LivingRoom", "Kitchen", "Bathroom", "Balcony", "Corridor", "Entrance", "DiningRoom", "ElevatorShaft", "Stairwell", "StudyRoom", "StorageRoom", "Unknown", "Corridor", "Bedroom"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, room_id, ord, x0, y0, x1, y1, sem, types, ring, event_id, user_id."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    k = F.col("event_id") % 12
    x0, y0 = 4000 * (k % 4), 3500 * F.expr("(event_id % 12) div 4")
    e = e.select(
        F.expr("event_id div 12").alias("drawing_id"),
        k.alias("ord"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 4000 - F.when(F.col("user_id") % 3 == 0, 500).otherwise(0)).alias("x1"),
        (y0 + 3500 - F.when(F.col("user_id") % 5 == 0, 500).otherwise(0)).alias("y1"),
        _pick(TYPES, F.round(F.col("value") * 100).cast("bigint") % 15).alias("sem"),
        "event_id",
        "user_id",
    )
    e = e.withColumn("room_id", F.format_string("Space_%03d", F.col("ord")))
    types = F.when(F.col("sem") == "Unknown", F.array().cast("array<string>")).otherwise(F.array("sem"))
    return e.withColumns({"types": types, "ring": G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))})


def room_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts at room centres; every ninth room has a second one beside it."""
    r = rooms(spark, sf_dir)
    x, y = F.expr("(x0 + x1) div 2"), F.expr("(y0 + y1) div 2")
    first = r.select("drawing_id", (2 * F.col("event_id")).alias("ord"), F.concat(F.lit("t:"), "sem").alias("text"), x.alias("x"), y.alias("y"))
    second = r.where("event_id % 9 = 0").select("drawing_id", (2 * F.col("event_id") + 1).alias("ord"), F.lit("t:Corridor").alias("text"), (x + 700).alias("x"), y.alias("y"))
    return first.unionByName(second)


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, uid, specific_type, ring (200 x 200 boxes), x, y of the centre."""
    n = table(spark, sf_dir, "events").agg(F.expr("count(1) div 12").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").crossJoin(F.broadcast(n))
    cx = 4000 * ((F.col("p_size") % 12) % 4) + 500 + (37 * F.col("p_partkey")) % 3000
    cy = 3500 * F.expr("(p_size % 12) div 4") + 500 + (53 * F.col("p_partkey")) % 2500
    p = p.select((F.col("p_partkey") % F.col("n")).alias("drawing_id"), "p_partkey", _pick(LABELS, F.col("p_partkey") % 35).alias("specific_type"), cx.alias("x"), cy.alias("y"))
    ring = G.rectangle(F.col("x") - 100, F.col("y") - 100, F.col("x") + 100, F.col("y") + 100)
    return p.withColumns({"uid": F.concat(F.lit("F_"), F.col("p_partkey").cast("string")), "ring": ring})


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes across the line between two rooms of a row, and outer doors at the left."""
    r = rooms(spark, sf_dir).withColumn("h", 700 + 100 * (F.col("user_id") % 3))
    inner = r.where("ord % 4 < 3 and user_id % 2 = 0").withColumn("x", F.expr("4000 * (ord % 4 + 1)"))
    outer = r.where("ord % 4 = 0 and user_id % 7 = 0").withColumn("x", F.lit(0).cast("bigint"))
    make = lambda df, tag: df.select("drawing_id", F.concat(F.lit(tag), F.col("event_id").cast("string")).alias("uid"), (F.col("x") - 100).alias("x0"), (F.col("y0") + 1000).alias("y0"), (F.col("x") + 100).alias("x1"), (F.col("y0") + 1000 + F.col("h")).alias("y1"))
    both = make(inner, "D_").unionByName(make(outer, "E_"))
    return both.withColumn("ring", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain adjacency: rooms k and k + 1 of a row if user_id is even, k and k + 4 if it is a multiple of 3."""
    r = rooms(spark, sf_dir)
    n = table(spark, sf_dir, "events").agg(F.max("event_id").alias("most"))
    r = r.crossJoin(F.broadcast(n))
    step = lambda df, s: df.where(F.col("event_id") + s <= F.col("most")).select("drawing_id", F.col("room_id").alias("u"), F.format_string("Space_%03d", F.col("ord") + s).alias("v"))
    return step(r.where("ord % 4 < 3 and user_id % 2 = 0"), 1).unionByName(step(r.where("ord < 8 and user_id % 3 = 0"), 4))


def truth_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated rooms: shifted right by 200 * (event_id % 5); every 13th is cut in two, and pairs of a row merge if the left event_id is a multiple of 11."""
    r = rooms(spark, sf_dir)
    # Only rooms that may merge are looked for, from either side: event_id is 12 * drawing_id + ord.
    nxt = r.where("(event_id - 1) % 11 = 0").select("drawing_id", (F.col("ord") - 1).alias("ord"), F.col("x1").alias("nx1"))
    gone = r.where("event_id % 11 = 0 and ord % 4 < 3").select("drawing_id", (F.col("ord") + 1).alias("ord"))
    r = r.join(nxt, ["drawing_id", "ord"], "left").join(gone, ["drawing_id", "ord"], "left_anti")
    merged = "(event_id % 11 = 0 and ord % 4 < 3 and nx1 is not null)"
    s = 200 * (F.col("event_id") % 5)
    x1 = F.when(F.expr(merged), F.col("nx1")).otherwise(F.col("x1"))
    r = r.withColumns({"a": F.col("x0") + s, "b": x1 + s, "cut": F.expr(f"event_id % 13 = 0 and not {merged}")}).withColumn("mid", F.expr("(a + b) div 2"))
    part = lambda k, x0, x1: F.struct((2 * F.col("ord") + k).alias("ord"), F.col(x0).alias("x0"), F.col(x1).alias("x1"))
    parts = F.when(F.col("cut"), F.array(part(0, "a", "mid"), part(1, "mid", "b"))).otherwise(F.array(part(0, "a", "b")))
    out = r.select("drawing_id", "types", "y0", "y1", F.explode(parts).alias("p"))
    out = out.select("drawing_id", "p.ord", F.format_string("GT_%03d", F.col("p.ord")).alias("room_id"), "types", "p.x0", "y0", "p.x1", "y1")
    return out.withColumn("ring", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall and background lines: in a drawing of 20 orders, segment i starts where i - 1 ends, unless o_custkey % 5 = 0."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = F.col("o_orderkey") % 20
    gap = F.when(F.col("o_custkey") % 5 == 0, 10).otherwise(0)
    kind = F.when(F.col("o_custkey") % 4 == 0, "wall").otherwise("background")
    coords = F.array(G.point(100 * i + gap, 50 * (i % 2)), G.point(100 * i + 100, 50 * ((i + 1) % 2)))
    return o.select(F.expr("o_orderkey div 20").alias("drawing_id"), F.col("o_orderkey").alias("elem_id"), kind.alias("type"), coords.alias("coords"))
