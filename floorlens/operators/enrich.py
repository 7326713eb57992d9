"""Meaning and measures of rooms and doors: types from texts and furniture, widths, public space, apartments.

Rooms: drawing_id, room_id, ord, types array<string>, ring. Bound doors: drawing_id, uid, ends
array<string>. Edges: drawing_id, u, v. Types are kept in the order in which they were found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernel as K
from ..functions.vocab import DEFAULT_TEXTS, EXTERIOR_ID, PRIVATE_SEEDS, PUBLIC_BLOCKERS, PUBLIC_SEEDS, UNKNOWN
from ..sources.shared import spread
from .elements import clear_width, rectangle_of
from .graph import both_ways, components, has_any, hops
from .topology import as_points, flat, points_in_rooms, ring_distance

#: Areas in square metres that count as large and tiny where priors ask for them.
LARGE, TINY = 20.0, 2.0


def type_texts(texts: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Texts with their standard type (mapping: raw_text, std_label; DEFAULT_TEXTS if there is none); unmapped and unknown ones are dropped."""
    if mapping is None:
        mapping = F.broadcast(texts.sparkSession.createDataFrame(list(DEFAULT_TEXTS.items()), "raw_text string, std_label string"))
    return texts.join(mapping.where(F.col("std_label") != UNKNOWN), F.col("text") == F.col("raw_text")).drop("raw_text")


def types_from_texts(rooms: DataFrame, typed: DataFrame) -> DataFrame:
    """Rooms with the types and anchors of the texts strictly inside them, in text order (column ord)."""
    hit = points_in_rooms(typed.select("drawing_id", F.col("ord").alias("text_ord"), "text", "std_label", "x", "y"), rooms)
    anchors = F.sort_array(F.collect_list(F.struct("text_ord", F.col("text").alias("raw_text"), "std_label", "x", "y")))
    found = hit.groupBy("drawing_id", "room_id").agg(anchors.alias("anchors"))
    none = F.array().cast("array<string>")
    joined = rooms.join(found, ["drawing_id", "room_id"], "left")
    types = F.coalesce(F.array_distinct(F.transform("anchors", lambda a: a["std_label"])), none)
    return joined.withColumn("types", types)


def room_context(rooms: DataFrame, furniture: DataFrame, edges: DataFrame) -> DataFrame:
    """What is known of a room: area in square metres, furniture (each piece), neighbours and their types, all sorted.

    Doors, windows and what is unknown or has no label are no furniture.
    """
    label = F.lower("specific_type")
    furniture = furniture.where(~label.contains("door") & ~label.contains("window") & (F.col("specific_type") != "unknown"))
    items = furniture.groupBy("drawing_id", "room_id").agg(F.sort_array(F.collect_list("specific_type")).alias("items"))
    around = both_ways(edges).join(rooms.select("drawing_id", F.col("room_id").alias("dst"), F.explode_outer("types").alias("near")), ["drawing_id", "dst"])
    around = around.groupBy("drawing_id", F.col("src").alias("room_id")).agg(F.sort_array(F.collect_set("near")).alias("near"), F.sort_array(F.collect_set("dst")).alias("neighbours"))
    none = F.array().cast("array<string>")
    out = rooms.join(items, ["drawing_id", "room_id"], "left").join(around, ["drawing_id", "room_id"], "left")
    return out.withColumns({"area_m2": G.area(F.col("ring")) / 1e6, "items": F.coalesce("items", none), "near": F.coalesce("near", none), "neighbours": F.coalesce("neighbours", none)})


def room_prompts(context: DataFrame) -> DataFrame:
    """drawing_id, prompt: what is known of a drawing's untyped rooms, as one JSON list in room order.

    The context is that of :func:`room_context`; a reply is read by ``functions.text.parse_reply``.
    """
    room = F.struct("ord", F.struct("room_id", F.round("area_m2", 2).alias("area"), F.col("items").alias("furniture"), "neighbours").alias("r"))
    rows = F.transform(F.sort_array(F.collect_list(room)), lambda x: x["r"])
    return context.where(F.size("types") == 0).groupBy("drawing_id").agg(F.to_json(rows).alias("prompt"))


def outer_doors(near: DataFrame, doors: DataFrame, rooms: DataFrame, *, least_mm: float = 850.0) -> DataFrame:
    """drawing_id, uid, is_entrance of doors by their nearest rooms (``topology.nearest_rooms``).

    An entrance leads to a single room that is no balcony, and is at least ``least_mm`` wide.
    """
    types = rooms.select("drawing_id", "room_id", F.exists("types", lambda t: F.lower(t) == "balcony").alias("balcony"))
    ends = near.join(types, ["drawing_id", "room_id"]).groupBy("drawing_id", "uid").agg(F.count(F.lit(1)).alias("n"), F.bool_or("balcony").alias("balcony"))
    b = G.bounds(F.col("ring"))
    wide = doors.select("drawing_id", "uid", F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]).alias("width"))
    single = (F.col("n") == 1) & (F.col("width") >= least_mm) & ~F.col("balcony")
    return wide.join(ends, ["drawing_id", "uid"], "left").select("drawing_id", "uid", F.coalesce(single, F.lit(False)).alias("is_entrance"))


def priors(items: Column, near: Column, area: Column) -> Column:
    """Room types that furniture, neighbours and size suggest, as array<string>.

    A bed always makes a bedroom. "Large" and "tiny" are LARGE and TINY.
    """
    has = lambda *names: has_any(items, list(names))
    only = lambda *names: (F.size(items) > 0) & (F.size(F.array_except(items, F.array(*(F.lit(n) for n in names)))) == 0)
    types = lambda *names: F.array(*(F.lit(n) for n in names))
    return (
        F.when(has("bed") & has("sofa", "TV cabinet"), types("Bedroom", "LivingRoom"))
        .when(has("bed"), types("Bedroom"))
        .when(has("toilet", "squat toilet", "bath", "bath tub", "urinal"), types("Bathroom"))
        .when(has("stairs"), types("Stairwell"))
        .when(has("elevator"), types("ElevatorShaft"))
        .when(has("gas stove", "sink", "refrigerator"), types("Kitchen"))
        .when(has("sofa") & has("table"), types("LivingRoom", "DiningRoom"))
        .when(has("sofa", "TV cabinet"), types("LivingRoom"))
        .when(has("table") & has("chair"), types("DiningRoom"))
        .when(has("washing machine", "railing"), F.when(area >= LARGE, types("Garden")).otherwise(types("Balcony")))
        .when(only("Wardrobe", "cabinet") & F.array_contains(near, "Bedroom"), types("Cloakroom"))
        .when(only("cabinet"), types("Entrance"))
        .when((F.size(items) == 0) & (area < TINY), types("StorageRoom"))
        .when(F.size(items) == 0, types("Corridor"))
        .otherwise(types(UNKNOWN))
    )


def infer_types(context: DataFrame) -> DataFrame:
    """Rooms of :func:`room_context` with priors as types where no text gave any."""
    return context.withColumn("types", F.when(F.size("types") > 0, F.col("types")).otherwise(priors(F.col("items"), F.col("near"), F.col("area_m2"))))


def is_corridor(types: Column) -> Column:
    return F.exists(types, lambda t: t.contains("Corridor"))


def measure_rooms(rooms: DataFrame) -> DataFrame:
    """area_m2, and clear_width_m of corridors or short_side_m of other rooms."""
    corridor = is_corridor(F.col("types"))
    out = rooms.withColumn("area_m2", G.area(F.col("ring")) / 1e6)
    return out.withColumns({"clear_width_m": F.when(corridor, clear_width("ring") / 1000), "short_side_m": F.when(~corridor, rectangle_of("ring")["short"] / 1000)})


def window_totals(windows: DataFrame) -> DataFrame:
    """drawing_id, room_id, window_m2: the summed area of the windows (drawing_id, room_id, ring) of each room."""
    return windows.groupBy("drawing_id", "room_id").agg((F.sum(G.area(F.col("ring"))) / 1e6).alias("window_m2"))


def measure_doors(doors: DataFrame) -> DataFrame:
    """clear_width_m: the long side of the door's smallest rectangle."""
    return doors.withColumn("clear_width_m", rectangle_of("ring")["long"] / 1000)


# ------------------------------------------------------- public and private


def _with_exterior(rooms: DataFrame) -> DataFrame:
    outside = rooms.select("drawing_id").distinct().select("drawing_id", F.lit(EXTERIOR_ID).alias("room_id"), F.array(F.lit("Exterior")).alias("types"))
    return rooms.select("drawing_id", "room_id", "types").unionByName(outside)


def public_corridors(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, room_id, d_public, d_private, is_public) of all corridors.

    Distances are hops to the nearest room of a public or private type, over any rooms, null if there
    is none. A corridor is public if public space is no further than private space.
    """
    known = _with_exterior(rooms)
    marks = (("d_public", PUBLIC_SEEDS), ("d_private", PRIVATE_SEEDS))
    kinds = F.array_compact(F.array(*(F.when(has_any(F.col("types"), names), F.lit(k)) for k, names in marks)))
    seeds = known.select("drawing_id", F.col("room_id").alias("node"), F.explode(kinds).alias("kind"))
    near = hops(edges, seeds).groupBy("drawing_id", F.col("node").alias("room_id")).agg(*(F.min(F.when(F.col("kind") == k, F.col("hops"))).alias(k) for k, _ in marks))
    out = rooms.where(F.array_contains("types", "Corridor")).select("drawing_id", "room_id").join(near, ["drawing_id", "room_id"], "left")
    ruled = F.col("d_public").isNotNull() & (F.col("d_private").isNull() | (F.col("d_public") <= F.col("d_private")))
    return out.withColumn("is_public", ruled)


def with_public(rooms: DataFrame, ruled: DataFrame) -> DataFrame:
    """Rooms with PublicCorridor added to the types of corridors ruled public."""
    joined = rooms.join(ruled.select("drawing_id", "room_id", "is_public"), ["drawing_id", "room_id"], "left")
    added = F.array_union("types", F.array(F.lit("PublicCorridor")))
    return joined.withColumn("types", F.when(F.coalesce("is_public", F.lit(False)), added).otherwise(F.col("types"))).select(*rooms.columns)


def door_types(bound: DataFrame, rooms: DataFrame) -> DataFrame:
    """(drawing_id, uid, door_type): entrance doors have fewer than two ends or just one public side."""
    known = _with_exterior(rooms)
    ends = bound.select("drawing_id", "uid", F.explode_outer("ends").alias("room_id")).join(known, ["drawing_id", "room_id"], "left")
    ends = ends.withColumn("public", F.coalesce(has_any(F.col("types"), [*PUBLIC_SEEDS, "PublicCorridor"]), F.lit(False)))
    by_door = ends.groupBy("drawing_id", "uid").agg(
        F.count("room_id").alias("n"), F.sum(F.col("public").cast("int")).alias("n_public"), *(F.coalesce(F.bool_or(F.array_contains("types", t)), F.lit(False)).alias(t) for t in ("Kitchen", "Bathroom", "Bedroom"))
    )
    kind = F.when((F.col("n") < 2) | (F.col("n_public") == 1), "EntranceDoor")
    for t in ("Kitchen", "Bathroom", "Bedroom"):
        kind = kind.when(F.col(t), f"{t}Door")
    return by_door.select("drawing_id", "uid", kind.otherwise("InteriorDoor").alias("door_type"))


def corridor_types(rooms: DataFrame, edges: DataFrame, bound: DataFrame, typed_doors: DataFrame) -> DataFrame:
    """(drawing_id, room_id, added): the refined types of corridors, sorted, possibly none.

    A public corridor with an entrance door is an EntranceCorridor. Another one is a MainCorridor next
    to a bedroom or living room, a SecondaryCorridor next to a kitchen or bathroom, or both.
    """
    corridor = rooms.where(F.array_contains("types", "Corridor")).select("drawing_id", "room_id", F.array_contains("types", "PublicCorridor").alias("public"))
    near = both_ways(edges).select("drawing_id", F.col("src").alias("room_id"), "dst").join(rooms.select("drawing_id", F.col("room_id").alias("dst"), "types"), ["drawing_id", "dst"])
    near = near.groupBy("drawing_id", "room_id").agg(F.bool_or(has_any(F.col("types"), ["Bedroom", "LivingRoom"])).alias("main"), F.bool_or(has_any(F.col("types"), ["Kitchen", "Bathroom"])).alias("second"))
    entrance = bound.select("drawing_id", "uid", F.explode("ends").alias("room_id")).join(typed_doors.where("door_type = 'EntranceDoor'"), ["drawing_id", "uid"])
    entrance = entrance.select("drawing_id", "room_id").distinct().withColumn("entrance", F.lit(True))
    out = corridor.join(near, ["drawing_id", "room_id"], "left").join(entrance, ["drawing_id", "room_id"], "left")
    public, no = F.col("public"), F.lit(False)
    added = F.array(F.when(public & F.coalesce("entrance", no), "EntranceCorridor"), F.when(~public & F.coalesce("main", no), "MainCorridor"), F.when(~public & F.coalesce("second", no), "SecondaryCorridor"))
    return out.select("drawing_id", "room_id", F.array_compact(added).alias("added"))


def with_types(rooms: DataFrame, added: DataFrame) -> DataFrame:
    joined = rooms.join(added, ["drawing_id", "room_id"], "left")
    return joined.withColumn("types", F.array_union("types", F.coalesce("added", F.array().cast("array<string>")))).select(*rooms.columns)


def doors_into_kitchens(bound: DataFrame, rooms: DataFrame) -> DataFrame:
    """(drawing_id, uid, bathroom, kitchen) of doors whose two ends are a bathroom and a kitchen."""
    two = bound.where(F.size("ends") == 2).select("drawing_id", "uid", F.explode("ends").alias("room_id")).join(rooms.select("drawing_id", "room_id", "types"), ["drawing_id", "room_id"])
    flags = two.groupBy("drawing_id", "uid").agg(*(F.min(F.when(F.array_contains("types", t), F.col("room_id"))).alias(t.lower()) for t in ("Bathroom", "Kitchen")))
    return flags.where(F.col("bathroom").isNotNull() & F.col("kitchen").isNotNull() & (F.col("bathroom") != F.col("kitchen")))


def suites(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, suite_id, room_id, ord): apartments, as components of rooms with a type and none that blocks.

    Numbered Suite_01 on by their first room in order.
    """
    inside = rooms.where((F.size("types") > 0) & ~has_any(F.col("types"), PUBLIC_BLOCKERS)).select("drawing_id", "room_id", "ord")
    ends = inside.select("drawing_id", F.col("room_id"))
    kept = edges.join(ends.withColumnRenamed("room_id", "u"), ["drawing_id", "u"]).join(ends.withColumnRenamed("room_id", "v"), ["drawing_id", "v"])
    comp = components(inside.select("drawing_id", F.col("room_id").alias("node")), kept.select("drawing_id", "u", "v")).withColumnRenamed("node", "room_id")
    held = inside.join(comp, ["drawing_id", "room_id"])
    first = F.min("ord").over(Window.partitionBy("drawing_id", "component"))
    number = F.dense_rank().over(Window.partitionBy("drawing_id").orderBy("first"))
    return held.withColumn("first", first).select("drawing_id", F.format_string("Suite_%02d", number).alias("suite_id"), "room_id", "ord")


# -------------------------------------------------- convex decomposition


def is_composite(types: Column) -> Column:
    """Whether a room has two types or more; Suite is none."""
    return F.size(F.array_remove(types, "Suite")) >= 2


def decompose(rooms: DataFrame) -> DataFrame:
    """Rooms with several types cut into convex parts: drawing_id, room_id, sub_id, ord, types, ring.

    Rooms: drawing_id, room_id, ring, types, anchors (of types_from_texts). A part takes the type of
    the first anchor strictly inside it, else Corridor. A room that cannot be cut is kept as it is,
    with its own id and types.
    """
    kind = f"array<{G.RING}>"

    @F.pandas_udf(kind)
    def parts(rings: pd.Series, anchors: pd.Series) -> pd.Series:
        out = []
        for r, a in zip(rings, anchors, strict=True):
            found = K.convex_parts(as_points(r), as_points(a) if a is not None else None)
            out.append([[{"x": x, "y": y} for x, y in p.tolist()] for p in found])
        return pd.Series(out)

    # Else the filter that Spark infers from the explode (not null, not empty) would cut all rooms once more, before they are dealt.
    points = F.transform(F.coalesce("anchors", F.array().cast("array<struct<text_ord:int,raw_text:string,std_label:string,x:double,y:double>>")), lambda a: G.point(a["x"], a["y"]))
    cut = spread(rooms.where(is_composite(F.col("types"))), "drawing_id", "room_id").withColumn("parts", parts.asNondeterministic()(flat(F.col("ring")), flat(points)))
    one = F.size("parts") < 2
    each = cut.select("drawing_id", "room_id", "types", "anchors", one.alias("one"), F.posexplode("parts").alias("part", "ring"))
    inside = F.filter("anchors", lambda a: G.contains(F.col("ring"), a["x"].cast("double"), a["y"].cast("double")))
    kind_of = F.coalesce(F.try_element_at(inside, F.lit(1))["std_label"], F.lit("Corridor"))
    sub = F.when(F.col("one"), F.col("room_id")).otherwise(F.concat("room_id", F.lit("_Sub_"), (F.col("part") + 1).cast("string")))
    return each.select("drawing_id", "room_id", sub.alias("sub_id"), (F.col("part") + 1).alias("ord"), F.when(F.col("one"), F.col("types")).otherwise(F.array(kind_of)).alias("types"), "ring")


def rehome_doors(doors: DataFrame, subs: DataFrame) -> DataFrame:
    """For each door end at a divided room (drawing_id, uid, room_id, ring) the nearest part, the first on ties."""
    parts = subs.select("drawing_id", "room_id", "sub_id", "ord", F.col("ring").alias("part"))
    near = doors.join(parts, ["drawing_id", "room_id"]).withColumn("distance", ring_distance("ring", "part"))
    return near.groupBy("drawing_id", "uid", "room_id").agg(F.min_by("sub_id", F.struct("distance", "ord")).alias("sub_id"))


def rehome_elements(held: DataFrame, subs: DataFrame) -> DataFrame:
    """(drawing_id, uid, sub_id) of elements of divided rooms (drawing_id, uid, room_id, x, y) by the part strictly around their centre."""
    parts = subs.select("drawing_id", "room_id", "sub_id", F.col("ring").alias("part"))
    return held.join(parts, ["drawing_id", "room_id"]).where(G.contains(F.col("part"), F.col("x"), F.col("y"))).select("drawing_id", "uid", "sub_id")


def replace_rooms(rooms: DataFrame, subs: DataFrame) -> DataFrame:
    """Rooms with divided ones replaced by their parts."""
    kept = rooms.join(subs.select("drawing_id", "room_id").distinct(), ["drawing_id", "room_id"], "left_anti").select("drawing_id", "room_id", "ord", "types", "ring")
    parts = subs.join(rooms.select("drawing_id", "room_id", F.col("ord").alias("room_ord")), ["drawing_id", "room_id"])
    return kept.unionByName(parts.select("drawing_id", F.col("sub_id").alias("room_id"), F.col("room_ord").alias("ord"), "types", "ring"))
