"""The building graph after rooms have been divided: parts take the rooms' place everywhere.

Rooms are divided independently of each other, so what a pass over them one by one would leave is told by sets: door
ends go to the nearest part, elements to the part around their centre, and a part neighbours what it shares a wall
with and what a door joins it to. Everything is joined within drawings that have a divided room; other drawings
pass through untouched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import EXTERIOR_ID
from ..sources.shared import materialise_rows
from .enrich import rehome_doors, rehome_elements, replace_rooms
from .topology import touching_rooms

#: Millimetres: how far apart walls of neighbours may be, and how long a wall they share at least.
TOLERANCE, SHARED = 1.0, 10.0


class Graph(NamedTuple):
    """Rooms (drawing_id, room_id, ord, types, ring), bound doors (drawing_id, uid, ends), held elements
    (drawing_id, uid, room_id) and edges (drawing_id, u, v, kind), each edge once with its ends in order."""

    rooms: DataFrame
    bound: DataFrame
    held: DataFrame
    edges: DataFrame


def _replaced(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows with ``divided``: whether the room named in a column is one of those that are gone."""
    named = gone.select("drawing_id", F.col("room_id").alias(column), F.lit(True).alias("divided"))
    return rows.join(named, ["drawing_id", column], "left").withColumn("divided", F.coalesce("divided", F.lit(False)))


def new_ends(bound: DataFrame, doors: DataFrame, parts: DataFrame) -> DataFrame:
    """Bound doors with divided rooms among their ends replaced by the part nearest to the door; equal ends count once."""
    each = bound.select("drawing_id", "uid", F.posexplode_outer("ends").alias("place", "room_id"))
    moved = rehome_doors(each.join(doors.select("drawing_id", "uid", "ring"), ["drawing_id", "uid"]), parts)
    found = each.join(moved, ["drawing_id", "uid", "room_id"], "left").groupBy("drawing_id", "uid")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("room_id").isNotNull(), F.struct("place", F.coalesce("sub_id", "room_id").alias("room"))))), lambda s: s["room"])
    return found.agg(F.array_distinct(listed).alias("ends"))


def new_edges(edges: DataFrame, rooms: DataFrame, bound: DataFrame, gone: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between rooms that stay, and those of parts: door edges, and walls of more than SHARED shared.

    ``rooms`` and ``bound`` are those after the division.
    """
    ends = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    kept = edges
    for side in ("u", "v"):
        kept = _replaced(kept, side, gone).where(~F.col("divided")).drop("divided")
    mine = parts.select("drawing_id", F.col("sub_id").alias("part"))
    either = lambda rows: rows.join(mine.select("drawing_id", F.col("part").alias("u"), F.lit(True).alias("pu")), ["drawing_id", "u"], "left").join(mine.select("drawing_id", F.col("part").alias("v"), F.lit(True).alias("pv")), ["drawing_id", "v"], "left").where("pu OR pv")
    two = bound.where((F.size("ends") == 2) & ~F.array_contains("ends", EXTERIOR_ID)).select("drawing_id", *ends(F.get("ends", F.lit(0)), F.get("ends", F.lit(1)))).distinct()
    by_door = either(two).select("drawing_id", "u", "v", F.lit("door").alias("kind"))
    near = rooms.join(gone.select("drawing_id").distinct(), "drawing_id", "left_semi")
    touching = touching_rooms(near, min_shared=SHARED, tolerance=TOLERANCE).select("drawing_id", *ends("u", "v"))
    by_wall = either(touching).join(by_door.hint("merge"), ["drawing_id", "u", "v"], "left_anti").select("drawing_id", "u", "v", F.lit("touch").alias("kind"))
    return kept.select("drawing_id", "u", "v", "kind").unionByName(by_door).unionByName(by_wall)


def divided(graph: Graph, doors: DataFrame, places: DataFrame, parts: DataFrame) -> Graph:
    """The graph with divided rooms replaced by their parts (those of ``enrich.decompose``).

    doors: drawing_id, uid, ring; places: drawing_id, uid, x, y of the held elements' centres. Rooms that could not be
    cut stay as they are, and keep their edges. Elements of a divided room that no part has strictly inside are held by none.
    """
    cut = materialise_rows(parts.where("sub_id <> room_id"), "parts")
    gone = materialise_rows(cut.select("drawing_id", "room_id").distinct(), "divided")
    numbered = replace_rooms(graph.rooms, cut)
    # Parts of a room have its place in the order, and then their own.
    rank = F.struct("ord", "room_id")
    rooms = materialise_rows(numbered.join(numbered.groupBy("drawing_id").agg(F.sort_array(F.collect_list(rank)).alias("all")), "drawing_id").withColumn("ord", F.array_position("all", rank).cast("int")).drop("all"), "divided-rooms")
    bound = materialise_rows(new_ends(graph.bound, doors, cut), "divided-ends")
    held = _replaced(graph.held, "room_id", gone)
    moved = rehome_elements(held.where("divided").join(places.select("drawing_id", "uid", "x", "y"), ["drawing_id", "uid"]), cut)
    holds = held.where("NOT divided").select("drawing_id", "uid", "room_id").unionByName(moved.select("drawing_id", "uid", F.col("sub_id").alias("room_id")))
    return Graph(rooms, bound, holds, new_edges(graph.edges, rooms, bound, gone, cut))
