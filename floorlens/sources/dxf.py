"""ASCII DXF drawings: entities as rows, and annotated rooms by layer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygons
from ..functions.text import layer_type
from ..functions.vocab import DOOR_LAYERS, FACILITY_LAYERS, ROOM_LAYERS
from ..operators.topology import mended
from .colours import WHITE, entity_colour

ENTITY = f"drawing string, ord int, kind string, layer string, text string, radius double, coords {G.RING}"
#: The same with the colour an entity has by itself, its insertion or its layer.
DRAWN = f"drawing string, ord int, kind string, layer string, text string, radius double, rgb struct<r:int,g:int,b:int>, coords {G.RING}"
KINDS = {"LINE", "LWPOLYLINE", "CIRCLE", "ARC", "ELLIPSE", "TEXT", "MTEXT", "SPLINE", "LEADER"}
#: References to blocks: their entities are written in place.
HOLDERS = {"INSERT", "DIMENSION", "ARC_DIMENSION", "LARGE_RADIAL_DIMENSION"}
#: Points on an arc, an ellipse or a spline.
CURVE_POINTS = 20
_REPEATED = {"10", "20", "11", "21", "40"}

Pair = tuple[str, str]
Point = tuple[float, float]


class Entity(NamedTuple):
    kind: str
    layer: str
    text: str | None
    radius: float | None
    colour: tuple[int, int, int]
    points: list[Point]


def _records(pairs: list[Pair]) -> list[tuple[str, str, dict]]:
    """(section, kind, values by group code); codes that repeat hold lists.

    ``bulges`` are those of a light polyline by vertex, ``weights`` those of a spline.
    """
    out: list[tuple[str, str, dict]] = []
    section, values = "", None
    for code, value in pairs:
        if code == "0":
            values = {}
            out.append((section, value, values))
            if value == "ENDSEC":
                section = ""
        elif values is not None:
            if out[-1][1] == "SECTION" and code == "2":
                section = value
            if code == "42" and out[-1][1] == "LWPOLYLINE":
                values.setdefault("bulges", {})[len(values.get("10", [])) - 1] = float(value)
            elif code == "41" and out[-1][1] == "SPLINE":
                values.setdefault("weights", []).append(float(value))
            elif code == "3" and out[-1][1] == "MTEXT":
                values.setdefault("parts", []).append(value)
            elif code in _REPEATED:
                values.setdefault(code, []).append(float(value))
            else:
                values.setdefault(code, value if code == "1" else value.strip())
    return out


_MTEXT = re.compile(r"\\([\\{}~])|\\P|\\S([^;]*);|\\[LlOoKkNX]|\\[A-Za-z][^;\\]*;|[{}]")
_TEXT = re.compile(r"%%(?:([dDcCpP%])|[uUoOkK]|(\d{3}))")
#: Characters that texts write as codes.
_SIGNS = {"d": "°", "c": "⌀", "p": "±", "%": "%"}


def _plain_text(kind: str, v: dict) -> str | None:
    """A text without its formatting codes; all parts of a long one, with its line breaks."""
    if "1" not in v and "parts" not in v:
        return None
    text = "".join([*v.get("parts", []), v.get("1", "")])
    if kind == "MTEXT":

        def shown(m: re.Match) -> str:
            if m[1]:
                return "\u00a0" if m[1] == "~" else m[1]
            if m[2] is not None:
                return re.sub(r"[#^]", "/", m[2])
            return "\n" if m[0] == "\\P" else ""

        return _MTEXT.sub(shown, text)
    return _TEXT.sub(lambda m: _SIGNS[m[1].lower()] if m[1] else chr(int(m[2])) if m[2] else "", text.strip())


def _spline(degree: int, knots: list[float], control: list[Point], weights: list[float]) -> list[Point]:
    """Points at even parameters of a B-spline, by de Boor's recurrence; control points if the knots do not fit.

    A rational one runs through its points times their weights, and is divided by the weight of the result.
    """
    n = len(control)
    if n <= degree or len(knots) != n + degree + 1:
        return control
    weights = weights if len(weights) == n and min(weights) > 0 else [1.0] * n
    control = [(x * g, y * g, g) for (x, y), g in zip(control, weights, strict=True)]
    low, high, out = knots[degree], knots[n], []
    for i in range(CURVE_POINTS):
        t = low + (high - low) * i / (CURVE_POINTS - 1)
        k = max((j for j in range(degree, n) if knots[j] <= t and knots[j] < knots[j + 1]), default=degree)
        d = [control[k - degree + j] for j in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                left, right = knots[k - degree + j], knots[k + 1 + j - r]
                w = (t - left) / (right - left) if right > left else 0.0
                d[j] = tuple((1 - w) * x + w * y for x, y in zip(d[j - 1], d[j], strict=True))
        x, y, g = d[degree]
        out.append((x / g, y / g))
    return out


def _bulged(corners: list[Point], bulges: dict[int, float]) -> list[Point]:
    """A polyline whose sides with a bulge (the tangent of a quarter of the angle, left-hand positive) are arcs."""
    out: list[Point] = []
    for i, (px, py) in enumerate(corners):
        out.append((px, py))
        bulge = bulges.get(i, 0.0)
        if bulge == 0 or i + 1 == len(corners):
            continue
        dx, dy, turn = corners[i + 1][0] - px, corners[i + 1][1] - py, 4 * math.atan(bulge)
        off = (1 - bulge * bulge) / (4 * bulge)
        cx, cy = px + dx / 2 - dy * off, py + dy / 2 + dx * off
        for k in range(1, CURVE_POINTS - 1):
            t = turn * k / (CURVE_POINTS - 1)
            out.append((cx + (px - cx) * math.cos(t) - (py - cy) * math.sin(t), cy + (px - cx) * math.sin(t) + (py - cy) * math.cos(t)))
    return out


def _points(kind: str, v: dict) -> list[Point]:
    first = list(zip(v.get("10", []), v.get("20", []), strict=False))
    second = list(zip(v.get("11", []), v.get("21", []), strict=False))
    if kind == "LWPOLYLINE" and first:
        shut = int(v.get("70", 0)) & 1 and first[0] != first[-1]
        return _bulged([*first, first[0]] if shut else first, v.get("bulges", {}))
    if kind in ("ARC", "ELLIPSE") and first and v.get("40"):
        (cx, cy), size = first[0], v["40"][0]
        if kind == "ARC":
            ax, ay, ratio, start, end = size, 0.0, 1.0, math.radians(float(v.get("50", 0))), math.radians(float(v.get("51", 360)))
        else:
            (ax, ay), ratio, start, end = (second or [(0.0, 0.0)])[0], size, float(v.get("41", 0)), float(v.get("42", 2 * math.pi))
        if end <= start:
            end += 2 * math.pi
        angles = [start + (end - start) * i / (CURVE_POINTS - 1) for i in range(CURVE_POINTS)]
        return [(cx + ax * math.cos(t) - ratio * ay * math.sin(t), cy + ay * math.cos(t) + ratio * ax * math.sin(t)) for t in angles]
    if kind == "SPLINE":
        return _spline(int(v.get("71", 3)), v.get("40", []), first, v.get("weights", [])) if first else second
    return first + second if kind == "LINE" else first


def _hidden_layers(records: list[tuple[str, str, dict]]) -> set[str]:
    """Layers that are off (a negative colour) or frozen."""
    return {v.get("2", "") for section, kind, v in records if section == "TABLES" and kind == "LAYER" and (int(v.get("62", 7)) < 0 or int(v.get("70", 0)) & 1)}


def entities_of(text: str) -> list[tuple[str, str, str | None, float | None, list[Point]]]:
    """(kind, layer, text, radius, points) of the visible entities, as :func:`drawn_entities` finds them."""
    return [(e.kind, e.layer, e.text, e.radius, e.points) for e in drawn_entities(text)]


def drawn_entities(text: str) -> list[Entity]:
    """The visible entities with their colours.

    A closed polyline repeats its first point; arcs, bulges, ellipses and splines are CURVE_POINTS points. A
    block's entities stand where it is inserted, scaled, turned and moved, at any depth, on the layer of
    the outermost insertion, which alone decides whether they are shown. Blocks that hold themselves are left out, as are entities that are
    invisible or whose layer is off or frozen. A radius follows the insertion's first scale. What is coloured by
    layer or by block has the colour of the layer on which it is shown.
    """
    lines = text.removeprefix("\ufeff").splitlines()
    records = _records([(code.strip(), value if code.strip() in ("1", "3") else value.strip()) for code, value in zip(lines[::2], lines[1::2], strict=False)])
    hidden = _hidden_layers(records)
    of_layer = {v.get("2", ""): int(v.get("62", WHITE)) for section, kind, v in records if section == "TABLES" and kind == "LAYER"}
    blocks: dict[str, tuple[Point, list]] = {}
    top: list[tuple[str, dict]] = []
    inside: list | None = None
    for section, kind, v in records:
        if section == "BLOCKS" and kind == "BLOCK":
            inside = []
            base = (v.get("10", [0.0])[0], v.get("20", [0.0])[0])
            blocks[v.get("2", "")] = (base, inside)
        elif section == "BLOCKS" and kind == "ENDBLK":
            inside = None
        elif section == "BLOCKS" and inside is not None:
            inside.append((kind, v))
        elif section == "ENTITIES":
            top.append((kind, v))
    out: list[Entity] = []

    def place(items: list, m: tuple, scale: float, layer: str | None, within: tuple[str, ...]) -> None:
        a, b, c, d, e, f = m
        for kind, v in items:
            own = layer if layer is not None else v.get("8", "0")
            if own in hidden or v.get("60", "0") == "1":
                continue
            if kind in KINDS:
                radius = v["40"][0] * scale if kind in ("CIRCLE", "ARC") and v.get("40") else None
                colour = entity_colour(int(v["62"]) if "62" in v else None, int(v["420"]) if "420" in v else None, of_layer.get(own))
                out.append(Entity(kind, own, _plain_text(kind, v), radius, colour, [(a * x + c * y + e, b * x + d * y + f) for x, y in _points(kind, v)]))
            elif kind in HOLDERS and (name := v.get("2", "")) in blocks and name not in within:
                (bx, by), held = blocks[name]
                if kind != "INSERT":
                    place(held, m, scale, own, (*within, name))
                    continue
                x, y = v.get("10", [0.0])[0], v.get("20", [0.0])[0]
                sx, sy, turn = float(v.get("41", 1)), float(v.get("42", 1)), math.radians(float(v.get("50", 0)))
                p, q, r, s = sx * math.cos(turn), sx * math.sin(turn), -sy * math.sin(turn), sy * math.cos(turn)
                u, w = x - p * bx - r * by, y - q * bx - s * by
                inner = (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * u + c * w + e, b * u + d * w + f)
                place(held, inner, scale * abs(sx), own, (*within, name))

    place(top, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 1.0, None, ())
    return out


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities with their colours (columns as in DRAWN) of all DXF files under the path, on any store that Spark reads."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.dxf$", "")
    files = spark.read.option("pathGlobFilter", "*.dxf").text(path, wholetext=True).select(name.alias("drawing"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(d, i, e) for d, v in zip(frame["drawing"], frame["value"], strict=True) for i, e in enumerate(drawn_entities(v))]
            rows = [(d, i, e.kind, e.layer, e.text, e.radius, dict(zip("rgb", e.colour, strict=True)), [{"x": x, "y": y} for x, y in e.points]) for d, i, e in found]
            yield pd.DataFrame(rows, columns=["drawing", "ord", "kind", "layer", "text", "radius", "rgb", "coords"])

    return files.mapInPandas(run, DRAWN)


def fit_scale(entities: DataFrame, size: float = 140.0) -> DataFrame:
    """drawing, x0, y0, x1, y1, scale, dx, dy: what centres a drawing in a square of this size."""
    r = F.when(F.col("kind") == "CIRCLE", F.coalesce("radius", F.lit(0.0))).otherwise(0.0)
    p = entities.select("drawing", r.alias("r"), F.explode("coords").alias("p"))
    box = p.groupBy("drawing").agg(F.min(F.expr("p.x - r")).alias("x0"), F.min(F.expr("p.y - r")).alias("y0"), F.max(F.expr("p.x + r")).alias("x1"), F.max(F.expr("p.y + r")).alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    scale = F.least(F.coalesce(F.try_divide(F.lit(size), w), F.lit(1.0)), F.coalesce(F.try_divide(F.lit(size), h), F.lit(1.0)))
    box = box.withColumn("scale", scale)
    return box.withColumns({"dx": (size - w * F.col("scale")) / 2, "dy": (size - h * F.col("scale")) / 2})


def to_svg_units(entities: DataFrame, size: float = 140.0) -> DataFrame:
    """Entities with coordinates and radius in the square's units, y down."""
    held = entities.join(fit_scale(entities, size), "drawing")
    x = lambda p: (p["x"] - F.col("x0")) * F.col("scale") + F.col("dx")
    y = lambda p: size - ((p["y"] - F.col("y0")) * F.col("scale") + F.col("dy"))
    return held.withColumns({"coords": F.transform("coords", lambda p: G.point(x(p), y(p))), "radius": F.col("radius") * F.col("scale")}).select(*entities.columns)


def kind_counts(entities: DataFrame) -> DataFrame:
    """drawing, kind, n: how many entities of each kind a drawing has."""
    return entities.groupBy("drawing", "kind").agg(F.count(F.lit(1)).alias("n"))


def calibration(entities: DataFrame, size: float = 140.0) -> DataFrame:
    """drawing, delta_x, delta_y: what moves annotated coordinates onto the converted drawing's."""
    f = fit_scale(entities, size)
    return f.select("drawing", (F.col("dx") / F.col("scale") - F.col("x0")).alias("delta_x"), (F.col("dy") / F.col("scale") - F.col("y0")).alias("delta_y"))


def annotated(entities: DataFrame) -> DataFrame:
    """Polylines and lines of annotation layers: kind of thing (room, door, facility) and its type."""
    held = entities.where(F.col("kind").isin("LWPOLYLINE", "LINE"))
    room, facility = layer_type(F.col("layer"), ROOM_LAYERS), layer_type(F.col("layer"), FACILITY_LAYERS)
    thing = F.when(room.isNotNull(), "room").when(F.upper("layer").isin(DOOR_LAYERS), "door").when(facility.isNotNull(), "facility")
    open_ = F.when((F.size("coords") > 1) & (F.element_at("coords", 1) == F.element_at("coords", -1)), F.slice("coords", F.lit(1), F.size("coords") - 1)).otherwise(F.col("coords"))
    ring = F.transform(open_, lambda p: G.point(F.rint(p["x"]), F.rint(p["y"])))
    return held.select("drawing", "ord", thing.alias("thing"), F.coalesce(room, facility).alias("type"), ring.alias("ring")).where(F.col("thing").isNotNull())


def mended_rings(things: DataFrame) -> DataFrame:
    """Annotated things with ``polygon`` (parts with holes), ``ring`` (its largest part's outer ring) and ``state``.

    Sound rings stay as they are; rings that cross, touch or fold onto themselves are mended as a buffer of width 0
    would: cut where they meet themselves, and left with what they go around in their own direction. Those that
    bound no area are lost: no parts, and their ring as it was.
    """
    held = things.withColumn("ring", G.without_repeats(F.col("ring")))
    held = held.withColumn("sound", F.coalesce(G.is_simple(F.col("ring")), F.lit(False)))
    held = held.withColumn("polygon", F.when(F.col("sound"), polygons.parts(F.col("ring"))).otherwise(F.coalesce(mended(F.when(~F.col("sound"), F.col("ring"))), F.array().cast(polygons.PARTS))))
    state = F.when(F.col("sound"), "sound").when(F.size("polygon") > 0, "mended").otherwise("lost")
    return held.withColumns({"state": state, "ring": F.coalesce(polygons.largest(F.col("polygon"))["outer"], F.col("ring"))}).drop("sound")
