"""SVG drawings: primitives, texts, and paths of rooms."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

PRIMITIVE = "drawing string, ord int, layer string, tag string, attrs map<string,string>"
TEXT = "drawing string, ord int, text string, attrs map<string,string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def primitives_of(xml: str) -> list[tuple[str | None, str, dict[str, str]]]:
    """(layer, tag, attributes): for each group in document order its paths, then circles, then ellipses."""
    out = []
    for g in ET.fromstring(xml).iter():
        if _local(g.tag) == "g":
            for tag in ("path", "circle", "ellipse"):
                out += [(g.get("id"), tag, dict(e.attrib)) for e in g.iter() if _local(e.tag) == tag]
    return out


def texts_of(xml: str) -> list[tuple[str, dict[str, str]]]:
    return [("".join(e.itertext()), dict(e.attrib)) for g in ET.fromstring(xml).iter() if _local(g.tag) == "g" for e in g.iter() if _local(e.tag) == "text"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.svg$", "")
    return spark.read.option("pathGlobFilter", "*.svg").text(path, wholetext=True).select(name.alias("drawing"), "value")


def read_primitives(spark: SparkSession, path: str) -> DataFrame:
    """drawing, ord, layer, tag, attrs of all SVG files under the path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, layer, tag, attrs) for d, v in zip(frame["drawing"], frame["value"], strict=True) for i, (layer, tag, attrs) in enumerate(primitives_of(v))]
            yield pd.DataFrame(rows, columns=["drawing", "ord", "layer", "tag", "attrs"])

    return _files(spark, path).mapInPandas(run, PRIMITIVE)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, text, attrs) for d, v in zip(frame["drawing"], frame["value"], strict=True) for i, (text, attrs) in enumerate(texts_of(v))]
            yield pd.DataFrame(rows, columns=["drawing", "ord", "text", "attrs"])

    return _files(spark, path).mapInPandas(run, TEXT)


_COMMAND = re.compile(r"([MLHVCSQTAZmlhvcsqtaz])([^MLHVCSQTAZmlhvcsqtaz]*)")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _arc(x0, y0, rx, ry, turn, large, sweep, x1, y1, n):
    if rx == 0 or ry == 0 or (x0, y0) == (x1, y1):
        return [(x0, y0), (x1, y1)]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    dx, dy = (x0 - x1) / 2, (y0 - y1) / 2
    u, v = c * dx + s * dy, -s * dx + c * dy
    rx, ry = abs(rx), abs(ry)
    scale = u * u / (rx * rx) + v * v / (ry * ry)
    if scale > 1:
        rx, ry = rx * math.sqrt(scale), ry * math.sqrt(scale)
    k = (rx * rx * ry * ry - rx * rx * v * v - ry * ry * u * u) / (rx * rx * v * v + ry * ry * u * u)
    k = math.sqrt(max(0.0, k)) * (-1 if large == sweep else 1)
    a, b = k * rx * v / ry, -k * ry * u / rx
    cx, cy = c * a - s * b + (x0 + x1) / 2, s * a + c * b + (y0 + y1) / 2
    t0, t1 = math.atan2((v - b) / ry, (u - a) / rx), math.atan2((-v - b) / ry, (-u - a) / rx)
    d = t1 - t0
    if sweep and d < 0:
        d += 2 * math.pi
    if not sweep and d > 0:
        d -= 2 * math.pi
    return [(cx + rx * math.cos(t) * c - ry * math.sin(t) * s, cy + rx * math.cos(t) * s + ry * math.sin(t) * c) for t in (t0 + d * i / (n - 1) for i in range(n))]


def flatten_path(d: str, n: int = 20) -> list[tuple[float, float]]:
    """Points of a path: lines keep their ends, curves and arcs give n samples, joints included twice."""
    out: list[tuple[float, float]] = []
    x = y = sx = sy = 0.0
    last = None
    for command, rest in _COMMAND.findall(d):
        v = [float(t) for t in _NUMBER.findall(rest)]
        rel, c = command.islower(), command.upper()
        size = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}[c]
        groups = [v[i : i + size] for i in range(0, len(v), size)] if size else [[]]
        for k, g in enumerate(groups):
            if len(g) < size:
                break
            if c == "M" and k == 0:
                x, y = (x + g[0], y + g[1]) if rel else (g[0], g[1])
                sx, sy = x, y
            elif c in "MLHVZ":
                if c == "Z":
                    nx, ny = sx, sy
                elif c == "H":
                    nx, ny = (x + g[0] if rel else g[0]), y
                elif c == "V":
                    nx, ny = x, (y + g[0] if rel else g[0])
                else:
                    nx, ny = (x + g[0], y + g[1]) if rel else (g[0], g[1])
                if (nx, ny) != (x, y):
                    if not out:
                        out.append((x, y))
                    out.append((nx, ny))
                x, y = nx, ny
            elif c == "A":
                nx, ny = (x + g[5], y + g[6]) if rel else (g[5], g[6])
                out += _arc(x, y, g[0], g[1], g[2], bool(g[3]), bool(g[4]), nx, ny, n)
                x, y = nx, ny
            else:
                pts = [(x + a, y + b) if rel else (a, b) for a, b in zip(g[::2], g[1::2], strict=True)]
                if c in "ST":
                    pts.insert(0, (2 * x - last[0], 2 * y - last[1]) if last else (x, y))
                control = [(x, y), *pts]
                for i in range(n):
                    layer, t = control, i / (n - 1)
                    while len(layer) > 1:
                        layer = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for a, b in zip(layer[:-1], layer[1:], strict=True)]
                    out.append(layer[0])
                last = control[-2]
                x, y = control[-1]
                continue
            last = None
    return out


def _path_coords(d: pd.Series) -> pd.Series:
    return pd.Series([[{"x": a, "y": b} for a, b in flatten_path(v or "")] for v in d])


def path_coords(d: Column) -> Column:
    """Any path, flattened; paths of straight lines only are better served by geometry.path_points."""
    return F.pandas_udf(_path_coords, G.RING)(d)


def coords_of(primitives: DataFrame) -> DataFrame:
    """Primitives with ``coords``; ellipses and paths follow their transform, circles do not."""
    a = lambda k: F.try_element_at("attrs", F.lit(k)).try_cast("double")
    circle = G.circle_points(a("cx"), a("cy"), a("r"), a("r"))
    ellipse = G.affine(G.circle_points(a("cx"), a("cy"), a("rx"), a("ry")), G.transform_matrix(F.try_element_at("attrs", F.lit("transform"))))
    path = path_coords(F.coalesce(F.try_element_at("attrs", F.lit("d")), F.lit("")))
    return primitives.withColumn("coords", F.when(F.col("tag") == "circle", circle).when(F.col("tag") == "ellipse", ellipse).otherwise(path))


def rooms_of(primitives: DataFrame, scale: float, *, layer: str = "rooms") -> DataFrame:
    """drawing, room_id, ord, ring: the paths with an id in a layer, in world units.

    Rings are open; paths of fewer than three points are no rooms.
    """
    line = G.svg_to_world(G.path_points(F.try_element_at("attrs", F.lit("d"))), F.lit(scale))
    ring = F.when(F.element_at(line, 1) == F.element_at(line, -1), F.slice(line, F.lit(1), F.size(line) - 1)).otherwise(line)
    named = F.try_element_at("attrs", F.lit("id"))
    paths = primitives.where((F.col("tag") == "path") & (F.col("layer") == layer) & named.isNotNull())
    return paths.select("drawing", named.alias("room_id"), "ord", ring.alias("ring")).where(F.size("ring") >= 3)


def room_svgs(rooms: DataFrame, scale: float) -> DataFrame:
    """drawing_id, svg: a document with one path per room (room_id, ord, ring), for inspection."""
    path = F.concat(F.lit('<path id="'), "room_id", F.lit('" d="'), G.svg_path(F.col("ring"), F.lit(scale)), F.lit('"/>'))
    body = F.transform(F.sort_array(F.collect_list(F.struct("ord", path.alias("p")))), lambda s: s["p"])
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 140 140"><g id="rooms">'
    return rooms.groupBy("drawing_id").agg(F.concat(F.lit(head), F.array_join(body, ""), F.lit("</g></svg>")).alias("svg"))
