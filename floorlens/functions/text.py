"""String functions of the floor-plan model, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(name: Column) -> Column:
    """bldg:Kitchen to Kitchen."""
    return F.regexp_replace(name, r"^bldg:", "")


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9]", "_")


def facility_label(name: Column) -> Column:
    """Lower-case facility names as the label vocabulary writes them."""
    low = F.lower(name)
    return F.when(low == "gasstove", "gas stove").when(low == "bathtub", "bath").otherwise(low)


def parse_reply(text: Column) -> Column:
    """A reply's JSON object of strings without its code fence; an empty map if it is none."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>"))


def layer_type(layer: Column, table: dict[str, str]) -> Column:
    """The value of an upper-cased layer name in a table, else null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(layer))


def shown_colour(r: Column, g: Column, b: Column) -> Column:
    """Drawing colours on white paper: white is black, those of a luminance above 200 are halved."""
    bright = 0.299 * r + 0.587 * g + 0.114 * b > 200
    white = (r == 255) & (g == 255) & (b == 255)
    each = lambda c: F.when(white, 0).when(bright, F.floor(c / 2)).otherwise(c).cast("int")
    return F.struct(each(r).alias("r"), each(g).alias("g"), each(b).alias("b"))
