"""Building rules as data, compiled to plans.

A rule names its target types and a kind:

* ``min`` / ``above`` / ``max`` / ``below``: a value of the node must be at least / more than / at most / less than
  the threshold; nodes without the value conform.
* ``min_if`` and so on: the same, for nodes that also have a type in ``among``.
* ``some_type``: of the nodes that an edge of kind ``path`` leads to, at least one (or as many as the threshold) has
  a type in ``among``; ``few_type``: at most as many as the threshold.
* ``some_label`` / ``few_label``: the same, of labels.
* ``none_type`` / ``all_type``: none of them has / each of them has a type in ``among``; one result for each that does not conform.

Nodes: drawing_id, node_id, types array<string>, label, and the measured values. Edges: drawing_id,
src, pred, dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_id string, level string, targets array<string>, kind string, path string, among array<string>, threshold double"

# Rule targets, paths and thresholds.
RULES = [
    ("R1", "L1", ["Suite"], "some_type", "hasSpace", ["Bedroom"], None),
    ("R2", "L1", ["Suite"], "some_type", "hasSpace", ["LivingRoom"], None),
    ("R3", "L1", ["Suite"], "some_type", "hasSpace", ["Kitchen"], None),
    ("R4", "L1", ["Suite"], "some_type", "hasSpace", ["Bathroom"], None),
    ("R5", "L1", ["Suite"], "some_type", "hasSpace", ["Entrance"], None),
    ("R6", "L1", ["Kitchen"], "some_label", "containsElement", ["sink"], None),
    ("R7", "L1", ["Kitchen"], "some_label", "containsElement", ["gas stove"], None),
    ("R8", "L1", ["Bathroom"], "some_label", "containsElement", ["toilet", "squat toilet"], None),
    ("R9", "L1", ["Bathroom"], "some_label", "containsElement", ["bath", "bath tub"], None),
    ("R10", "L1", ["Bathroom"], "some_label", "containsElement", ["sink"], None),
    ("R11", "L2", ["Bedroom"], "min", "area_m2", [], 12.0),
    ("R12", "L2", ["Bedroom"], "min_if", "area_m2", ["LivingRoom"], 9.0),
    ("R13", "L2", ["Kitchen"], "min", "area_m2", [], 3.5),
    ("R14", "L2", ["Bathroom"], "min", "area_m2", [], 2.5),
    ("R15", "L2", ["Bedroom"], "min", "short_side_m", [], 1.80),
    ("R16", "L2", ["EntranceDoor"], "min", "door_width_mm", [], 900.0),
    ("R17", "L2", ["BedroomDoor"], "min", "door_width_mm", [], 800.0),
    ("R18", "L2", ["KitchenDoor", "BathroomDoor"], "min", "door_width_mm", [], 700.0),
    ("R19", "L3", ["Bathroom"], "none_type", "adjacentZone", ["Kitchen"], None),
    ("R20", "L3", ["EntranceCorridor"], "min", "clear_width_m", [], 1.10),
    ("R21", "L3", ["MainCorridor"], "min", "clear_width_m", [], 1.00),
    ("R22", "L3", ["SecondaryCorridor"], "min", "clear_width_m", [], 0.90),
    ("R23", "exp", ["Bedroom"], "above", "area_m2", [], 12.0),
    ("R24", "exp", ["LivingRoom"], "some_type", "adjacentZone", ["Balcony"], None),
    ("R25", "exp", ["Kitchen"], "some_type", "adjacentZone", ["DiningRoom"], None),
    ("R26", "exp", ["Kitchen"], "some_label", "containsElement", ["sink"], None),
    ("R27", "exp", ["Kitchen"], "some_label", "containsElement", ["gas stove"], None),
]


def catalogue(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _focus(nodes: DataFrame, rules: list[tuple], spark: SparkSession) -> DataFrame:
    """Nodes with each rule of which they are a target, once per rule. The rules are a table of a few rows."""
    table = F.broadcast(catalogue(spark, rules))
    each = nodes.withColumn("type", F.explode(F.array_distinct("types"))).join(table.withColumn("type", F.explode("targets")), "type")
    return each.drop("type").dropDuplicates(["drawing_id", "node_id", "rule_id"])


def violations(nodes: DataFrame, edges: DataFrame | None, levels: list[str] | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """drawing_id, node_id, rule_id, level and other (the offending neighbour, if the rule names one)."""
    spark = nodes.sparkSession
    chosen = [r for r in rules if levels is None or r[1] in levels]
    by_kind: dict[str, list[tuple]] = {}
    for r in chosen:
        kind = "value" if r[3].removesuffix("_if") in ("min", "above", "max", "below") else r[3].partition("_")[0]
        by_kind.setdefault({"some": "count", "few": "count", "none": "each", "all": "each"}.get(kind, kind), []).append(r)
    if unknown := set(by_kind) - {"value", "count", "each"}:
        raise ValueError(f"rules of unknown kinds: {sorted(unknown)}")
    found: list[DataFrame] = []
    none = F.lit(None).cast("string").alias("other")
    if own := by_kind.get("value"):
        focus = _focus(nodes, own, spark)
        paths = sorted({r[4] for r in own} & set(nodes.columns))
        value = reduce(lambda a, p: a.when(F.col("path") == p, F.col(p)), paths, F.when(F.lit(False), F.lit(0.0)))
        focus = focus.withColumn("value", value)
        plain, value, most = F.regexp_replace("kind", "_if$", ""), F.col("value"), F.col("threshold")
        bad = F.when(plain == "above", value <= most).when(plain == "max", value > most).when(plain == "below", value >= most).otherwise(value < most)
        applies = ~F.endswith("kind", F.lit("_if")) | F.arrays_overlap("types", "among")
        found.append(focus.where(applies & bad).select("drawing_id", "node_id", "rule_id", "level", none))
    if edges is not None and (own := by_kind.get("count")):
        focus = _focus(nodes.select("drawing_id", "node_id", "types"), own, spark)
        ends = nodes.select("drawing_id", F.col("node_id").alias("dst"), F.col("types").alias("dst_types"), F.col("label").alias("dst_label"))
        reach = focus.join(edges.withColumnsRenamed({"src": "node_id", "pred": "path"}), ["drawing_id", "node_id", "path"]).join(ends, ["drawing_id", "dst"])
        good = F.when(F.endswith("kind", F.lit("_type")), F.arrays_overlap("dst_types", "among")).otherwise(F.array_contains("among", F.col("dst_label")))
        n = reach.where(good).groupBy("drawing_id", "node_id", "rule_id").agg(F.count_distinct("dst").alias("n"))
        counted = focus.join(n, ["drawing_id", "node_id", "rule_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        bad = F.when(F.startswith("kind", F.lit("few_")), F.col("n") > F.col("threshold")).otherwise(F.col("n") < F.coalesce("threshold", F.lit(1.0)))
        found.append(counted.where(bad).select("drawing_id", "node_id", "rule_id", "level", none))
    if edges is not None and (own := by_kind.get("each")):
        focus = _focus(nodes.select("drawing_id", "node_id", "types"), own, spark)
        ends = nodes.select("drawing_id", F.col("node_id").alias("dst"), F.col("types").alias("dst_types"))
        reach = focus.join(edges.withColumnsRenamed({"src": "node_id", "pred": "path"}), ["drawing_id", "node_id", "path"]).join(ends, ["drawing_id", "dst"])
        found.append(reach.where(F.arrays_overlap("dst_types", "among") == (F.col("kind") == "none_type")).select("drawing_id", "node_id", "rule_id", "level", F.col("dst").alias("other")))
    return reduce(DataFrame.unionByName, found)


def rollup(violations_: DataFrame) -> DataFrame:
    """Violations by drawing and level, with totals: null stands for all."""
    counts = violations_.rollup("drawing_id", "level").agg(F.count(F.lit(1)).alias("n_violations"), F.count_distinct("node_id").alias("n_nodes"))
    return counts


def tally(drawings: DataFrame, violations_: DataFrame) -> DataFrame:
    """One row: drawings that pass, drawings with violations, violations in all."""
    per = drawings.select("drawing_id").distinct().join(violations_.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n")), "drawing_id", "left")
    return per.agg(F.count_if(F.col("n").isNull()).alias("n_passed"), F.count_if(F.col("n") > 0).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations"))


def report_shapes(violations_: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """drawing_id, node_id, rule_id, rings: what a report draws for a violation.

    A node without a ring borrows those of the nodes that its edges lead to or come from, in order of
    their ids; without such neighbours the list is empty.
    """
    shapes = nodes.where(F.col("ring").isNotNull()).select("drawing_id", "node_id", "ring")
    bare = violations_.select("drawing_id", "node_id").distinct().join(shapes.select("drawing_id", "node_id"), ["drawing_id", "node_id"], "left_anti")
    ends = edges.select("drawing_id", "src", "dst")
    around = ends.unionByName(ends.select("drawing_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    lent = bare.join(around.withColumnRenamed("src", "node_id"), ["drawing_id", "node_id"]).join(shapes.withColumnRenamed("node_id", "dst"), ["drawing_id", "dst"])
    lent = lent.groupBy("drawing_id", "node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dst", "ring"))), lambda s: s["ring"]).alias("rings"))
    drawn = shapes.select("drawing_id", "node_id", F.array("ring").alias("rings")).unionByName(lent)
    out = violations_.select("drawing_id", "node_id", "rule_id").join(drawn, ["drawing_id", "node_id"], "left")
    return out.withColumn("rings", F.coalesce("rings", F.array().cast(f"array<{nodes.schema['ring'].dataType.simpleString()}>")))


def rule_number(message):
    """The number that a message carries in brackets, else Unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(message, r"【违规 ([\d.]+)】", 1), F.lit("")), F.lit("Unknown"))
