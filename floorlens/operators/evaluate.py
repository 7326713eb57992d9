"""Scores of extracted plans against annotated ground truth.

Rooms of both sides: drawing_id, room_id, ord, ring and (where asked for) types, area_m2,
short_side_m. Ratios are 0 where nothing could be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import UNKNOWN
from ..sources.shared import materialise, spread
from .graph import both_ways
from .spatial import box_join, boxed
from .topology import common_area

#: Share of the smaller area beyond which a room counts as a fragment of another; of containment; least IoU.
FRAGMENT, CONTAINED, LEAST_IOU = 0.3, 0.8, 0.5


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def overlaps(gt: DataFrame, sys: DataFrame) -> DataFrame:
    """drawing_id, gt_id, sys_id, gt_ord, sys_ord, both, gt_area, sys_area of pairs with common area.

    A room that is a box is known by its bounds; only other rings are carried along and measured in Python.
    """

    def side(rooms: DataFrame, s: str) -> DataFrame:
        plain = G.as_box(F.col("ring"))
        held = rooms.select("drawing_id", F.col("room_id").alias(f"{s}_id"), F.col("ord").alias(f"{s}_ord"), "ring", plain.alias("plain"))
        box = F.coalesce("plain", G.bounds(F.col("ring")))
        size = F.when(F.col("plain").isNotNull(), _box_area("plain")).otherwise(G.area(F.col("ring")))
        ring = F.when(F.col("plain").isNull(), F.col("ring"))
        return boxed(held.select("drawing_id", f"{s}_id", f"{s}_ord", size.alias(f"{s}_area"), ring.alias(f"{s}_ring"), box.alias("bounds")), F.col("bounds")).drop("bounds")

    x = F.least("box.x1", "other_box.x1") - F.greatest("box.x0", "other_box.x0")
    y = F.least("box.y1", "other_box.y1") - F.greatest("box.y0", "other_box.y0")
    near = box_join(side(gt, "gt"), side(sys, "sys")).where((x > 0) & (y > 0))
    odd = F.col("gt_ring").isNotNull() | F.col("sys_ring").isNotNull()
    ring = lambda r, b: F.when(odd, F.coalesce(r, G.rectangle(*(F.col(f"{b}.{c}") for c in ("x0", "y0", "x1", "y1")))))
    columns = ["drawing_id", "gt_id", "sys_id", "gt_ord", "sys_ord", "both", "gt_area", "sys_area"]
    # Written out, so that the pairs are met once and Python is not called for pairs of boxes.
    met = near.withColumns({"both": F.when(~odd, x * y), "gt_ring": ring("gt_ring", "box"), "sys_ring": ring("sys_ring", "other_box")})
    met = materialise(met.select(*columns, "gt_ring", "sys_ring"), "overlaps")
    rest = spread(met.where("both is null"), "drawing_id", "gt_id", "sys_id").withColumn("both", common_area("gt_ring", "sys_ring"))
    return met.where("both is not null").select(*columns).unionByName(rest.where("both > 0").select(*columns))


def _box_area(box: str) -> Column:
    return (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0"))


def match_rooms(gt: DataFrame, pairs: DataFrame, *keep: str) -> DataFrame:
    """drawing_id, gt_id, the columns of gt to keep, status, sys_id, iou of every ground-truth room, by three ordered passes.

    under: a system room covers more than CONTAINED of it and of another one. over: of the rest, at
    least two system rooms, not yet used, lie in it by more than CONTAINED and cover more than half of
    it together (they do not overlap one another). matched: of the rest, in order, the best system room
    not yet used has an IoU of more than LEAST_IOU. Else missed.

    An IoU of more than one half leaves at most one partner if rooms of a side do not overlap; where they
    do, the better IoU, then the earlier room, wins.

    The pairs are read once and dealt by drawing once; all passes are windows over that.
    """
    by_gt, by_sys = Window.partitionBy("drawing_id", "gt_id"), Window.partitionBy("drawing_id", "sys_id")
    covers, lies, alike = F.col("both") > CONTAINED * F.col("gt_area"), F.col("both") > CONTAINED * F.col("sys_area"), F.col("iou") > LEAST_IOU
    rows = pairs.withColumn("iou", F.try_divide(F.col("both"), F.col("gt_area") + F.col("sys_area") - F.col("both")))
    # Pairs that are none of these take part in no pass.
    rows = rows.where(covers | lies | alike).repartition("drawing_id")
    rows = rows.withColumn("used", F.count_if(covers).over(by_sys) >= 2)
    many, part = covers & F.col("used"), lies & ~F.col("used")
    split = (F.count_if(part).over(by_gt) >= 2) & (F.sum(F.when(part, F.col("both"))).over(by_gt) > 0.5 * F.col("gt_area"))
    rows = rows.withColumns({"under": F.bool_or(many).over(by_gt), "cover": F.max_by(F.when(many, F.col("sys_id")), F.when(many, F.col("sys_ord"))).over(by_gt), "split": split})
    rows = rows.withColumn("over", ~F.col("under") & F.coalesce("split", F.lit(False)))
    free = ~(F.col("used") | F.col("under") | F.col("over") | F.bool_or(part & F.col("over")).over(by_sys))
    rows = rows.withColumn("free", free & F.coalesce(alike, F.lit(False))).where("under or over or free")
    best = F.row_number().over(by_gt.orderBy(F.desc("free"), F.desc("iou"), "sys_ord"))
    turn = F.row_number().over(Window.partitionBy("drawing_id", "sys_id", "free").orderBy("gt_ord"))
    one = rows.withColumn("best", best).where("best = 1").withColumn("turn", turn).where("not free or turn = 1")
    status = F.when(F.col("under"), "under").when(F.col("over"), "over").otherwise("matched")
    found = one.select("drawing_id", "gt_id", status.alias("status"), F.when(F.col("under"), F.col("cover")).when(F.col("free"), F.col("sys_id")).alias("sys_id"), F.when(F.col("free"), F.col("iou")).alias("iou"))
    every = gt.select("drawing_id", F.col("room_id").alias("gt_id"), *keep)
    return every.join(found, ["drawing_id", "gt_id"], "left").withColumn("status", F.coalesce("status", F.lit("missed")))


def match_rates(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rooms by status, and the mean IoU of the matched ones; per drawing or over all."""
    group = matched.groupBy(*by) if by else matched.groupBy()
    return group.agg(F.count(F.lit(1)).alias("n_rooms"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("matched", "under", "over", "missed")), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))


def topology_counts(gt_edges: DataFrame, sys_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """drawing_id, tp, fp, fn of adjacency.

    Rooms correspond where their common part exceeds FRAGMENT of the smaller one. A ground-truth edge is
    found if corresponding, different rooms of its ends share a system edge. A system edge is wrong if
    both ends correspond to something, to no common room and to no ground-truth edge.
    """
    # Both ends of the edges of both sides are looked up in them.
    held = materialise(pairs.where(F.col("both") > FRAGMENT * F.least("gt_area", "sys_area")).select("drawing_id", "gt_id", "sys_id"), "held")
    arcs, truth = both_ways(sys_edges), both_ways(gt_edges)
    ends = gt_edges.withColumn("edge", F.struct("u", "v"))
    a = ends.join(held.select("drawing_id", F.col("gt_id").alias("u"), F.col("sys_id").alias("src")), ["drawing_id", "u"])
    b = a.join(held.select("drawing_id", F.col("gt_id").alias("v"), F.col("sys_id").alias("dst")), ["drawing_id", "v"]).where("src <> dst")
    hit = b.join(arcs, ["drawing_id", "src", "dst"], "left_semi").select("drawing_id", "edge").distinct()
    tp = hit.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("tp"))
    all_gt = gt_edges.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_gt"))
    m = held.select("drawing_id", F.col("sys_id").alias("u"), F.col("gt_id").alias("gu"))
    w = held.select("drawing_id", F.col("sys_id").alias("v"), F.col("gt_id").alias("gv"))
    mapped = sys_edges.join(m, ["drawing_id", "u"]).join(w, ["drawing_id", "v"])
    real = mapped.join(truth.withColumnsRenamed({"src": "gu", "dst": "gv"}).withColumn("real", F.lit(True)), ["drawing_id", "gu", "gv"], "left")
    judged = real.groupBy("drawing_id", "u", "v").agg(F.bool_or(F.coalesce("real", F.lit(False)) | (F.col("gu") == F.col("gv"))).alias("ok"))
    fp = judged.where("not ok").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("fp"))
    drawings = gt_edges.select("drawing_id").unionByName(sys_edges.select("drawing_id")).distinct()
    out = drawings.join(all_gt, "drawing_id", "left").join(tp, "drawing_id", "left").join(fp, "drawing_id", "left").na.fill(0, ["tp", "fp", "n_gt"])
    return out.select("drawing_id", "tp", "fp", (F.col("n_gt") - F.col("tp")).alias("fn"))


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def computation_errors(matched: DataFrame, gt: DataFrame, sys: DataFrame) -> DataFrame:
    """One row: pairs, mean absolute errors of area and short side (under-segmented rooms take part)."""
    g = gt.select("drawing_id", F.col("room_id").alias("gt_id"), F.col("area_m2").alias("ga"), F.col("short_side_m").alias("gs"))
    s = sys.select("drawing_id", F.col("room_id").alias("sys_id"), F.col("area_m2").alias("sa"), F.col("short_side_m").alias("ss"))
    both = matched.where(F.col("sys_id").isNotNull()).join(g, ["drawing_id", "gt_id"]).join(s, ["drawing_id", "sys_id"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.abs(F.col("ga") - F.col("sa"))), F.lit(0.0)).alias("mae_area"), F.coalesce(F.avg(F.abs(F.col("gs") - F.col("ss"))), F.lit(0.0)).alias("mae_short_side"))


def label_rows(matched: DataFrame, gt: DataFrame, sys: DataFrame, sys_edges: DataFrame) -> DataFrame:
    """drawing_id, gt_id, truth, predicted, cause (null if right) of every ground-truth room.

    The prediction is the truth if the system room has that type, else its first type. A room without a
    system room is Unknown by a geometry miss; a wrong one without any adjacency is a topology breakage,
    else a label error. If ``matched`` keeps the types of all rooms, they need not be looked up again.
    """
    truth = F.coalesce(F.try_element_at("types", F.lit(1)), F.lit(UNKNOWN)).alias("truth")
    if "types" in matched.columns:
        rows = matched.select("drawing_id", "gt_id", "sys_id", truth)
    else:
        g = gt.select("drawing_id", F.col("room_id").alias("gt_id"), truth)
        rows = g.join(matched.select("drawing_id", "gt_id", "sys_id"), ["drawing_id", "gt_id"], "left")
    s = sys.select("drawing_id", F.col("room_id").alias("sys_id"), F.col("types").alias("sys_types"))
    linked = sys_edges.select("drawing_id", F.explode(F.array("u", "v")).alias("sys_id")).distinct().withColumn("linked", F.lit(True))
    rows = rows.join(s, ["drawing_id", "sys_id"], "left").join(linked, ["drawing_id", "sys_id"], "left")
    right = F.coalesce(F.array_contains("sys_types", F.col("truth")), F.lit(False))
    predicted = F.when(right, F.col("truth")).otherwise(F.coalesce(F.try_element_at("sys_types", F.lit(1)), F.lit(UNKNOWN)))
    cause = F.when(F.col("sys_id").isNull(), "geometry miss").when(right, None).when(F.col("linked").isNull(), "topology breakage").otherwise("label error")
    return rows.select("drawing_id", "gt_id", "truth", predicted.alias("predicted"), cause.alias("cause"))


def class_scores(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn and precision, recall, f1 of every label that is true or predicted somewhere."""
    table = rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("truth") == F.col("predicted")
    as_truth = table.select(F.col("truth").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~hit, F.col("n")).otherwise(0).alias("fn"))
    as_guess = table.where(~hit).select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    return prf(as_truth.unionByName(as_guess).groupBy("label").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn"))))


def macro(rows: DataFrame) -> DataFrame:
    """One row: rooms, accuracy and macro averages."""
    scores = class_scores(rows).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return rows.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("truth") == F.col("predicted")), F.count(F.lit(1))).alias("accuracy")).crossJoin(F.broadcast(scores))


def error_cascade(rows: DataFrame) -> DataFrame:
    """cause, n and percent of the wrong rooms."""
    table = rows.where(F.col("cause").isNotNull()).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return table.withColumn("percent", 100 * F.col("n") / total)


def compliance_counts(gt: DataFrame, sys: DataFrame, matched: DataFrame) -> DataFrame:
    """drawing_id, tp, fp, fn of violations (drawing_id, node_id, rule_no), system rooms renamed by their match."""
    names = matched.where(F.col("sys_id").isNotNull()).groupBy("drawing_id", F.col("sys_id").alias("node_id")).agg(F.min("gt_id").alias("gt_id"))
    renamed = sys.join(names, ["drawing_id", "node_id"], "left").select("drawing_id", F.coalesce("gt_id", "node_id").alias("node_id"), "rule_no").distinct().withColumn("s", F.lit(1))
    truth = gt.select("drawing_id", "node_id", "rule_no").distinct().withColumn("g", F.lit(1))
    both = truth.join(renamed, ["drawing_id", "node_id", "rule_no"], "full")
    has = lambda c: F.col(c).isNotNull()
    return both.groupBy("drawing_id").agg(F.count_if(has("g") & has("s")).alias("tp"), F.count_if(has("s") & ~has("g")).alias("fp"), F.count_if(has("g") & ~has("s")).alias("fn"))


def with_total(counts: DataFrame) -> DataFrame:
    """tp, fp, fn per drawing and summed over all (drawing_id null), with precision, recall and f1."""
    return prf(counts.rollup("drawing_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def pair_files(files: DataFrame) -> DataFrame:
    """base, gt, sys, violations of files (path): ground truth <base>_gt.jsonld, system <base>.jsonld before
    <base>.json, violations <base>_violations.json, which may be missing."""
    name = F.element_at(F.split("path", "/"), -1)
    held = files.select("path", name.alias("name"))
    gt = held.where(F.col("name").endswith("_gt.jsonld")).select(F.regexp_replace("name", r"_gt\.jsonld$", "").alias("base"), F.col("path").alias("gt"))
    vio = held.where(F.col("name").endswith("_violations.json")).select(F.regexp_replace("name", r"_violations\.json$", "").alias("base"), F.col("path").alias("violations"))
    other = held.where(F.col("name").rlike(r"\.json(ld)?$") & ~F.col("name").rlike(r"(_gt\.jsonld|_violations\.json)$"))
    sys = other.select(F.regexp_replace("name", r"\.json(ld)?$", "").alias("base"), "path", F.col("name").endswith(".jsonld").alias("ld")).groupBy("base").agg(F.max_by("path", "ld").alias("sys"))
    return gt.join(sys, "base").join(vio, "base", "left")


def dashboard(overall: DataFrame) -> DataFrame:
    """metric, value rows of a one-row table."""
    columns = overall.columns
    return overall.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
