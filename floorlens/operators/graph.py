"""Graph operators on edge tables that carry ``drawing_id``: components, distances, paths.

Drawings are many and each is small, so distances, paths and components come from one shuffle by drawing
and a search in memory within each; Python is called for batches of many drawings.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread


def undirected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Each edge once, ends in order, loops dropped."""
    a, b = F.least(u, v).alias("u"), F.greatest(u, v).alias("v")
    return edges.where(F.col(u) != F.col(v)).select("drawing_id", a, b).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(drawing_id, src, dst) in both directions."""
    one = edges.select("drawing_id", F.col("u").alias("src"), F.col("v").alias("dst"))
    return one.unionByName(edges.select("drawing_id", F.col("v").alias("src"), F.col("u").alias("dst"))).distinct()


def drawings(frame: pd.DataFrame, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each drawing as tuples of the columns, from a frame in which a drawing's rows stand together."""
    if not len(frame):
        return
    ids = frame["drawing_id"].to_numpy()
    rows = list(zip(*(frame[c].tolist() for c in columns), strict=True))
    edges = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield ids[a].item(), rows[a:b]


def by_drawing(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` applied to frames of whole drawings, many at a time. A drawing is never cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame["drawing_id"] == frame["drawing_id"].iloc[-1]
            if held and (not last.all() or held[-1]["drawing_id"].iloc[-1] != frame["drawing_id"].iloc[-1]):
                yield work(pd.concat([*held, frame[~last]], ignore_index=True))
                held = []
            elif not last.all():
                yield work(frame[~last])
            held.append(frame[last])
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return spread(rows, "drawing_id").sortWithinPartitions("drawing_id").mapInPandas(run, schema)


def _neighbours(d: list, u: list, v: list) -> dict[tuple, list]:
    """Neighbours of each (drawing, node)."""
    around: dict[tuple, list] = {}
    for k, a, b in zip(d, u, v, strict=True):
        around.setdefault((k, a), []).append(b)
        around.setdefault((k, b), []).append(a)
    return around


def hops(edges: DataFrame, seeds: DataFrame, *, most: int | None = None) -> DataFrame:
    """(drawing_id, node, hops) of all nodes that can be reached from the seeds (drawing_id, node).

    Seeds may have a column ``kind``: then hops are told for each kind of seeds.
    """
    kinds = "kind" in seeds.columns

    def search(group: pd.DataFrame) -> pd.DataFrame:
        seed = group["v"].isna()
        rest = group[~seed]
        around = _neighbours(rest["drawing_id"].tolist(), rest["u"].tolist(), rest["v"].tolist())
        some = group[seed]
        found = dict.fromkeys(zip(some["kind"], some["drawing_id"], some["u"], strict=True), 0)
        queue = deque(found)
        while queue:
            at = queue.popleft()
            if most is not None and found[at] >= most:
                continue
            for near in around.get(at[1:], ()):
                to = (at[0], at[1], near)
                if to not in found:
                    found[to] = found[at] + 1
                    queue.append(to)
        rows = list(found)
        return pd.DataFrame({"drawing_id": [r[1] for r in rows], "node": [r[2] for r in rows], "kind": [r[0] for r in rows], "hops": list(found.values())})

    marks = seeds.select("drawing_id", F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.col("kind") if kinds else F.lit("").alias("kind"))
    both = edges.select("drawing_id", "u", "v", F.lit("").alias("kind")).unionByName(marks)
    out = by_drawing(both, search, f"drawing_id {edges.schema['drawing_id'].dataType.simpleString()}, node string, kind string, hops int")
    return out if kinds else out.drop("kind")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, node, component): the least node that each node (drawing_id, node) is connected to."""
    kind = nodes.schema["node"].dataType.simpleString()

    def search(group: pd.DataFrame) -> pd.DataFrame:
        lone = group["v"].isna()
        rest, own = group[~lone], group[lone]
        around = _neighbours(rest["drawing_id"].tolist(), rest["u"].tolist(), rest["v"].tolist())
        label: dict = {}
        for start in sorted(set(zip(own["drawing_id"], own["u"], strict=True))):
            if start in label:
                continue
            label[start], queue = start[1], deque([start])
            while queue:
                at = queue.popleft()
                for near in around.get(at, ()):
                    to = (at[0], near)
                    if to not in label:
                        label[to] = start[1]
                        queue.append(to)
        return pd.DataFrame({"drawing_id": [k[0] for k in label], "node": [k[1] for k in label], "component": list(label.values())})

    both = edges.select("drawing_id", "u", "v").unionByName(nodes.select("drawing_id", F.col("node").alias("u"), F.lit(None).cast(kind).alias("v")))
    return by_drawing(both, search, "drawing_id " + nodes.schema["drawing_id"].dataType.simpleString() + f", node {kind}, component {kind}")


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, most: int | None = None) -> DataFrame:
    """(drawing_id, src, dst, path) of the pairs (drawing_id, src, dst); path is null if there is none
    (or, if ``most`` is given, none of at most that many edges).

    Of several shortest paths the one that is first in order of its nodes is taken.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def search(group: pd.DataFrame) -> pd.DataFrame:
        arcs, own = group[~group["pair"]], group[group["pair"]]
        around = _neighbours(arcs["drawing_id"].tolist(), arcs["u"].tolist(), arcs["v"].tolist())
        out = []
        for (drawing, src), wanted in own.groupby(["drawing_id", "u"])["v"]:
            missing, level = set(wanted), {src: [src]}
            seen, steps = {src}, 0
            while level and missing:
                out += [(drawing, src, dst, level[dst]) for dst in missing & level.keys()]
                missing -= level.keys()
                if most is not None and steps >= most:
                    break
                ahead: dict = {}
                for node, path in level.items():
                    for near in around.get((drawing, node), ()):
                        if near not in seen and (near not in ahead or path < ahead[near]):
                            ahead[near] = path
                seen |= ahead.keys()
                level, steps = {node: [*path, node] for node, path in ahead.items()}, steps + 1
        return pd.DataFrame(out, columns=["drawing_id", "src", "dst", "path"])

    arcs = edges.where("u is not null and v is not null").select("drawing_id", "u", "v", F.lit(False).alias("pair"))
    ends = pairs.where("src is not null and dst is not null").select("drawing_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(True).alias("pair")).distinct()
    schema = f"drawing_id {edges.schema['drawing_id'].dataType.simpleString()}, src {kind}, dst {kind}, path array<{kind}>"
    found = by_drawing(arcs.unionByName(ends), search, schema)
    return pairs.join(found, ["drawing_id", "src", "dst"], "left")


def within(edges: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (drawing_id, src, dst) of different nodes that at most k edges connect."""
    found = shortest_paths(edges, pairs.where("src <> dst"), most=k)
    return found.where(F.col("path").isNotNull()).select("drawing_id", "src", "dst")


def has_any(types: Column, names: list[str]) -> Column:
    return F.arrays_overlap(types, F.array(*(F.lit(n) for n in names)))
