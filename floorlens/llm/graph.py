"""Connected components of an edge table, by contraction and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Most edges that one task joins up by union-find; larger graphs are contracted first.
UNION_FIND_EDGES = 2_000_000


class UnionFind:
    """Union-find over small integers; the root of a set is its least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    if not pairs:
        return
    nodes, index = np.unique(np.concatenate(pairs), return_inverse=True)
    sets = UnionFind(len(nodes))
    for x, y in index.reshape(-1, 2).tolist():
        sets.union(x, y)
    comp = nodes[[sets.find(i) for i in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], names=["node", "comp"])


def components(edges: DataFrame, *, union_find_edges: int = UNION_FIND_EDGES) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b, long); comp tells components apart.

    While the graph is larger than one task's share, every node is merged into the neighbour (or
    itself) of least random rank, which takes away a constant share of the nodes in each round; the
    rest is joined up by union-find in one task, whose input is so bounded.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while edges.count() > union_find_edges:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("rank"), F.col(c).alias("node"))  # noqa: E731, B023
        least = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        merged = least.select(F.col("a").alias("node"), F.least(rank("a"), "near")["node"].alias("to"))
        rounds.append(merged := materialise(merged, "merged"))
        a, b = (merged.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialise(edges.where("a <> b").distinct(), "edges")
    found = edges.coalesce(1).mapInArrow(_union_find, "node long, comp long")
    for merged in reversed(rounds):
        after = found.select(F.col("node").alias("to"), "comp")
        found = merged.join(after, "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
    return materialise(found, "components")
