"""Spatial joins within drawings: grid buckets as equi-join keys, exact predicates after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell in millimetres; rooms are a few metres wide.
CELL = 8000


def boxed(df: DataFrame, box: Column, margin: float = 0.0) -> DataFrame:
    """Adds ``box``, a struct of x0, y0, x1, y1, grown by the margin."""
    grown = F.struct((box["x0"] - margin).alias("x0"), (box["y0"] - margin).alias("y0"), (box["x1"] + margin).alias("x1"), (box["y1"] + margin).alias("y1"))
    return df.withColumn("box", grown)


def _cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(f"box.{a}") / cell), F.floor(F.col(f"box.{b}") / cell))
    return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def box_join(a: DataFrame, b: DataFrame, *, key: str = "drawing_id", cell: float = CELL) -> DataFrame:
    """Pairs of rows of a drawing whose boxes (columns ``box``) touch.

    The sides must have no other column names in common than ``key`` and ``box``. Both are dealt into
    the grid cells that their boxes meet and joined by (key, cell); a pair is kept in the cell that
    holds the lower left corner of the boxes' common part, so no pair appears twice and nothing has
    to be made distinct. The result has ``box`` and ``other_box``. Neither side is broadcast: rows with rings are many
    times as large as the files that Spark judges them by.
    """
    left, right = _cells(a, cell), _cells(b.withColumnRenamed("box", "other_box").withColumn("box", F.col("other_box")), cell).drop("box")
    both = left.join(right.hint("merge"), [key, "cx", "cy"])
    x, y = F.greatest("box.x0", "other_box.x0"), F.greatest("box.y0", "other_box.y0")
    touch = (x <= F.least("box.x1", "other_box.x1")) & (y <= F.least("box.y1", "other_box.y1"))
    owner = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    return both.where(touch & owner).drop("cx", "cy")


def nearest(pairs: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
