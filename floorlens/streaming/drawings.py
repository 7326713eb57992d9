"""A folder of derived rooms as a stream: the batch plan, run on each micro-batch of new drawings."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegralType, StructField, StructType

#: Groups of drawings in the state of :func:`whole_drawings`; fixed, since a checkpoint keeps its groups.
GROUPS = 256


def process_folder(spark: SparkSession, path: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``plan`` over all new Parquet files of the folder and appends its rows to ``sink``.

    Drawings are independent, so a drawing must be whole in a micro-batch; files hold whole drawings.
    Batches are written under their number, so a batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_drawings(pieces: DataFrame, *, wait_ms: int | None = None) -> DataFrame:
    """A stream of pieces of drawings as a stream of whole ones: its rows with ``complete``.

    Pieces: drawing_id, piece, n_pieces and more columns; a piece may have many rows, all in one micro-batch. A drawing's
    rows are held in the state until all its pieces are there, and then let go together; a piece that comes again
    counts once. With ``wait_ms``, a drawing for which nothing new has come for so long is let go as it is, as not
    complete; a stream with such timers has always something to wait for, and does not end by itself.

    The state is kept by GROUPS groups of drawings, so that Python puts many drawings together at a time.
    """
    schema = pieces.schema
    # A null would make doubles of a group's integers, so that long ids became others: integers go with flags.
    numbers = [f.name for f in schema if isinstance(f.dataType, IntegralType)]
    out = StructType([*schema.fields, *(StructField(f"__no_{c}", BooleanType()) for c in numbers), StructField("complete", BooleanType())])
    drawing = [c for c in ("drawing_id", "__no_drawing_id") if c in out.names]

    def missing(rows: pd.DataFrame, column: str) -> pd.Series:
        return rows[f"__no_{column}"] if column in numbers else rows[column].isna()

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if wait_ms is not None else 0
        parts = [pickle.loads(state.get[0]).assign(__new=False)] if state.exists else []
        if not state.hasTimedOut:
            parts += [frame.drop(columns="__group").assign(__new=True, __since=now) for frame in frames]
        rows = pd.concat(parts, ignore_index=True)
        rows["__drawing"] = rows.groupby(drawing, dropna=False, sort=False).ngroup()
        fresh = rows[rows["__new"]].drop_duplicates("__drawing").set_index("__drawing")
        needed = fresh["n_pieces"].mask(missing(fresh, "n_pieces"))
        rows = rows[~missing(rows, "piece")]
        # Of a piece that comes again the rows that came first stay; those held stand before the new ones.
        again = rows["__new"] & ~rows.groupby(["__drawing", "piece"])["__new"].transform("min")
        rows = rows[~again]
        there = rows.drop_duplicates(["__drawing", "piece"]).groupby("__drawing").size()
        complete = rows["__drawing"].map(there) >= rows["__drawing"].map(needed)
        go = complete
        if wait_ms is not None:
            touched = rows["__drawing"].isin(fresh.index)
            rows = rows.assign(__since=rows["__since"].mask(touched, now))
            go = complete | (~touched & (rows["__since"] + wait_ms <= now))
        rest = rows[~go].drop(columns=["__new", "__drawing"])
        if len(rest):
            state.update((pickle.dumps(rest),))
            if wait_ms is not None:
                state.setTimeoutDuration(max(1, int(rest["__since"].min()) + wait_ms - now))
        elif state.exists:
            state.remove()
        yield rows.assign(complete=complete)[go].sort_values(["__drawing", "piece"], kind="stable")[out.names]

    group = F.pmod(F.xxhash64("drawing_id"), F.lit(GROUPS)).alias("__group")
    filled = [F.coalesce(c, F.lit(0).cast(schema[c].dataType)).alias(c) if c in numbers else F.col(c) for c in schema.names]
    dealt = pieces.select(group, *filled, *(F.isnull(c).alias(f"__no_{c}") for c in numbers)).groupBy("__group")
    timer = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    found = dealt.applyInPandasWithState(gather, out, "held binary", "append", timer)
    return found.select(*(F.when(~F.col(f"__no_{c}"), F.col(c)).alias(c) if c in numbers else F.col(c) for c in schema.names), "complete")


def process_pieces(spark: SparkSession, path: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, *, wait_ms: int | None = None, files: int = 1000) -> StreamingQuery:
    """As :func:`process_folder`, for drawings whose pieces arrive in different files: ``plan`` gets whole drawings only.

    Without ``wait_ms`` the query ends when all files are read, and what is not whole waits in the checkpoint for the
    next run; with it the query goes on, and drawings that wait for longer come with ``complete`` false.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    written = whole_drawings(stream, wait_ms=wait_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (written.trigger(availableNow=True) if wait_ms is None else written.trigger(processingTime="1 second")).start()
