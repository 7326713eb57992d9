"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (as in tests) gets a temporary folder of its own;
    on a cluster that is an error, since a machine-local folder would lose data with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="floorlens-")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/floorlens/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written while the block is open; all but those kept are deleted at its end.

    What is returned from the block must read kept tables only. Each thread has blocks of its own.
    """

    innermost: ContextVar[Scratch | None] = ContextVar("innermost", default=None)

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before = Scratch.innermost.set(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        kept = {t._written for t in tables}
        self.paths = [p for p in self.paths if p not in kept]

    def __exit__(self, *_) -> None:
        Scratch.innermost.reset(self.before)
        for path in self.paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive any executor. They go at the end of the innermost open :class:`Scratch`, by
    :func:`drop_materialised`, or when the operator of the cluster empties the folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if block := Scratch.innermost.get():
        block.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialise` that nothing lazy reads any more."""
    delete(df.sparkSession, df._written)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it has at most ``max_rows`` (short) rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A key with more than one row in HOT of its table is hot; a table has at most HOT such keys.
HOT = 1000


def skewed_left_join(rows: DataFrame, known: DataFrame, keys: list[str], *, broadcast_rows: int = 0) -> DataFrame:
    """``rows`` left-joined with ``known`` on ``keys`` (no nulls), however many rows share a key.

    known: one row for each key, with ``__rows``, the number of its rows (left out of the result). Rows of hot keys,
    of which there are fewer than HOT by definition, take their partners from a broadcast and stay where
    they are; the others are shuffled. ``rows`` is read twice, so it should be a table. A small ``known``
    is broadcast whole.
    """
    if broadcast_rows and known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(known.drop("__rows")), keys, "left")
    total = known.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    hot = known.where(F.col("__rows") * HOT > total).drop("__rows")
    others = known.where(F.col("__rows") * HOT <= total).drop("__rows")
    # fewer than HOT keys: the rows are told apart by a list of them, in place of joins that leave most rows as they are
    kinds = {k: known.schema[k].dataType for k in keys}
    listed = [F.struct(*(F.lit(r[k]).cast(kinds[k]).alias(k) for k in keys)) for r in hot.select(*keys).collect()]
    if not listed:
        return rows.join(others, keys, "left")
    among = F.struct(*(F.col(k).cast(kinds[k]).alias(k) for k in keys)).isin(*listed)
    return rows.where(among).join(F.broadcast(hot), keys).unionByName(rows.where(~among).join(others, keys, "left"))


def null_key(col: str):
    """A string key that tells null from every string: null is ``~``, other values start with ``=``."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("~"))
