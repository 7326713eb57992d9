"""Where intermediate tables are kept: the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="floorlens-"))
    return _OWN[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/floorlens/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys to four tasks a core, for work in Python and on long expressions.

    A table of few bytes is otherwise read, and after a shuffle put together again, by a task or two, however
    long its rows take.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back, which cuts the lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_rows(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialise` for rows that grow with the input: what they are joined with is dealt by the keys.

    Spark takes a table for as large as its files, and those of plans are a small part of their rows, which it
    would broadcast through the driver.
    """
    return materialise(df, label).hint("merge")
