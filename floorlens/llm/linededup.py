"""Line dedup: lines that many documents share are dropped from all of them.

Only DataFrame and SQL functions run here. A line's key is the line without the six white-space
characters at both ends, A-Z lower-cased, and stands for the line as the first half of its SHA-256. The
distinct keys of each document are exploded, and the documents of each key counted; keys of at least
``least`` code points in at least ``documents`` documents are frequent. Then the lines are exploded with
their positions and joined with the frequent keys, the positions to drop are gathered for each text,
and each text is put together again from what lies between them.

Only hashes and positions are shuffled by key; frequent keys are broadcast if a count proves that they
are at most BROADCAST_KEYS, and else joined by a shuffle. Texts move once, to meet their positions. They
are told apart by the first half of their SHA-256, so copies share one list of positions, and a
large group of copies is one row on the side of the lists, its rows being split by Spark where they
are many.

Defined results: a null or empty text is one empty line, which has no key that counts while ``least`` is 1
or more; a text that loses all lines becomes empty; documents are told apart by doc_id, so repeated
rows count once for a key, as do all rows with a null doc_id; each of repeated rows gets a result; an
empty table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, null_key

LEAST, DOCUMENTS = 1, 10
#: Most frequent keys (of 16 bytes) that are broadcast.
BROADCAST_KEYS = 200_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def content_id(value: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a string."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def line_key(line: Column) -> Column:
    """The line stripped and lower-cased; only A-Z have capitals here, so others than ASCII lines are translated."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frequent_keys(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``key`` (a content id) of the line keys that are found in at least ``documents`` documents."""
    keys = docs.select(null_key("doc_id").alias("doc"), F.explode(F.array_distinct(F.transform(lines(F.coalesce("text", F.lit(""))), line_key))).alias("key"))
    held = keys.where(F.char_length("key") >= least).select("doc", content_id(F.col("key")).alias("key"))
    return held.groupBy("key").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= documents).select("key")


def dropped_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``text_id`` and ``dropped``, the sorted positions (from 0) of its lines with a frequent key."""
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(content_id(text).alias("text_id"), F.posexplode(lines(text)).alias("pos", "line"))
    keyed = placed.select("text_id", "pos", content_id(line_key(F.col("line"))).alias("key"))
    found = keyed.join(bounded_broadcast(frequent, BROADCAST_KEYS), "key")
    return found.groupBy("text_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _between(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` at other positions than ``dropped``, joined; linear in the number of lines."""
    whole = F.struct(lines(text).alias("all"), dropped.alias("cut"))

    def put_together(x: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), x["cut"], F.array(F.size(x["all"])))
        # Each lambda variable is computed once, however often the inner function reads it.
        bound = F.transform(F.array(F.struct(x["all"].alias("all"), edges.alias("edge"))), lambda y: F.flatten(F.transform(F.sequence(F.lit(0), F.size(y["edge"]) - 2), lambda i: F.slice(y["all"], y["edge"][i] + 2, y["edge"][i + 1] - y["edge"][i] - 1))))
        return F.array_join(bound[0], "\n")

    return F.transform(F.array(whole), put_together)[0]


def without_frequent_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text (what is left), n_lines (before) and n_dropped of each row of ``docs``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    frequent = materialise(frequent_keys(docs, least, documents), "frequent-lines")
    dropped = materialise(dropped_lines(docs, frequent), "dropped-lines")
    met = docs.withColumn("text_id", content_id(F.col("text"))).join(dropped, "text_id", "left")
    return met.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_between(F.col("text"), F.col("dropped"))).alias("text"),
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
