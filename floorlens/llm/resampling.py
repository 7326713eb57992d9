"""Target-distribution importance resampling with hashed word n-grams.

Features are runs of 1 to LONGEST consecutive words, each dealt into one of BUCKETS buckets by the CRC-32
of its UTF-8 bytes. The share of a bucket in the target texts against its share in all documents is the gain
of its features; a document's weight is the sum of its features' gains, and a Gumbel number of its doc_id
is added, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Features come from a byte automaton over the Arrow buffers: a table classifies the bytes of a whole
piece of texts, words begin and end where neighbouring classes differ, and the CRC registers of all starts
are advanced together, a byte at a time, through one word, then a space and the second, then the third.

The documents are read twice (counts, then weights). Each task sums its counts for each bucket, so at
most BUCKETS rows leave it, and the driver holds BUCKETS gains, whatever the input. The draw is one
shuffle of slim rows by ranges of the score; ranks are places in a range plus the number of rows before it.

Defined results: null and empty texts have no features, weight 0 and no rank; a null doc_id counts as
the empty string in the draw and comes last among equals; repeated rows are documents of their own,
which tie and take ranks one after the other; without target texts all buckets' gains still follow the
rule; an empty table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import materialise

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: The share of the documents with LEAST_WORDS words or more that is drawn, in percent.
PERCENT = 5

#: Bytes of words once A-Z are lower-cased: digits, a-z and all bytes of other characters.
_PART = np.zeros(256, bool)
_PART[0x30:0x3A] = _PART[0x61:0x7B] = _PART[0x80:] = True


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of the texts, and the number of words of each text."""
    raw = tk.LOWER[raw]
    starts, ends, owner = tk.run_spans(_PART[raw], offsets)
    length = ends - starts
    crc = np.full(len(starts), tk.CRC_START, np.uint32)
    found, owners = [], []
    for k in range(min(LONGEST, len(starts))):
        last = np.arange(k, len(starts))  # the k-th word from each start
        same = owner[last] == owner[: len(last)]
        crc = crc[: len(last)]
        if k:
            crc = tk.crc_bytes(crc, np.uint8(0x20))
        crc = tk.crc_spans(raw, starts[last], length[last], crc)
        found.append(((crc[same] ^ tk.CRC_START) % np.uint32(buckets)).astype(np.int64))
        owners.append(owner[: len(last)][same])
    words = tk.counts_of(owner, len(offsets) - 1)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found or none), np.concatenate(owners or none), words


def _counter(buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(0))
            for first, last in tk.pieces(offsets):
                part = raw[offsets[first] : offsets[last]]
                total += np.bincount(features(part, offsets[first : last + 1] - offsets[first], buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The number of features of all texts in each bucket."""
    counted = texts.select("text").mapInArrow(tk.freeing(_counter(buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for bucket, n in counted.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(of_all: list[int], of_target: list[int]) -> list[int]:
    """The gain of each bucket, in thousandths, rounded down."""
    n, all_n, target_n = len(of_all), float(sum(of_all)), float(sum(of_target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_n + n) / ((s + 1.0) * (target_n + n)))) for s, t in zip(of_all, of_target, strict=True)]


def _weigher(gain: np.ndarray) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(1))
            n_words, n_features, weight = [], [], []
            for first, last in tk.pieces(offsets):
                bucket, owner, words = features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], len(gain))
                # Sums of integers below 2**53 are exact as doubles.
                weight.append(np.bincount(owner, weights=gain[bucket], minlength=last - first).astype(np.int64))
                n_features.append(tk.counts_of(owner, last - first))
                n_words.append(words)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def scored(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``."""
    gain = np.array(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)), np.float64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.freeing(_weigher(gain)), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` of :func:`scored` with ``rank``: 1, 2, 3 and so on for those drawn, null for the others."""
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")
    long_enough = F.col("n_words") >= least_words
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row"))
    # The row's number parts rows that tie in all else, however many they are.
    ranged = rows.where(long_enough).repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers of this kind hold the partition above bit 33 and the place in it below.
    placed = materialise(ranged.withColumn("__place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__place", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    most = before[-1] * percent // 100
    starts = rows.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, before, strict=False)], "__part long, __before long")
    rank = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rank", F.when(rank <= most, rank))
    others = rows.where(~long_enough | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("long"))
    kept = [*(c for c in rows.columns if c != "__row"), "rank"]
    return ranked.select(*kept).unionByName(others.select(*kept))


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row's n_words, n_features, weight, score and rank in the draw towards ``target``."""
    return drawn(scored(docs, target, buckets=buckets, seed=seed), percent=percent, least_words=least_words)
