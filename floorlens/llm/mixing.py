"""Mixing sources to target weights.

The words of each source, in a fixed order of its documents, are packed into blocks of BLOCK words
(the last one shorter). The mix is a sequence of slots, one block each, cut into output shards. Every
shard draws multinomial source counts; a source's n-th slot takes block ``perm(n mod blocks)`` of
pass ``n div blocks``, where each pass has a pseudorandom permutation of its own. Slots and blocks are
joined by (source, block). A source's last slot is cut so that its taken words equal its target,
rounded. Draws beyond a source's quota go, shard by shard in pseudorandom order, to the sources that
would end below theirs.

Orders and draws depend on the seed and the data only, never on partitions, so reruns agree.

Targets: sources by code point, null last, have the weights WEIGHTS in turn and share SHARE times all
words; no target exceeds MOST times its source's words, and what is cut off is shared by weight among
the others until none is above.

Defined results: a null text has no words; a null source is a source of its own; documents without
words are listed with nothing taken; repeated rows are documents of their own; without any words all
targets are 0; other columns than doc_id, source and text are passed on but not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, null_key
from .textkernel import mix64

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words of a block, slots of a shard, shards that one row of running totals covers at least.
BLOCK, SLOTS, GROUP = 256, 2048, 64
#: Most numbers (groups times sources) in the table of running totals; groups grow beyond that.
CELLS = 1 << 21
SEED = 20_240_601
U64 = np.uint64


# --------------------------------------------------------------- targets


def targets(sizes: list[int], weights: list[float] | None = None, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target words of sources of these sizes, in the order of the weights."""
    weights = weights or [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    left = min(share, most) * sum(sizes)
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


# ---------------------------------------------------------- permutations


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0 to n - 1 takes each place (n and key per element).

    A four-round Feistel network on the next even power of two, walked until the value is in range.
    """
    n, key = n.astype(U64), key.astype(U64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2).astype(np.int64))
    bits = np.where((U64(1) << (2 * bits).astype(U64)) < n, bits + 1, bits).astype(U64)
    mask, out, todo = (U64(1) << bits) - U64(1), place.astype(U64), np.arange(len(place))
    while len(todo):
        x, b, m = out[todo], bits[todo], mask[todo]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] * U64(0x9E3779B97F4A7C15) + U64(r + 1)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


# ----------------------------------------------------------------- plan


@dataclass
class Plan:
    """What all tasks know of the sources, some 100 bytes of each: sizes, blocks, wanted words and slots, all draws."""

    keys: list[str]
    size: np.ndarray
    target: np.ndarray
    want: np.ndarray
    blocks: np.ndarray
    quota: np.ndarray
    block: int
    slots: int
    seed: int
    group: int = GROUP
    final: np.ndarray | None = None

    @property
    def shards(self) -> int:
        return -(-int(self.quota.sum()) // self.slots)

    def tail(self) -> np.ndarray:
        """Words of each source's last block."""
        return self.size - (self.blocks - 1) * self.block

    def key_of(self, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
        return mix64(np.asarray(source, U64) * U64(0x9E3779B97F4A7C15) + np.asarray(epoch, U64) * U64(0xD1342543DE82EF95) + U64(self.seed))

    def words_before(self, source: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Words of a source's first n slots, uncut: all blocks are full but the last, which comes once a pass."""
        blocks = self.blocks[source]
        epoch, place = n // blocks, n % blocks
        tail = self.size[source] - (blocks - 1) * self.block
        # The last block's place in the pass is where the permutation takes place p to blocks - 1.
        at = self.tail_place(source, epoch)
        return epoch * self.size[source] + place * self.block - np.where(place > at, self.block - tail, 0)

    def tail_place(self, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
        """Where each source's last block comes in a pass; of a pass that is asked for, all sources' places are worked out at once."""
        held = self.__dict__.setdefault("_tails", {})
        out = np.zeros(len(source), np.int64)
        for e in np.unique(epoch).tolist():
            if e not in held:
                every = np.arange(len(self.blocks))
                blocks = np.maximum(self.blocks, 1)
                held[e] = places_of(blocks - 1, blocks, self.key_of(every, np.full(len(every), e)))
            at = epoch == e
            out[at] = held[e][source[at]]
        return out

    def draw(self, shard: int) -> np.ndarray:
        """Multinomial counts of a shard's slots by source."""
        total = int(self.quota.sum())
        n = min(self.slots, total - shard * self.slots)
        return np.random.Generator(np.random.PCG64([self.seed, shard])).multinomial(n, self.quota / total)

    def shards_of(self, group: int) -> range:
        return range(group * self.group, min((group + 1) * self.group, self.shards))


def places_of(value: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places that the permutations of n take to values: the inverse of :func:`permuted`, Feistel walks backwards."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.int64)
    bits += (np.int64(1) << 2 * bits) < n
    x, todo = np.asarray(value, np.int64).copy(), np.arange(len(n))
    while len(todo):
        b = bits[todo]
        mask = (np.int64(1) << b) - 1
        left, right = x[todo] >> b, x[todo] & mask
        for r in reversed(range(4)):
            mixed = mix64(left.astype(U64) + key[todo] * U64(0x9E3779B97F4A7C15) + U64(r + 1))
            left, right = right ^ (mixed & mask.astype(U64)).astype(np.int64), left
        x[todo] = left << b | right
        todo = todo[x[todo] >= n[todo]]
    return x


def _place_of(value: int, n: int, key: int) -> int:
    return int(places_of(np.array([value]), np.array([n]), np.array([key], U64))[0])


def make_plan(sizes: dict[str, int], *, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, weights=None, share: float = SHARE, most: float = MOST) -> Plan:
    """sizes: words by source key, in the order of the sources. Keys are those of :func:`null_key`."""
    keys = list(sizes)
    target = np.array(targets(list(sizes.values()), weights, share, most), np.float64)
    size = np.array(list(sizes.values()), np.int64)
    want = np.minimum(np.round(target).astype(np.int64), np.floor(most * size).astype(np.int64))
    blocks = -(-size // block)
    plan = Plan(keys, size, target, want, blocks, np.zeros(len(keys), np.int64), block, slots, seed)
    # The least number of slots whose words reach what is wanted, for all sources side by side.
    at = np.flatnonzero(want > 0)
    low, high = np.zeros(len(at), np.int64), 2 * blocks[at] * max(1, int(np.ceil(most))) + 2
    while (unsettled := np.flatnonzero(low < high)).size:
        mid = (low[unsettled] + high[unsettled]) // 2
        enough = plan.words_before(at[unsettled], mid) >= want[at[unsettled]]
        high[unsettled] = np.where(enough, mid, high[unsettled])
        low[unsettled] = np.where(enough, low[unsettled], mid + 1)
    plan.quota[at] = low
    # More shards share a row where the table of running totals would have more than CELLS numbers.
    plan.group = max(GROUP, -(-plan.shards * len(keys) // CELLS))
    return plan


def _total_draws(plan: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g in frame["id"].tolist():
                yield pd.DataFrame({"id": [g], "counts": [sum(plan.draw(k) for k in plan.shards_of(g))]})

    return run


def _slot_rows(plan: Plan, shard: int, counts: np.ndarray, start: np.ndarray, over: int) -> tuple[pd.DataFrame, int]:
    """The slots of a shard (shard, slot, source number, epoch, block, words taken of it), and how many went beyond a quota.

    start: slots of each source in the shards before. over: how many of those went beyond a quota.
    """
    missing = np.maximum(plan.quota - plan.final, 0)
    edges = np.cumsum(missing)
    slot = np.random.Generator(np.random.PCG64([plan.seed, shard, 1])).permutation(int(counts.sum()))
    source = np.repeat(np.arange(len(counts)), counts)
    number = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(source))
    beyond = np.flatnonzero(number >= plan.quota[source])
    if len(beyond):
        key = plan.key_of(np.full(len(beyond), 2**32), np.zeros(len(beyond)))
        turn = permuted(over + np.arange(len(beyond)), np.full(len(beyond), int(edges[-1])), key)
        to = np.searchsorted(edges, turn, "right")
        source[beyond], number[beyond] = to, plan.final[to] + turn - (edges[to] - missing[to])
    blocks = plan.blocks[source]
    epoch = number // blocks
    taken = permuted(number % blocks, blocks, plan.key_of(source, epoch))
    length = np.where(taken == blocks - 1, plan.tail()[source], plan.block)
    take = np.minimum(length, plan.want[source] - plan.words_before(source, number))
    rows = {"shard": np.full(len(slot), shard), "slot": slot, "src": source.astype(np.int32), "epoch": epoch.astype(np.int32), "block": taken, "take": take.astype(np.int32)}
    return pd.DataFrame(rows), len(beyond)


def _slots(plan: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, start, over in zip(frame["id"].tolist(), frame["start"].tolist(), frame["over"].tolist(), strict=True):
                start = np.array(start, np.int64)
                for k in plan.shards_of(g):
                    counts = plan.draw(k)
                    rows, beyond = _slot_rows(plan, k, counts, start, over)
                    yield rows
                    start, over = start + counts, over + beyond

    return run


def draw_slots(spark, plan: Plan) -> DataFrame:
    """The mix as a table of slots.

    Running totals stand in a table with a row for each group of shards, at most CELLS numbers in all;
    a task gets its own group's row.
    """
    groups = -(-plan.shards // plan.group)
    if not groups:
        return spark.createDataFrame([], "shard long, slot long, src int, epoch int, block long, take int")
    deal = max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))
    rows = sorted((r["id"], r["counts"]) for r in spark.range(0, groups, 1, deal).mapInPandas(_total_draws(plan), "id long, counts array<long>").collect())
    ends = np.cumsum(np.array([c for _, c in rows], np.int64), axis=0)
    starts = np.concatenate([np.zeros((1, len(plan.keys)), np.int64), ends[:-1]])
    plan.final = ends[-1]
    over = np.maximum(starts - plan.quota, 0).sum(axis=1)
    told = pd.DataFrame({"id": range(groups), "start": starts.tolist(), "over": over})
    ids = spark.createDataFrame(told, "id long, start array<long>, over long").repartition(deal, "id")
    # Written first, so that the planner knows its size: the estimate for rows made from few is far too low.
    return materialise(ids.mapInPandas(_slots(plan), "shard long, slot long, src int, epoch int, block long, take int"), "mix-slots")


# ---------------------------------------------------------------- Spark


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size`` (words), ``__hash`` (of the text) and ``__key`` (of the source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.withColumns({"__size": size, "__hash": F.xxhash64(text), "__key": null_key("source")})


def placed(held: DataFrame) -> DataFrame:
    """The frame of :func:`sized` with ``__start``: words of the document's source before it.

    A prefix sum in two levels: documents in hashed buckets, and the sums of the buckets. There are as
    many buckets as the root of the number of rows, so that neither level grows faster than that.
    """
    buckets = max(1, isqrt(held.count()))
    held = held.withColumn("__bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(buckets)))
    sums = materialise(held.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__words")), "mix-buckets")
    first = F.sum("__words").over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__key", "__bucket", F.coalesce(first, F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__key", "__bucket").orderBy("doc_id", "__size", "__hash").rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumn("__within", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(sums, ["__key", "__bucket"])
    return out.withColumn("__start", F.col("__first") + F.col("__within")).drop("__bucket", "__first", "__within")


def source_sizes(held: DataFrame) -> dict[str, int]:
    """Words by source, held by the driver: a row for each source."""
    rows = held.groupBy("__key").agg(F.sum("__size").alias("n")).collect()
    return {r["__key"]: r["n"] for r in sorted(rows, key=lambda r: (r["__key"] == "~", r["__key"]))}


def mix(held: DataFrame, **options) -> tuple[DataFrame, DataFrame, Plan]:
    """(documents, spans, plan) of the frame of :func:`sized`.

    documents: the frame with __start. spans: a row per taken part of a document, with
    key, start (of the document in its source), shard, slot, epoch, low and high (words of the document,
    high excluded). Documents with words are told apart by (__key, __start).
    """
    spark = held.sparkSession
    plan = make_plan(source_sizes(held), **options)
    documents = placed(held)
    number = spark.createDataFrame([(k, i) for i, k in enumerate(plan.keys)], "__key string, src int")
    b, start, size = F.lit(plan.block), F.col("__start"), F.col("__size")
    slim = documents.where(size > 0).select("__key", "__start", "__size").join(F.broadcast(number), "__key")
    parts = slim.withColumn("block", F.explode(F.sequence(F.floor(start / b), F.floor((start + size - 1) / b))))
    taken = parts.join(draw_slots(spark, plan), ["src", "block"])
    low, high = F.greatest(F.col("block") * b - start, F.lit(0)), F.least(F.col("block") * b + F.col("take") - start, size)
    spans = taken.select("__key", "__start", "shard", "slot", "epoch", low.alias("low"), high.alias("high")).where("high > low")
    return documents, spans, plan


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    slim = materialise(sized(docs).select("doc_id", "source", "__size", "__hash", "__key"), "mix-sizes")
    documents, spans, plan = mix(slim, **options)
    rows = [(k, int(s), float(t)) for k, s, t in zip(plan.keys, plan.size, plan.target, strict=True)]
    known = docs.sparkSession.createDataFrame(rows, "__key string, source_size long, target double")
    sums = spans.groupBy(F.col("__key").alias("__k"), F.col("__start").alias("__s")).agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # A document without words shares its start with the next one; it gets no sums.
    own = (F.col("__key") == F.col("__k")) & (F.col("__start") == F.col("__s")) & (F.col("__size") > 0)
    out = documents.join(sums, own, "left").join(F.broadcast(known), "__key")
    return out.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in the columns of ``docs``: a row per document and pass from which anything is taken.

    The text is the document's own where it is taken whole, else its taken words, joined by a space.
    ``n_chars`` (where there is such a column) is the text's length.
    """
    documents, spans, _ = mix(sized(docs), **options)
    pieces = spans.groupBy("__key", "__start", F.col("epoch").alias("__epoch")).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("__spans"), F.sum(F.col("high") - F.col("low")).alias("__taken"))
    joined = documents.where(F.col("__size") > 0).join(pieces, ["__key", "__start"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int"))))
    whole = F.col("__taken") == F.col("__size")
    joined = joined.withColumn("__words", F.when(~whole, words))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(cut, " "))
    joined = joined.withColumn("text", text)
    return joined.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
