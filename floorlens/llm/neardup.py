"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

1. Every text gives its distinct 5-word shingles, a 128-bit digest (BLAKE2) of its word sequence as
   key and a SuperMinHash signature: each shingle deals the ranks 0 to M - 1 to the M components by a
   permutation of its own, and a component keeps the least rank and fraction. Ranks are dealt level by
   level; a text stops as soon as no later level could lower any component.
2. Equal word sequences are one node from here on, so copies cost nothing further.
3. BANDS bands of ROWS components make buckets. A pair with similarity 0.75 shares none of them with
   probability (1 - 0.75**5)**40 = 2e-5, one with 0.8 with 1e-7.
4. In each bucket the signatures' estimates give a maximum spanning forest of the pairs that may be
   similar (estimate of at least MAYBE; one of similarity 0.75 stays below it with about 5e-8, the
   binomial tail of M components); its edges are confirmed on the full shingle sets. So a group of n
   near copies costs about n confirmations, not n * n. A bucket of more than BUCKET nodes is dealt in
   blocks with a forest each; the most central node of every tree stands for it in the next level's
   bucket, so that a large group costs a multiple of its size.
5. Union-find joins confirmed links. Pairs of a bucket that may be similar but are still in different
   components are then all confirmed, inside the bucket, on the full sets, each in the first bucket
   that it shares; the confirmed ones join components. No link between different texts is left out.
   In a bucket of more than BUCKET nodes, the nodes outside its largest component are compared, in
   blocks, with each other and with that component, whose own pairs need no look.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; a text of fewer than five words has its whole sequence as its only shingle; a null doc_id is
a document, but never a component's id unless all its documents have none; a doc_id in several rows
is judged row by row; rows that repeat both doc_id and text are kept or dropped together; an empty
table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, bounded_broadcast, materialise, skewed_left_join
from .graph import UnionFind, components

#: Words of a shingle, percent of similarity.
K, PERCENT = 5, 75
M, BANDS, ROWS = 256, 40, 5
MAYBE = 0.60
#: Most nodes of a bucket that are compared in one go.
BUCKET = 2048
#: Most nodes whose keys (some hundred bytes each) are broadcast to fetch their texts.
BROADCAST_NODES = 50_000
#: Beyond the most blocks of a bucket; a pair of blocks is one number.
BLOCKS = 1 << 24
#: Level from which permutations are kept as arrays.
DENSE = 6
U64 = np.uint64


def superminhash(hashes: np.ndarray, owners: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Signatures (n rows of m values, rank in the upper and fraction in the lower 32 bits).

    hashes, owners: the elements' 64-bit hashes and the sets they are in. The values of an empty set
    are all ones.
    """
    least = np.full(n * m, ~U64(0), U64)
    x, doc = hashes, owners.astype(np.int64)
    drawn: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    deck: np.ndarray | None = None
    for j in range(m):
        if not len(x):
            break
        random = tk.mix64(x + tk.multiple(j + 1))
        k = j + (((random & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if j == DENSE:
            deck = np.empty((len(x), m), np.uint16)
            deck[:] = np.arange(m, dtype=np.uint16)
            row = np.arange(len(x))
            for i in range(j):
                a, b = deck[row, i].copy(), deck[row, drawn[i]].copy()
                deck[row, i], deck[row, drawn[i]] = b, a
        if deck is None:
            # Sparse Fisher-Yates: what stands at a place now is what the last swap there has left.
            here, there = np.full(len(x), j), k.copy()
            for i in range(j):
                here = np.where(drawn[i] == j, moved[i], here)
                there = np.where(drawn[i] == k, moved[i], there)
            to = np.where(k == j, here, there)
            drawn.append(k)
            moved.append(here)
        else:
            row = np.arange(len(x))
            to = deck[row, k].astype(np.int64)
            deck[row, k] = deck[row, j]
        np.minimum.at(least, doc * m + to, (U64(j) << U64(32)) | (random >> U64(32)))
        done = least.reshape(n, m).max(axis=1) < (U64(j + 1) << U64(32))
        stay = ~done[doc]
        if not stay.all():
            x, doc = x[stay], doc[stay]
            drawn, moved = [a[stay] for a in drawn], [a[stay] for a in moved]
            deck = deck[stay] if deck is not None else None
    return least.reshape(n, m)


def sequence_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests (n rows of 16 bytes) of the texts' word sequences, lower-cased."""
    data, edge = tk.LOWER[raw].tobytes(), offsets.tolist()
    # bytes.split takes the six white-space characters that part words here
    keys = [blake2b(b" ".join(data[a:b].split()), digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 16)


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = tk.LOWER[raw]
    starts, ends, owner = tk.word_spans(raw, offsets)
    return tk.span_hashes(raw, starts, ends), owner


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of a two-dimensional array of bytes."""
    n, width = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


_SIGNED = "doc_id long, hash binary, n long, key binary, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tk.string_buffers(batch.column(2))
        for a, b in tk.pieces(offsets):
            n, part, edge = b - a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, owner = _word_hashes(part, edge)
            hashes, owners = tk.shingles(words, owner, n, K)
            values = superminhash(hashes, owners, n)
            sig = (tk.mix64(values) & U64(0xFF)).astype(np.uint8)
            bands = np.zeros((n, BANDS), U64)
            for r in range(ROWS):
                bands = tk.mix64(bands * U64(0xD1342543DE82EF95) + values[:, r : BANDS * ROWS : ROWS] + U64(1))
            bands = tk.mix64(bands + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
            listed = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(tk.counts_of(owners, n)), _fixed(sequence_keys(part, edge)), listed, _fixed(sig)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SIGNED.split(", ")])


def text_hash():
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n (shingles), key (of the word sequence), bands and sig (a byte per component)."""
    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("hash"), F.col("text").cast("string").alias("text")).mapInArrow(tk.freeing(_sign), _SIGNED)


# --------------------------------------------------------------- buckets


class _Rows:
    """Rows of one bucket: nodes, sizes, signatures and what else came along."""

    def __init__(self, tables: list[pa.Table]) -> None:
        table = pa.concat_tables(tables)
        self.node, self.size = table.column("node").to_numpy(), table.column("n").to_numpy()
        self.block = table.column("block").to_numpy()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, M)
        self.sub = table.column("sub")[0].as_py()
        self.comp = table.column("comp").to_numpy() if "comp" in table.schema.names else None
        self.bands = np.stack(table.column("bands").to_pylist()).astype(np.int64) if "bands" in table.schema.names else None
        self.sets = [np.frombuffer(s, U64) for s in table.column("set").to_pylist()] if "set" in table.schema.names else None

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Estimated similarities of row i and others (0 where sizes rule 0.75 out)."""
        same = self.sig[others] == self.sig[i]
        estimate = (same.sum(axis=1) / M - 1 / 256) / (1 - 1 / 256)
        low, high = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        return np.where(100 * low >= PERCENT * high, estimate, 0.0)

    def mine(self, i: int, others: np.ndarray, band: int) -> np.ndarray:
        """Pairs whose first common band this is, and whose blocks this part of the bucket compares.

        The bands' own keys decide, as they make the buckets: a signature's bytes may agree where its values do not.
        """
        first = (self.bands[others] == self.bands[i]).argmax(axis=1) == band
        x, y = np.minimum(self.block[others], self.block[i]), np.maximum(self.block[others], self.block[i])
        return first & ((self.sub < 0) | (x * BLOCKS + y == self.sub))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stretches of rows with equal (bucket, sub); rows come sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        bucket, sub = table.column("bucket").to_numpy(), table.column("sub").to_numpy()
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])) + 1
        edges = [0, *cut.tolist(), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and (bucket[a], sub[a]) != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = (bucket[a], sub[a])
    if held:
        yield pa.concat_tables(held)


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def central(sig: np.ndarray) -> int:
    """The row whose components agree most often with the commonest value of each."""
    common = np.array([np.bincount(sig[:, k]).argmax() for k in range(sig.shape[1])], np.uint8)
    return int((sig == common).sum(axis=1).argmax())


_FOREST = "bucket long, a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A maximum spanning forest of each bucket's (or block's) pairs that may be similar: (bucket, a, b).

    The central node of each tree of a bucket of several blocks comes as a row with a b of -1.
    """
    out: list[tuple[int, int, int]] = []

    def told() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "a", "b"])

    for run in _runs(batches):
        rows = _Rows([run])
        bucket, more = run.column("bucket")[0].as_py(), rows.sub >= 0
        left = np.arange(1, len(rows.node))
        best, parent, at = np.zeros(len(left)), np.zeros(len(left), np.int64), 0
        tree, trees = np.zeros(len(rows.node), np.int64), 1
        while len(left):
            estimate = rows.alike(at, left)
            better = estimate > best
            best[better], parent[better] = estimate[better], at
            k = int(np.argmax(best))
            at = int(left[k])
            if best[k] >= MAYBE:
                x, y = int(rows.node[at]), int(rows.node[parent[k]])
                out.append((bucket, min(x, y), max(x, y)))
                tree[at] = tree[parent[k]]
            else:
                tree[at] = trees
                trees += 1
            keep = np.arange(len(left)) != k
            left, best, parent = left[keep], best[keep], parent[keep]
        if more:
            for t in np.flatnonzero(np.bincount(tree) > 1).tolist():
                mine = np.flatnonzero(tree == t)
                out.append((bucket, int(rows.node[mine[central(rows.sig[mine])]]), -1))
        if len(out) >= 10_000:
            yield told()
    if out:
        yield told()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket that may be similar to one in another component, to be confirmed here."""
    for run in _runs(batches):
        rows = _Rows([run])
        band = run.column("band")[0].as_py()
        involved = np.zeros(len(rows.node), bool)
        for i in range(len(rows.node) - 1):
            others = np.arange(i + 1, len(rows.node))
            others = others[rows.comp[others] != rows.comp[i]]
            if len(others):
                estimate = rows.alike(i, others)
                hit = (estimate >= MAYBE) & rows.mine(i, others, band)
                if hit.any():
                    involved[i] = True
                    involved[others[hit]] = True
        if involved.any():
            yield from run.filter(pa.array(involved)).combine_chunks().to_batches()


def shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many elements of each of the sorted arrays are in the sorted array ``one``."""
    size = np.array([len(x) for x in many])
    if not size.sum() or not len(one):
        return np.zeros(len(many), np.int64)
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.bincount(np.repeat(np.arange(len(many)), size), one[at] == flat, len(many)).astype(np.int64)


def linked(common: np.ndarray, one: int, many: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (one + many - common)


def _confirm_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, confirmed on the full sets of all pairs that are still apart."""
    for run in _runs(batches):
        rows = _Rows([run])
        band = run.column("band")[0].as_py()
        ids, comp = np.unique(rows.comp, return_inverse=True)
        sets, out = UnionFind(len(ids)), []
        for i in range(len(rows.node) - 1):
            others = np.arange(i + 1, len(rows.node))
            root = np.array([sets.find(c) for c in range(len(ids))])
            others = others[root[comp[others]] != root[comp[i]]]
            if not len(others):
                continue
            estimate = rows.alike(i, others)
            others = others[(estimate >= MAYBE) & rows.mine(i, others, band)]
            if not len(others):
                continue
            size = np.array([len(rows.sets[o]) for o in others])
            for o in others[linked(shared(rows.sets[i], [rows.sets[o] for o in others]), len(rows.sets[i]), size)].tolist():
                if sets.union(int(comp[i]), int(comp[o])):
                    out.append((int(rows.comp[i]), int(rows.comp[o])))
        if out:
            yield _pairs_batch(out)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with their sets, those that are links."""
    for batch in batches:
        sets = [[np.frombuffer(s.as_buffer(), U64) for s in batch.column(k)] for k in (2, 3)]
        ok = [bool(linked(shared(x, [y]), len(x), np.array([len(y)]))[0]) for x, y in zip(*sets, strict=True)]
        kept = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) of candidate rows (node, key, text); rows whose text has another key are left out."""
    for batch in batches:
        raw, offsets = tk.string_buffers(batch.column(2))
        for a, b in tk.pieces(offsets):
            n, part, edge = b - a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, owner = _word_hashes(part, edge)
            keys = sequence_keys(part, edge)
            hashes, owners = tk.shingles(words, owner, n, K)
            edge, data = np.searchsorted(owners, np.arange(n + 1)).tolist(), hashes.tobytes()
            rows = [(node, data[8 * edge[i] : 8 * edge[i + 1]]) for i, (node, key) in enumerate(zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), strict=True)) if bytes(keys[i]) == key]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "set"])


# ---------------------------------------------------------------- groups


def _dealt(rows: DataFrame, nodes: DataFrame, known: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """Bucket rows (bucket, sub, block, band, node) with what ``nodes`` knows of them, sorted by bucket."""
    kept = rows.join(nodes.select("node", *known), "node").select("bucket", "sub", "band", "node", F.col("block").cast("long").alias("block"), *known, *extra)
    return kept.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "node")


def candidate_pairs(banded: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): the forests' edges of all buckets (columns bucket, band, node, together), level by level."""
    level, found = banded, []
    while True:
        blocks = F.ceil(F.col("together") / bucket)
        block = F.pmod(F.xxhash64("node", F.lit(len(found))), blocks)
        rows = level.withColumns({"block": block, "sub": F.when(blocks > 1, block).otherwise(F.lit(-1)).cast("long")})
        out = materialise(_dealt(rows, nodes, ("n", "sig")).mapInArrow(tk.freeing(_forest), _FOREST), "neardup-forest")
        found.append(out.where("b >= 0").select("a", "b"))
        trees = out.where("b < 0")
        together = trees.groupBy("bucket").agg(F.count(F.lit(1)).alias("together")).where("together > 1")
        level = materialise(trees.join(together, "bucket").select("bucket", F.lit(0).alias("band"), F.col("a").alias("node"), "together"), "neardup-trees")
        if level.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return materialise(pairs.distinct(), "neardup-pairs")


def _apart(banded: DataFrame, comps: DataFrame, bucket: int) -> DataFrame:
    """The rows of buckets that hold several components, with their component, dealt in pairs of blocks.

    Nodes outside a bucket's largest component make blocks 0 to q - 1, its own nodes the blocks from q
    on; every pair of blocks with one below q is compared.
    """
    placed = materialise(banded.join(comps, "node", "left").select("bucket", "band", "node", F.coalesce("comp", "node").alias("comp")), "neardup-placed")
    held = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    held = held.agg(F.sum("n").alias("__rows"), F.max_by("comp", "n").alias("major"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
    held = materialise(held.where("parts > 1").select("bucket", "__rows", "major", F.struct("most", (F.col("__rows") - F.col("most")).alias("others")).alias("size")), "neardup-several")
    rows = skewed_left_join(placed, held, ["bucket"]).where(F.col("major").isNotNull())
    own, most, others = F.col("comp") == F.col("major"), F.col("size.most"), F.col("size.others")
    q, p = F.ceil(others / bucket), F.ceil(most / bucket)
    deal = F.xxhash64("node")
    block = F.when(own, q + F.pmod(deal, p)).otherwise(F.pmod(deal, q))
    whole = most + others <= bucket
    beside = F.when(whole, F.array(F.lit(-1).cast("long"))).when(own, F.sequence(F.lit(0).cast("long"), q - 1)).otherwise(F.sequence(F.lit(0).cast("long"), q + p - 1))
    rows = rows.withColumn("block", F.when(whole, 0).otherwise(block)).withColumn("other", F.explode(beside))
    sub = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.least("block", "other") * BLOCKS + F.greatest("block", "other"))
    return rows.withColumn("sub", sub.cast("long"))


def classes(docs: DataFrame, *, union_find_edges: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """doc_id, hash, n, key and group (null if the row is in none) of every row.

    A group is told by the row that it keeps: of the least doc_id (component_id) and, among its rows, of
    the least key and hash.
    """
    options = {} if union_find_edges is None else {"union_find_edges": union_find_edges}
    signed = materialise(sign(docs), "neardup-signed")
    with Scratch(docs.sparkSession) as scratch:
        full = signed.where("n > 0")
        # bands and sig follow from the key, so any row's will do
        row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first"), "hash")
        nodes = full.groupBy("key").agg(F.min(row).alias("lead"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "bands", "sig")))
        nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).select("*", "lead.first"), "neardup-nodes")

        banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
        together = materialise(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("together")).where("together > 1"), "neardup-together")
        shared = together.select("bucket", "together", F.col("together").alias("__rows"))
        banded = materialise(skewed_left_join(banded, shared, ["bucket"]).where(F.col("together").isNotNull()), "neardup-buckets")
        pairs = candidate_pairs(banded, nodes, bucket)

        def sets_of(wanted: DataFrame) -> DataFrame:
            # By doc_id and text, so that rows without an id meet their own node only. Few nodes are broadcast, and then no text moves.
            rows = materialise(wanted.join(nodes.select("node", "key", "first", F.col("lead.hash").alias("of")), "node"), "neardup-wanted")
            rows = bounded_broadcast(rows, BROADCAST_NODES)
            texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), text_hash().alias("hash"))
            found = texts.join(rows, texts["doc"].eqNullSafe(rows["first"]) & (texts["hash"] == rows["of"])).select("node", "key", "text").mapInArrow(tk.freeing(_sets), "node long, set binary")
            return materialise(found.dropDuplicates(["node"]), "neardup-sets")

        ends = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "neardup-ends")
        sets = sets_of(ends)
        with_sets = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        links = materialise(with_sets.select("a", "b", "x", "y").mapInArrow(tk.freeing(_confirm), "a long, b long"), "neardup-links")
        comps = components(links, **options)

        schema = "bucket long, sub long, band int, node long, block long, n long, sig binary, bands array<long>, comp long"
        still = materialise(_dealt(_apart(banded, comps, bucket), nodes, ("n", "sig", "bands"), ("comp",)).mapInArrow(tk.freeing(_open), schema), "neardup-open")
        # Ends of pairs within a block have their sets; those of pairs between blocks may lack them.
        lacking = materialise(still.select("node").distinct().join(ends, "node", "left_anti"), "neardup-lacking")
        if not lacking.isEmpty():
            sets = sets.unionByName(sets_of(lacking))
        open_rows = still.join(sets, "node").select("bucket", "sub", "band", "node", "block", "n", "sig", "comp", "bands", "set")
        more = open_rows.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "node").mapInArrow(tk.freeing(_confirm_open), "a long, b long")
        merged = components(more, **options)

        final = comps.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("whole")), "comp", "left")
        alone = merged.select("node", F.col("comp").alias("whole")).join(comps.select(F.col("comp").alias("node")).distinct(), "node", "left_anti")
        placed = final.select("node", F.coalesce("whole", "comp").alias("whole")).unionByName(alone)
        own = F.struct("lead.none", "lead.first", "key", "lead.hash")
        first = placed.join(nodes.select("node", "key", own.alias("own")), "node")
        least = first.groupBy("whole").agg(F.min("own").alias("least"))
        grouped = first.join(least, "whole").select("key", "least")
        copies = nodes.where("copies > 1").select("key", own.alias("own"))
        known = copies.join(grouped, "key", "full").select("key", F.coalesce("least", "own").alias("least"))
        known = known.join(nodes.select("key", F.col("copies").alias("__rows")), "key").select("key", "__rows", F.struct(F.col("least.first").alias("component_id"), F.col("least.key").alias("key"), F.col("least.hash").alias("hash")).alias("group"))
        known = materialise(known, "neardup-known")
        scratch.keep(known)
    # Rows without words share a key, but are in no group.
    slim = signed.select("doc_id", "hash", "n", "key")
    out = skewed_left_join(slim.where("n > 0"), known, ["key"])
    return out.unionByName(slim.where("n = 0").withColumn("group", F.lit(None).cast(out.schema["group"].dataType)))


def groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    component = F.when(F.col("group").isNotNull(), F.col("group.component_id")).otherwise(F.col("doc_id"))
    found = classes(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) without those that copy another: each group keeps one text.

    Rows are told apart by doc_id and text. Null doc_ids are dealt by the text in the join.
    """
    stays = F.col("group").isNull() | (F.col("doc_id").eqNullSafe(F.col("group.component_id")) & (F.col("key") == F.col("group.key")) & (F.col("hash") == F.col("group.hash")))
    gone = classes(docs, **options).where(~stays).select(F.col("doc_id").alias("__doc"), F.col("hash").alias("__hash")).distinct()
    gone = materialise(gone, "neardup-gone")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__doc"]) & (text_hash() == gone["__hash"]), "left_anti")
