"""Token-ID output in a word-aligned binary format (Simple-8b).

A shard is one file image::

    8 bytes   magic "FLS8B001"
    u32 x 4   documents, blocks, ids of a block, reserved
    u64 x 2   ids, 64-bit words
    i64[d]    document ids            u32[d]   ids of each document
    u8[d]     1 where the id is null  (padded to 8 bytes)
    u32[b+1]  first word of each block, and their number   (padded to 8 bytes)
    u64[w]    words

The top four bits of a word select how many ids of how many bits the other sixty hold. The last
selector is an escape: the next word is one raw 64-bit id. Blocks hold BLOCK ids each (the last one
the rest) and begin at a word of their own, so any block can be decoded alone and all of them at
once. Little-endian throughout.

Shards are stored as binary values of a Parquet table in the shared folder, one row per shard, which
Spark commits atomically and reads from any store. Documents are range-partitioned by doc_id and
sorted, nulls first, so shards in order of ``part`` and ``seq`` hold ascending doc_ids.

Defined results: a null or empty text holds the end id only; a null doc_id sorts before all others;
repeated rows are written as often as they occur; an empty table gives no shards and no rows; other
columns than doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fresh_path, materialise

MAGIC, BLOCK, END_ID = b"FLS8B001", 256, 1
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 19
#: Ids of a word and bits of each, by selector; the last selector is the escape. Fixed values.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64)
ESCAPE = 15
#: Bytes of text that are tokenized together.
PIECE = 2 << 20
U64 = np.uint64
_COUNTS, _BITS = np.array(COUNTS), np.array(BITS)


def _choices(ids: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The selector for a word that begins at each id, and how many ids it takes. room: ids to the block's end."""
    n = len(ids)
    bits = np.zeros(n, np.uint8)
    high = int(ids.max()) if n else 0
    for b in range(high.bit_length()):
        bits += ids >= U64(1 << b)
    selector = np.full(n, ESCAPE, np.uint8)
    open_ = np.ones(n, bool)
    top: dict[int, np.ndarray] = {1: bits}

    def window(k: int) -> np.ndarray:
        """Most bits of ids i to i + k - 1, of those before the array's end."""
        if k not in top:
            half = 1 << (k.bit_length() - 1)
            if half == k:
                a, step = window(k // 2), k // 2
            else:
                a, step = window(half), k - half
            out = a.copy()
            if step < n:
                np.maximum(a[: n - step], a[step:], out=out[: n - step])
            top[k] = out
        return top[k]

    least = int(bits.min()) if n else 0
    for s in range(ESCAPE):
        if BITS[s] < least:
            continue
        # Across a block's end later ids count too, which can only choose a word that holds fewer ids.
        fits = open_ & (window(COUNTS[s]) <= BITS[s])
        selector[fits] = s
        open_ &= ~fits
    take = np.minimum(_COUNTS[selector], room)
    return selector, take


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and block offsets (in words) of an array of unsigned ids."""
    ids = np.ascontiguousarray(ids, U64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(1, np.uint32)
    place = np.arange(n)
    room = np.minimum((place // BLOCK + 1) * BLOCK, n) - place
    selector, take = _choices(ids, room)
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    begins, live = [], np.arange(blocks)
    while len(live):
        begins.append(at[live])
        at[live] += take[at[live]]
        live = live[at[live] < stop[live]]
    begin = np.sort(np.concatenate(begins))
    kind, held = selector[begin], take[begin]
    length = np.where(kind == ESCAPE, 2, 1)
    where = np.concatenate([[0], np.cumsum(length)])
    words = np.zeros(where[-1], U64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        first, slot, some = begin[mine], where[mine], held[mine]
        value = np.full(len(mine), U64(int(s) << 60), U64)
        if s == ESCAPE:
            words[slot + 1] = ids[first]
        elif BITS[s]:
            for k in range(COUNTS[s]):
                has = k < some
                if has.all():
                    value |= ids[first + k] << U64(BITS[s] * k)
                elif has.any():
                    value[has] |= ids[first[has] + k] << U64(BITS[s] * k)
        words[slot] = value
    starts = where[np.searchsorted(begin, np.arange(blocks) * BLOCK)]
    return words, np.append(starts, where[-1]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks that begin at the words ``offsets`` (the last one an end), n in all."""
    if not n:
        return np.zeros(0, U64)
    kind = (words >> U64(60)).astype(np.int64)
    if (kind == ESCAPE).any():
        raw = np.zeros(len(words), bool)
        i = 0
        marks = np.flatnonzero(kind == ESCAPE)
        for m in marks.tolist():  # a raw word may look like an escape itself
            if m >= i:
                raw[m + 1] = True
                i = m + 2
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    kind = kind[heads]
    block = np.searchsorted(offsets[:-1], heads, "right") - 1
    nominal = _COUNTS[kind]
    before = np.concatenate([[0], np.cumsum(nominal)])
    opening = np.searchsorted(heads, offsets[:-1])
    inside = before[:-1] - before[opening][block]
    first = block * BLOCK + inside
    some = np.minimum(nominal, np.minimum((block + 1) * BLOCK, n) - first)
    out = np.zeros(n, U64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[first[mine]] = words[heads[mine] + 1]
            continue
        if not BITS[s]:
            continue
        value, at, held, mask = words[heads[mine]], first[mine], some[mine], U64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            has = k < held
            if has.all():
                out[at + k] = (value >> U64(BITS[s] * k)) & mask
            elif has.any():
                out[at[has] + k] = (value[has] >> U64(BITS[s] * k)) & mask
    return out


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    head = MAGIC + struct.pack("<4I2Q", len(doc_ids), len(offsets) - 1, BLOCK, 0, len(ids), len(words))
    null = np.array([d is None for d in doc_ids], np.uint8)
    number = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (number.tobytes(), _padded(np.asarray(lengths, "<u4").tobytes()), _padded(null.tobytes()), _padded(offsets.astype("<u4").tobytes()))
    return b"".join((head, *parts, words.astype("<u8").tobytes()))


class Shard:
    """A view of a file image: document table, whole decoding, and decoding of single blocks."""

    def __init__(self, image: bytes | memoryview) -> None:
        view = memoryview(image)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_blocks, self.block, _, self.n_ids, n_words = struct.unpack_from("<4I2Q", view, 8)
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes + -out.nbytes % 8
            return out

        number, self.lengths, null = take("<i8", self.n_docs), take("<u4", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if x else d for d, x in zip(number.tolist(), null.tolist(), strict=True)]
        self.offsets, self.words = take("<u4", self.n_blocks + 1).astype(np.int64), take("<u8", n_words)

    def ids(self) -> np.ndarray:
        return decode(self.words, self.offsets, self.n_ids)

    def ids_of_block(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return decode(self.words[a:b], np.array([0, b - a]), min(self.block, self.n_ids - k * self.block))


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True


def _latin(raw: np.ndarray) -> np.ndarray:
    """Which bytes are a to z or part of a letter from U+00C0 to U+00FF."""
    out = _LETTER[raw]
    pair = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    out[:-1] |= pair
    out[1:] |= pair
    return out


def encodes_by_words(path: str) -> bool:
    """Whether the tokenizer file is of the kind that :class:`WordEncoder` takes word by word.

    Its normalizer and splitter must be those of the lower-case tokenizer with word ends; then no piece
    spans white space, a word's ids depend on the word alone, and each word's last id is that of an end.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, added = told["model"], told.get("added_tokens") or []
    # What the tokenizer file says of its parts.
    parts = ["NFC", "Replace", "Lowercase"]
    split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    normal = (told.get("normalizer") or {}).get("normalizers", [])
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in normal] == parts
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": split}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and (model["type"], model["end_of_word_suffix"]) == ("BPE", "</w>")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    )


class WordEncoder:
    """Token ids of texts through a cache of words.

    For a tokenizer that lower-cases, drops white space and whose pieces never span it, the ids of a
    text are those of its words, put together; a stop or comma after a letter is a piece of its own.
    Words new to the cache are encoded by the library, many at a time. A word is found by its hash and
    taken only if its bytes are the same. Texts are encoded whole by the library if the tokenizer is of
    another kind (see :func:`encodes_by_words`), if one of a batch holds an added token's string, or if
    different words of a batch and the cache have one hash. The cache holds sorted arrays, about 70
    bytes a word.
    """

    MOST, BYTES = 2_000_000, 1 << 26
    #: Words of one call of the library, whose result takes about a kilobyte a word.
    AT_ONCE = 10_000
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = encodes_by_words(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.text_begin, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text, self.filled = np.zeros(1 << 20, np.uint8), 0

    def _sizes(self, words: list[bytes], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has. simple: words of Latin letters only, each one piece."""
        if len(words) > self.AT_ONCE:
            each = [self._sizes(words[i : i + self.AT_ONCE], simple) for i in range(0, len(words), self.AT_ONCE)]
            return np.concatenate([a for a, _ in each]), np.concatenate([b for _, b in each])
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = b" ".join(words).decode()
        if simple:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(words):
                return ids, np.diff(cut, prepend=0)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        starts = np.concatenate([[0], np.cumsum([len(w.decode()) + 1 for w in words])])[:-1]
        owner = np.searchsorted(starts, np.array([a for a, _ in found.offsets], np.int64), "right") - 1
        return np.array(found.ids, np.uint32), np.bincount(owner, minlength=len(words))

    def _learn(self, keys: np.ndarray, words: list[bytes], simple: np.ndarray) -> None:
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        n = int(simple.sum())
        listed = [words[i] for i in order.tolist()]
        (a, b), (c, d) = self._sizes(listed[:n], True), self._sizes(listed[n:], False)
        ids, size = np.concatenate([a, c]), np.concatenate([b, d])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        slots = np.arange(len(self.begin), len(self.begin) + len(size), dtype=np.int32)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.used += len(ids)
        length = np.array([len(w) for w in listed], np.int64)
        while self.filled + int(length.sum()) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.filled : self.filled + int(length.sum())] = np.frombuffer(b"".join(listed), np.uint8)
        self.text_begin = np.concatenate([self.text_begin, self.filled + np.cumsum(length) - length])
        self.text_size = np.concatenate([self.text_size, length])
        self.filled += int(length.sum())
        keys, back = keys[order], np.argsort(keys[order])
        at = np.searchsorted(self.keys, keys[back])
        self.keys, self.slots = np.insert(self.keys, at, keys[back]), np.insert(self.slots, at, slots[back])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the keys, and which of them the cache has."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slots[at], self.keys[at] == keys

    def _whole(self, texts: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, as the library gives them."""
        each = [np.array(self.tokenizer.encode(texts[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(x) for x in each], np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        n = len(offsets) - 1
        texts = raw.tobytes()
        if not self.by_words or any(a in texts for a in self.added):
            return self._whole(texts, offsets)
        raw = tk.LOWER[raw]
        starts, ends, owner = tk.word_spans(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        latin = _latin(raw)
        final = ends - 1
        stop = np.flatnonzero(((raw[final] == 0x2E) | (raw[final] == 0x2C)) & (ends - starts > 1) & latin[final - 1])
        begins = ends[stop] - 1
        ends[stop] = begins
        starts, ends, owner = np.insert(starts, stop + 1, begins), np.insert(ends, stop + 1, begins + 1), np.insert(owner, stop + 1, owner[stop])
        back, first = tk.span_numbers(raw, starts, ends)
        low, high = starts[first], ends[first]
        keys = tk.span_hashes(raw, low, high)
        if len(self.keys) + len(keys) > self.MOST or self.filled + int((high - low).sum()) > self.BYTES:
            self.clear()
        slots, known = self._find(keys)
        at = np.flatnonzero(known)
        begin = self.text_begin[slots[at]]
        same = tk.same_spans(raw, low[at], high[at], self.text, begin, begin + self.text_size[slots[at]])
        clash = at[~same]
        new = np.flatnonzero(~known)
        # Of new words with one hash only the first can enter the cache.
        _, lead = np.unique(keys[new], return_index=True)
        clash, new = np.concatenate([clash, np.delete(new, lead)]), new[np.sort(lead)]
        if len(clash):
            return self._whole(texts, offsets)
        if len(new):
            letters = np.concatenate([[0], np.cumsum(latin)])
            simple, data = letters[high[new]] - letters[low[new]] == high[new] - low[new], raw.tobytes()
            self._learn(keys[new], [data[a:b] for a, b in zip(low[new].tolist(), high[new].tolist(), strict=True)], simple)
            slots, _ = self._find(keys)
        slot = slots[back]
        size, begin = self.size[slot], self.begin[slot]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edge = np.searchsorted(owner, np.arange(n + 1))
        return ids, np.diff(total[edge])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end``."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1


SHARD_SCHEMA = "part int, seq int, first long, n_ids long, n_docs long, image binary"


def _writer(path: str, end: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, first
            docs = [d for x in held for d in x[0]]
            lengths, ids = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            held.clear()
            row = {"part": part, "seq": seq, "first": first, "n_ids": len(ids), "n_docs": len(docs), "image": pack_shard(docs, lengths, ids)}
            seq, first = seq + 1, first + len(ids)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in tk.pieces(offsets, PIECE):
                ids, sizes = encoder(path).encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, sizes = with_end(ids, sizes, end)
                held.append((doc_ids[a:b], sizes, ids))
                if sum(len(x[2]) for x in held) >= shard_ids:
                    yield close()
        if held:
            yield close()

    return write


def write_shards(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Tokenize, encode and write the shards in ascending doc_id order; returns the table's path."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = text.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    path = fresh_path(docs.sparkSession, "tokens")
    ordered.mapInArrow(tk.freeing(_writer(tokenizer, end_id, shard_ids)), SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


READ_SCHEMA = "part int, doc_id long, within long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = Shard(image.as_buffer())
            data = memoryview(shard.ids().astype("<u4")).cast("B")
            size = shard.lengths.astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            edge = (4 * total).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            n = shard.n_docs
            columns = [pa.array([part] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(first + total[:-1]), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in READ_SCHEMA.split(", ")])


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    A shard's row says how many ids its part (the task that wrote it) has before it, so that only the
    parts' totals are summed up on the driver: a number for each task.
    """
    stored = spark.read.parquet(path)
    sizes = sorted(map(tuple, stored.groupBy("part").agg(F.sum("n_ids")).collect()))
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    rows = spark.createDataFrame([(p, n) for (p, _), n in zip(sizes, before, strict=False)], "part int, before long")
    found = stored.select("part", "first", "image").mapInArrow(tk.freeing(_read), READ_SCHEMA)
    return found.join(F.broadcast(rows), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
