"""Vectorised word, line and shingle arithmetic on Arrow string columns.

Everything works on the UTF-8 bytes of whole batches. Words and lines have 64-bit hashes, which do not
depend on the position, the batch or the Python process; numbers of :func:`span_numbers` are equal for
equal bytes only.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Texts are worked on in pieces of about this many bytes, which bounds the temporary arrays.
PIECE = 1 << 20
#: Bytes whose hashes are summed at once; a text that is longer goes through in sections.
SECTION = 1 << 21


def freeing(work: Callable) -> Callable:
    """A function of batches that, when done, gives memory that is free in its process back to the system.

    Workers are used again; what one stage has freed would else count beside the next one's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers with good avalanche."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def multiple(k: int, of: int = 0x9E3779B97F4A7C15) -> np.uint64:
    """k times a constant, modulo 2**64."""
    return U64(k * of & 0xFFFFFFFFFFFFFFFF)


BYTE_VALUE = mix64((np.arange(256, dtype=U64) + U64(1)) * _GOLD)


#: Spans of at most this many bytes are hashed in one go, longer ones piece by piece.
LONG = 1 << 12


def _weights(n: int) -> np.ndarray:
    """Odd pseudorandom multipliers, one for each place in a span."""
    return mix64(np.arange(n, dtype=U64) * _GOLD + U64(0x2545F4914F6CDD1D)) | U64(1)


WEIGHT = _weights(LONG)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def places(starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of spans, one span after the other, and each place's distance from its span's start."""
    total = np.cumsum(length)
    within = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - length, length)
    return np.repeat(starts, length) + within, within


def _short_hashes(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans of at most LONG bytes: sums of byte values, each times the weight of its place."""
    out, at, end = np.zeros(len(starts), U64), 0, np.cumsum(length)
    while at < len(starts):
        before = int(end[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(end, before + SECTION, "right")))
        place, within = places(starts[at:stop], length[at:stop])
        total = np.zeros(len(place) + 1, U64)
        np.cumsum(BYTE_VALUE[raw[place]] * WEIGHT[within], out=total[1:])
        edge = end[at:stop] - before
        out[at:stop] = mix64(total[edge] - total[edge - length[at:stop]] + length[at:stop].astype(U64) * _GOLD)
        at = stop
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand.

    Multilinear: a byte's value is multiplied by a random weight of its place, so that no pattern of
    repeats or swaps makes two spans alike. Two given spans agree with a probability of about 2**-48 or
    less; where equality decides a result, :func:`same_spans` compares the bytes.
    """
    length = ends - starts
    if not len(starts) or int(length.max()) <= LONG:
        return _short_hashes(raw, starts, length)
    out, short = np.zeros(len(starts), U64), length <= LONG
    out[short] = _short_hashes(raw, starts[short], length[short])
    for i in np.flatnonzero(~short).tolist():
        cut = np.arange(int(starts[i]), int(ends[i]), LONG)
        value = int(length[i])
        for part in _short_hashes(raw, cut, np.minimum(cut + LONG, ends[i]) - cut).tolist():
            value = _mixed(value * 0xD1342543DE82EF95 + part & 0xFFFFFFFFFFFFFFFF)
        out[i] = value
    return out


def _mixed(x: int) -> int:
    """:func:`mix64` of one integer."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which spans of ``raw`` hold the same bytes as the spans of ``other`` beside them."""
    length = ends - starts
    same = length == other_ends - other_starts
    at = np.flatnonzero(same & (length > 0))
    end = np.cumsum(length[at])
    i = 0
    while i < len(at):
        stop = max(i + 1, int(np.searchsorted(end, (int(end[i - 1]) if i else 0) + SECTION, "right")))
        some = at[i:stop]
        size = length[some]
        place, within = places(starts[some], size)
        equal = raw[place] == other[np.repeat(other_starts[some], size) + within]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        i = stop
    return same


def span_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans, equal for spans of equal bytes only, and the first span of each number."""
    _, first, number = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    head = first[number]
    same = same_spans(raw, starts, ends, raw, starts[head], ends[head])
    if not same.all():
        known: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(~same).tolist():
            key = int(number[i]), raw[starts[i] : ends[i]].tobytes()
            if key not in known:
                known[key] = len(first) + len(known)
                first = np.append(first, i)
            number[i] = known[key]
    return number, first


def run_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all maximal runs of bytes that are ``inside``, in order."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words, in order."""
    return run_spans(~WHITE[raw], offsets)


def _crc_table() -> np.ndarray:
    """What a byte does to the CRC-32 register, by the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC_TABLE, CRC_START = _crc_table(), np.uint32(0xFFFFFFFF)
#: Bytes through which all registers go together; what a longer span has beyond is read by itself.
TOGETHER = 64


def crc_bytes(crc: np.ndarray, value: np.ndarray | np.uint8) -> np.ndarray:
    """CRC-32 registers after one more byte each."""
    return CRC_TABLE[(crc ^ value) & np.uint32(255)] ^ (crc >> np.uint32(8))


def crc_spans(raw: np.ndarray, starts: np.ndarray, length: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of spans, all advanced a byte at a time.

    ``crc`` are the registers before. The CRC-32 of a span is its register, begun with CRC_START, all bits turned.
    """
    order = np.argsort(TOGETHER + 1 - np.minimum(length, TOGETHER + 1).astype(np.uint8), kind="stable")
    at, size, crc = starts[order], length[order], crc[order]
    alive = len(size) - np.cumsum(np.bincount(np.minimum(size, TOGETHER + 1), minlength=TOGETHER + 2))
    for j in range(min(TOGETHER, int(size[0]) if len(size) else 0)):
        k = int(alive[j])
        crc[:k] = crc_bytes(crc[:k], raw[at[:k] + j])
    for i in range(int(alive[TOGETHER])):
        rest = raw[at[i] + TOGETHER : at[i] + size[i]]
        crc[i] = zlib.crc32(rest, int(crc[i] ^ CRC_START)) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def counts_of(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of the distinct k-word shingles of each text, sorted by owner, then hash.

    A text with fewer than k words has its whole word sequence as its only shingle; one without
    words has none.
    """
    n = len(words)
    rolled = np.zeros(n, U64)
    for j in range(k):
        if n > j:
            rolled[: n - j] = mix64(rolled[: n - j] * U64(_BASE) + words[j:])
    keep = np.zeros(n, bool)
    if n >= k:
        keep[: n - k + 1] = owner[: n - k + 1] == owner[k - 1 :]
    hashes, owners = mix64(rolled[keep]), owner[keep]
    sizes = counts_of(owner, n_texts)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(sizes)])[short]
        value = sizes[short].astype(U64) * _GOLD
        for j in range(k - 1):
            has = sizes[short] > j
            value[has] = mix64(value[has] * U64(_BASE) + words[begin[has] + j])
        hashes, owners = np.concatenate([hashes, value]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[new], owners[new]
    return hashes, owners
