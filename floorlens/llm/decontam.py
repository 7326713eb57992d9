"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case characters with white space runs as one space. Every benchmark item
has overlapping segments of SEGMENT characters (a shorter item is one segment), STRIDE apart: a verbatim
quote of at least SEGMENT characters is at most half a stride, and so fewer than EDITS characters, off a
segment: it is found wherever it starts in the item. A text region that lies within e edits of a segment
of n characters shares with it at least ``n + 1 - (e + 1) * Q`` of its q-grams, all on e + 1
neighbouring diagonals. e is EDITS, in proportion less for shorter segments, and never so many that the
bound is not positive: from 24 characters on 1 edit, below 18 none.

All q-grams of a text are looked up in an index of the items' q-grams, one entry for each character.
Matches are counted by item in diagonal bands that overlap by half, so that any such run of diagonals
lies in one band; bands that reach the bound of any of the item's segments are counted again by segment,
and those that reach the segment's own bound are verified by a banded alignment in every text that the
band meets. Very common q-grams are left out of the index as long as each segment's bound, lowered by
the number it loses, stays positive; the filter stays without loss.

Items without an edit (fewer than 18 characters) must stand between word boundaries. Items shorter than
Q are looked up whole.

The index takes about 30 bytes for a character of the benchmark; a benchmark of more than MAX_CHARS
characters is taken in parts of about that many, each compared with all texts.

Defined results: null or empty texts and items match nothing; a null doc_id or item_id is passed on;
every row of documents and every row of items is judged on its own, so repeated rows give repeated
results; empty tables give no rows; other columns than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import freeing, mix64

SEGMENT, STRIDE, EDITS, Q = 80, 10, 7, 9
BAND = 16
MAX_CHARS = 1 << 23
#: Entries beyond which a q-gram is left out where the bounds allow it, and the bound that must be left.
COMMON, BOUND_LEFT = 2, 3
#: Characters of text that are worked on together, matches that are counted at once.
PIECE, MATCHES = 1 << 20, 1 << 22
U64 = np.uint64
_BASE = U64(0xD1342543DE82EF95)

_TABLE = 0x3000
_LOWER = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(_TABLE)], np.uint32)
_SPACE = np.array([chr(c).isspace() for c in range(_TABLE)], bool)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text as compared, and where each stands in the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(code < _TABLE, _LOWER[np.minimum(code, _TABLE - 1)], code)
    white = (code < _TABLE) & _SPACE[np.minimum(code, _TABLE - 1)]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    if len(keep):
        keep[0] = ~white[0]
    place = np.flatnonzero(keep)
    return np.where(white, np.uint32(32), low)[place], place


def qgrams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all runs of q characters, by place."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    wide = code.astype(U64)
    out = wide[:n].copy()
    for j in range(1, q):
        out *= _BASE
        out += wide[j : j + n]
    return mix64(out)


def letter(code: np.ndarray) -> np.ndarray:
    """Which characters are letters or digits, and so part of a word."""
    found = np.unique(code)
    return np.isin(code, found[[chr(c).isalnum() for c in found.tolist()]])


class Index:
    """Benchmark items, their segments and their q-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], segment: int = SEGMENT, edits: int = EDITS) -> None:
        self.items = [i for i, _ in items]
        codes = []
        for _, text in items:
            code, _ = normalised(text or "")
            codes.append(code[:-1] if len(code) and code[-1] == 32 else code)
        size = np.array([len(c) for c in codes], np.int64)
        #: All items' characters, one item after the other, and where each begins.
        self.code = np.concatenate([*codes, np.zeros(0, np.uint32)])
        self.begin = np.cumsum(size) - size
        #: Whole items shorter than Q by their length: hashes, in order, and items.
        self.tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, Q):
            mine = np.flatnonzero(size == n)
            if len(mine):
                hashes = qgrams(self.code, n)[self.begin[mine]]
                order = np.argsort(hashes, kind="stable")
                self.tiny[n] = hashes[order], mine[order]

        # Segments: owner, place in ``code``, length.
        owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(size >= Q).tolist():
            last = max(0, int(size[k]) - segment)
            starts = np.arange(0, last + 1, STRIDE)
            starts = np.append(starts, last) if starts[-1] < last else starts
            owner.append(np.full(len(starts), k))
            place.append(self.begin[k] + starts)
        self.owner, self.place = np.concatenate(owner), np.concatenate(place)
        self.length = np.minimum(size[self.owner], segment)
        self.edits = np.minimum(np.minimum(edits, self.length * edits // segment), self.length // Q - 1)
        bound = self.length + 1 - (self.edits + 1) * Q

        # Entries: the q-grams within items, and which segments (a range) hold each.
        grams = qgrams(self.code)
        at = np.arange(len(grams))
        item = np.searchsorted(self.begin, at, "right") - 1
        whole = at + Q <= self.begin[item] + size[item]
        at, item = at[whole], item[whole]
        flat = grams[at]
        low = np.maximum(self.begin[item], at - (segment - Q))
        first, last = np.searchsorted(self.place, low, "left"), np.searchsorted(self.place, at, "right")
        values, back, n = np.unique(flat, return_inverse=True, return_counts=True)
        drop, left = np.zeros(len(values), bool), bound.copy()
        order, edge = np.argsort(back, kind="stable"), np.concatenate([[0], np.cumsum(n)])
        for v in np.argsort(-n, kind="stable").tolist():
            if n[v] <= COMMON:
                break
            entries = order[edge[v] : edge[v + 1]]
            held = last[entries] - first[entries]
            mine, times = np.unique(np.repeat(first[entries] - (np.cumsum(held) - held), held) + np.arange(held.sum()), return_counts=True)
            if (left[mine] - times >= BOUND_LEFT).all():
                left[mine] -= times
                drop[v] = True
        #: The bound of each segment, and the least one of each item.
        self.bound, self.least = left, np.full(len(items), 1 << 30)
        np.minimum.at(self.least, self.owner, left)
        keep = ~drop[back]
        order = np.flatnonzero(keep)[np.argsort(flat[keep], kind="stable")]
        self.at, self.item = at[order].astype(np.int32), item[order].astype(np.int32)
        self.seg, self.held = first[order].astype(np.int32), (last - first)[order].astype(np.int8)
        self.values, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = 24
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.values >> U64(64 - self.bits)] = True

    def matches(self, code: np.ndarray, stops: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(segment, band) of all bands of the texts, put together in ``code``, that reach the bound.

        stops: ends of the texts in ``code``; q-grams across them do not count. Band b holds the diagonals
        (place in ``code`` less place among the items' characters) from (b - 1) * BAND - len(self.code)
        on, twice BAND wide. None: there are more than ``most`` matches.
        """
        grams = qgrams(code)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(grams) or not len(self.values):
            return none
        at = np.flatnonzero(self.filter[grams >> U64(64 - self.bits)])
        found = np.minimum(np.searchsorted(self.values, grams[at]), len(self.values) - 1)
        ok = self.values[found] == grams[at]
        at, found = at[ok], found[ok]
        ok = at + Q <= stops[np.searchsorted(stops, at, "right")]
        at, found = at[ok], found[ok]
        n = self.count[found]
        total = np.cumsum(n)
        if not len(at):
            return none
        if most is not None and total[-1] > most:
            return None
        entry = np.repeat(self.first[found] - (total - n), n) + np.arange(total[-1])
        band = (np.repeat(at, n) - self.at[entry] + len(self.code)) // BAND
        wide = (len(code) + len(self.code)) // BAND + 3
        key = self.item[entry] * wide + band
        keys, n = np.unique(np.concatenate([key, key + 1]), return_counts=True)
        keys = keys[n >= self.least[keys // wide]]
        if not len(keys):
            return none
        both = []
        for k in (0, 1):
            mine = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key + k), len(keys) - 1)] == key + k)
            held = self.held[entry[mine]].astype(np.int64)
            first = np.repeat(self.seg[entry[mine]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            both.append(first * wide + np.repeat(band[mine] + k, held))
        keys, n = np.unique(np.concatenate(both), return_counts=True)
        seg, band = keys // wide, keys % wide
        ok = n >= self.bound[seg]
        return seg[ok], band[ok]

    def verify(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray, seg: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, segment, start, end, edits) of the candidates whose alignment keeps the edit budget.

        A candidate is aligned in every text that its band meets.
        """
        out = []
        most = int(self.edits.max()) if len(self.edits) else 0
        # Neighbouring bands of a segment share a window: every second one of a run, a band wider.
        head = np.ones(len(seg), bool)
        head[1:] = (seg[1:] != seg[:-1]) | (band[1:] != band[:-1] + 1)
        place = np.arange(len(seg))
        even = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
        seg, band = seg[even], band[even]
        width = SEGMENT + 3 * BAND + 2 * most
        low = (band - 1) * BAND - len(self.code) + self.place[seg] - most
        high = np.minimum(low + self.length[seg] + 3 * BAND + 2 * most, len(code))
        first = np.searchsorted(stops, np.maximum(low, 0), "right")
        n = np.searchsorted(starts, high, "left") - first
        text = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seg, low, high = np.repeat(seg, n), np.repeat(low, n), np.repeat(high, n)
        room = np.minimum(high, stops[text]) - np.maximum(low, starts[text])
        enough = room >= self.length[seg] - self.edits[seg]
        seg, low, text = seg[enough], low[enough], text[enough]
        for a in range(0, len(seg), 4096):
            s, t = seg[a : a + 4096], text[a : a + 4096]
            place = low[a : a + 4096, None] + np.arange(width)
            inside = (place >= starts[t][:, None]) & (place < stops[t][:, None])
            window = np.where(inside, code[np.clip(place, 0, len(code) - 1)], np.uint32(0xFFFFFFFF))
            column = np.arange(SEGMENT)
            pattern = self.code[np.minimum(self.place[s][:, None] + column, len(self.code) - 1)]
            pattern = np.where(column < self.length[s][:, None], pattern, np.uint32(0xFFFFFFFE))
            begin, end, edits = verbatim(pattern, window), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            end[:] = begin + SEGMENT
            rest = np.flatnonzero(begin < 0)
            edits[rest] = least_edits(pattern[rest], self.length[s[rest]], window[rest])
            rest = rest[edits[rest] <= self.edits[s[rest]]]
            edits[rest], begin[rest], end[rest] = align(pattern[rest], self.length[s[rest]], window[rest])
            for i in np.flatnonzero(edits <= self.edits[s]).tolist():
                out.append((int(t[i]), int(s[i]), int(place[i, 0] + begin[i]), int(place[i, 0] + end[i]), int(edits[i])))
        return out

    def whole(self, code: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, 0) of the items shorter than Q that stand in the texts as words."""
        out = []
        for n, (hashes, items) in self.tiny.items():
            grams = qgrams(code, n)
            low = np.searchsorted(hashes, grams, "left")
            at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams)
            text = np.searchsorted(stops, at, "right")
            ok = at + n <= stops[text]
            for a, t in zip(at[ok].tolist(), text[ok].tolist(), strict=True):
                for k in range(int(low[a]), int(np.searchsorted(hashes, grams[a], "right"))):
                    item = int(items[k])
                    if (self.code[self.begin[item] : self.begin[item] + n] == code[a : a + n]).all():
                        out.append((t, item, a, a + n, 0))
        return out


def verbatim(pattern: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Where each whole row of patterns first stands in its window, or -1."""
    n, width = pattern.shape
    found = np.full(n, -1, np.int64)
    for k in range(window.shape[1] - width + 1):
        at = np.flatnonzero((found < 0) & (window[:, k] == pattern[:, 0]) & (window[:, k + width - 1] == pattern[:, -1]))
        found[at[(window[at, k : k + width] == pattern[at]).all(axis=1)]] = k
    return found


def least_edits(pattern: np.ndarray, length: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Least edits of each pattern against any part of its window, as :func:`align` but without the part."""
    n, width = window.shape
    text, column = np.ascontiguousarray(window.T), np.arange(width + 1, dtype=np.int16)[:, None]
    cost, final = np.zeros((width + 1, n), np.int16), np.full(n, 1 << 14, np.int16)
    for i in range(int(length.max()) if n else 0):
        best = cost + np.int16(1)
        np.minimum(best[1:], cost[:-1] + (text != pattern[:, i]), out=best[1:])
        # Characters of the text that are left out: carry the least cost to the right.
        best -= column
        np.minimum.accumulate(best, axis=0, out=best)
        best += column
        cost = best
        ended = np.flatnonzero(length == i + 1)
        if len(ended):
            final[ended] = cost[:, ended].min(axis=0)
    return final


def align(pattern: np.ndarray, length: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern against any part of its window (rows alike), and that part.

    All rows at once; a step is a character of the patterns. The begin of the part is carried along.
    """
    n, width = window.shape
    column = np.arange(width + 1, dtype=np.int32)
    cost = np.zeros((n, width + 1), np.int32)
    begin = np.broadcast_to(column, cost.shape).copy()
    final, first, last = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(pattern.shape[1]):
        change = (window != pattern[:, i : i + 1]).astype(np.int32)
        best, source = cost + 1, begin.copy()
        diagonal = cost[:, :-1] + change
        better = diagonal <= best[:, 1:]
        best[:, 1:] = np.where(better, diagonal, best[:, 1:])
        source[:, 1:] = np.where(better, begin[:, :-1], source[:, 1:])
        # Characters of the text that are left out: carry the least cost to the right.
        slope = (best - column) * (width + 2) + column
        where = np.minimum.accumulate(slope, axis=1) % (width + 2)
        cost = np.take_along_axis(best, where, 1) + column - where
        begin = np.take_along_axis(source, where, 1)
        ended = np.flatnonzero(length == i + 1)
        if len(ended):
            at = cost[ended].argmin(axis=1)
            final[ended], first[ended], last[ended] = cost[ended, at], begin[ended, at], at
    return final, first, last


#: Characters that neighbouring windows of a long text share: more than a segment's region and its band.
OVERLAP = 2 * SEGMENT + 4 * BAND


def scanner(index: Index):
    """A function of texts that lists the regions found in them: (number of the text, item, start, end, edits)."""

    def look(code: np.ndarray, starts: np.ndarray, stops: np.ndarray, low: int, high: int, found: set) -> None:
        """Adds the regions within a window of the texts; one with very many matches is halved."""
        first, last = int(np.searchsorted(stops, low, "right")), int(np.searchsorted(starts, high, "left"))
        a, b = np.maximum(starts[first:last], low) - low, np.minimum(stops[first:last], high) - low
        most = MATCHES if high - low > 4 * OVERLAP else None
        got = index.matches(code[low:high], b, most)
        if got is None:
            middle = (low + high) // 2
            look(code, starts, stops, low, middle + OVERLAP // 2, found)
            look(code, starts, stops, middle - OVERLAP // 2, high, found)
            return
        for t, seg, x, y, edits in index.verify(code[low:high], a, b, *got):
            found.add((first + t, int(index.owner[seg]), seg, x + low, y + low, edits))

    def scan(texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        out: list[tuple[int, int, int, int, int]] = []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def work() -> None:
            code = np.concatenate([c for _, c, _ in held])
            stops = np.cumsum([len(c) for _, c, _ in held])
            starts = stops - np.array([len(c) for _, c, _ in held])
            found: set[tuple[int, int, int, int, int, int]] = set()
            low = 0
            while True:
                look(code, starts, stops, low, min(low + PIECE + OVERLAP, len(code)), found)
                low += PIECE
                if low + OVERLAP >= len(code):
                    break
            # Of a segment's overlapping regions the one of the least edits stays, wherever windows were cut.
            rows, taken = [], {}
            for t, item, seg, a, b, edits in sorted(found, key=lambda r: (r[5], *r)):
                if all(b <= x or a >= y for x, y in taken.setdefault((t, seg), [])):
                    taken[t, seg].append((a, b))
                    rows.append((t, item, a, b, edits, int(index.edits[seg])))
            rows += [(*r, 0) for r in index.whole(code, stops)]
            word = letter(code) if any(r[-1] == 0 for r in rows) else None
            for t, item, a, b, edits, budget in sorted(rows):
                number, own, place = held[t]
                a, b = max(a, int(starts[t])), min(b, int(stops[t]))
                if b <= a:
                    continue
                if budget == 0:
                    # As a word or words: no letter goes on across either end.
                    if (a > starts[t] and word[a] and word[a - 1]) or (b < stops[t] and word[b - 1] and word[b]):
                        continue
                a, b = a - int(starts[t]), b - int(starts[t])
                out.append((number, item, int(place[a]), int(place[b - 1]) + 1, edits))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            code, place = normalised(text)
            if not len(code):
                continue
            held.append((i, code, place))
            size += len(code)
            if size >= PIECE:
                work()
                size = 0
        if held:
            work()
        return out

    return scan


def _parts(benchmark: DataFrame, max_chars: int) -> Iterator:
    """Broadcast indexes of the benchmark, each of about max_chars characters, of which the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // max_chars)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part.collect()]))


_FOUND = "doc_id long, item_id long, n_regions long, start long, end long, edits int"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
#: Rows that are handed to the scanner together.
ROWS = 256


def contaminations(docs: DataFrame, benchmark: DataFrame, *, max_chars: int = MAX_CHARS) -> DataFrame:
    """A row for each row of documents and of the benchmark that is found in it: doc_id, item_id, regions (of
    one segment each; they may overlap), first start, last end (code points of the text), least edits."""
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = None
    for sent in _parts(benchmark, max_chars):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan, own = scanner(sent.value), sent.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for a in range(0, len(ids), ROWS):
                    by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                    for i, item, *region in scan(texts[a : a + ROWS].to_pylist()):
                        by.setdefault((i, item), []).append(tuple(region))
                    rows = [(ids[a + i], own.items[item], len(r), min(x[0] for x in r), max(x[1] for x in r), min(x[2] for x in r)) for (i, item), r in by.items()]
                    columns = zip(*rows, strict=True) if rows else [()] * len(_TYPES)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])

        found = held.mapInArrow(freeing(run), _FOUND)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) in which nothing of the benchmark is found.

    Rows are judged one by one by their texts, so a null doc_id is judged like any other.
    """
    out = docs
    for sent in _parts(benchmark, max_chars):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = scanner(sent.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                bad = np.zeros(batch.num_rows, bool)
                for a in range(0, batch.num_rows, ROWS):
                    for i, *_ in scan(texts[a : a + ROWS].to_pylist()):
                        bad[a + i] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(freeing(run), docs.schema)
    return out
