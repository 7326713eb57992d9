"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Two words differ by one replaced, inserted or deleted code point just when, at some place, what stands
before it and what stands after it agree. Words that begin with a given prefix are an interval of the
words in forward order, words that end with a given suffix are one of the words in reverse order (ordered
from their ends), so each place of a word asks for the points of a rectangle: words whose forward rank is in one
interval and whose reverse rank is in the other. A wavelet tree over the reverse ranks, put in forward order,
reports them. Orders hold words of one length only, so that what a rectangle holds besides the
word itself is near it, and each pair is asked for at one place: the first at which its words differ.

The vocabulary is dealt into groups (m, lo, hi, key): of the pairs whose shorter word has m code points,
those that first differ at a place from lo up to, but not including, hi; both words then share their first lo and
their last m - hi code points, which are the key. Every word starts in two halves for each of its two m. A
group of more than GROUP words is halved again, at the latest until its places are one, when
the alphabet bounds it. A task takes the groups that are dealt to it, builds one tree for each
(m, lo, hi), and returns one row for each word with a near word there: their number and the best of them.
Forms are followed to the last by pointer jumping, a join for each doubling of the steps.

Defined results: null and empty texts have no words; a null doc_id counts as the empty string in the
hash; repeated rows count their words again; a word without a near word has n_near 0, no form, and is
its own root; an empty table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, bounded_broadcast, materialise

#: Shortest word, fewest occurrences, how many times as frequent a form is, and one in how many runs loses a code point.
LEAST, OCCURRENCES, TIMES, NOISE = 6, 5, 5, 199
#: Words of a group that is not halved any more; rows of all groups that a task takes, about; groups whose names are broadcast.
GROUP, TASK, BROADCAST_GROUPS = 20_000, 200_000, 100_000

#: Latin-1 letters are two bytes in UTF-8, the first of which is this one for U+00C0 to U+00FF.
_LEAD = 0xC3
_ASCII = np.zeros(256, bool)
_ASCII[ord("A") : ord("Z") + 1] = _ASCII[ord("a") : ord("z") + 1] = True


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and lengths in code points of the runs of Latin letters."""
    lead = raw == _LEAD
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    starts, ends, owner = tk.run_spans(inside, offsets)
    leads = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, owner, ends - starts - (leads[ends] - leads[starts])


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    length = ends - starts
    place, _ = tk.places(starts, length)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[place]))


def words_of(raw: np.ndarray, offsets: np.ndarray, ids: list[str]) -> pa.Array:
    """The words of the texts, one for each occurrence: runs, lower-cased, one in NOISE of them less a code point."""
    raw = tk.LOWER[raw]
    starts, ends, owner, size = runs(raw, offsets)
    some = size >= LEAST  # a deletion makes no run longer
    starts, ends, owner, size = starts[some], ends[some], owner[some], size[some]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32) ^ tk.CRC_START
    crc = tk.crc_spans(raw, starts, ends - starts, begun[owner]) ^ tk.CRC_START
    cut = crc % np.uint32(NOISE) == 0
    less = []
    for i in np.flatnonzero(cut & (size > LEAST)).tolist():
        run, at = raw[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(size[i])
        less.append(run[:at] + run[at + 1 :])
    return pa.concat_arrays([_strings(raw, starts[~cut], ends[~cut]), pa.array(less, pa.string())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        raw, offsets = tk.string_buffers(batch.column(1))
        found = [words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b]) for a, b in tk.pieces(offsets)]
        counted = pc.value_counts(pa.chunked_array(found, pa.string()))
        yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``least`` (at least LEAST) code points that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = rows.mapInArrow(tk.freeing(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= occurrences) & (F.char_length("word") >= max(least, LEAST)))


class WaveletTree:
    """Reports the values in a range of places of a permutation that lie in a range of values.

    Level by level from the highest bit, the values are parted stably by that bit; ``zeros`` counts those
    with a 0 before each place. Many queries go down the levels side by side.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the query and value of each point with first <= place < last and low <= value < high."""
        query, value = np.arange(len(first)), np.zeros(len(first), np.int64)
        for zeros, bit in zip(self.zeros, reversed(range(self.bits)), strict=True):
            a, b = zeros[first], zeros[last]
            query = np.concatenate([query, query])
            first, last = np.concatenate([a, zeros[-1] + first - a]), np.concatenate([b, zeros[-1] + last - b])
            value = np.concatenate([value, value + (1 << bit)])
            keep = (first < last) & (value < high[query]) & (value + (1 << bit) > low[query])
            query, first, last, value = query[keep], first[keep], last[keep], value[keep]
        return query, value


class Lexicon:
    """Words of one length in forward order, with their reverse order and the tree between the two.

    letters: a row of Latin-1 bytes for each word. Byte order is code point order.
    """

    def __init__(self, letters: np.ndarray, n: np.ndarray) -> None:
        self.size, self.length = letters.shape
        order = np.argsort(_keys(letters), kind="stable")
        self.letters, self.n, self.order = np.ascontiguousarray(letters[order]), n[order], order
        self.back = np.ascontiguousarray(self.letters[:, ::-1])
        self.of_back = np.argsort(_keys(self.back), kind="stable")  # the word at each reverse rank
        self.back = np.ascontiguousarray(self.back[self.of_back])
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.of_back] = np.arange(self.size)
        self.tree = WaveletTree(self.rank)
        self.shared, self.back_shared = _common(self.letters), _common(self.back)

    def interval(self, other: np.ndarray, k: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """The words that begin (or end, where the letters are turned round) with the first k letters of other words."""
        if k == 0:
            return np.zeros(len(other), np.int64), np.full(len(other), self.size)
        own, asked = _keys((self.back if back else self.letters)[:, :k]), _keys(other[:, :k])
        return np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right")


def _keys(letters: np.ndarray) -> np.ndarray:
    letters = np.ascontiguousarray(letters)
    return letters.view(f"S{letters.shape[1]}").ravel()


def _common(rows: np.ndarray) -> np.ndarray:
    """How many letters each row shares with the one before it, from the first on; -1 for the first row."""
    out = np.full(len(rows), -1, np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _blocks(shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order, the interval of the words that share k letters with the one there."""
    edge = np.flatnonzero(shared < k) if k else np.zeros(1, np.int64)
    size = np.diff(np.append(edge, len(shared)))
    return np.repeat(edge, size), np.repeat(edge + size, size)


def replaced(words: Lexicon, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that differ in one letter, at a place from lo up to hi; each pair in both directions."""
    found = []
    for at in range(lo, min(hi, words.length)):
        first, last = _blocks(words.shared, at)
        if (last - first == 1).all():
            break  # longer prefixes are shared by fewer still
        low, high = _blocks(words.back_shared, words.length - 1 - at)
        low, high = low[words.rank], high[words.rank]
        ask = np.flatnonzero((last - first > 1) & (high - low > 1))
        query, value = words.tree.report(first[ask], last[ask], low[ask], high[ask])
        one, other = ask[query], words.of_back[value]
        found.append(np.stack([one, other])[:, one != other])
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def deleted(longer: Lexicon, shorter: Lexicon, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a word of ``longer`` and the word of ``shorter`` that it is without its letter at a place from lo up to hi.

    Of equal letters in a row, the last is taken out: it is there that the two words first differ.
    """
    found = []
    for at in range(lo, min(hi, longer.length)):
        first, last = shorter.interval(longer.letters, at, back=False)
        if (first == last).all():
            break
        ask = first < last
        if at + 1 < longer.length:
            ask &= longer.letters[:, at] != longer.letters[:, at + 1]
        ask = np.flatnonzero(ask)
        low, high = shorter.interval(np.ascontiguousarray(longer.letters[ask][:, ::-1]), longer.length - 1 - at, back=True)
        query, value = shorter.tree.report(first[ask], last[ask], low, high)
        found.append(np.stack([ask[query], shorter.of_back[value]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _best(one: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word that has near words, their number, and the near word of largest n, the first in code point order."""
    order = np.lexsort((other, -n[other], one))
    word, first, count = np.unique(one[order], return_index=True, return_counts=True)
    return word, count, other[order][first]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words within each group of a task: (word, n_near, best, best_n)."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    held = pa.Table.from_batches(some)
    words = np.array([w.encode("latin-1") for w in held.column("word").to_pylist()], object)
    n, m, lo, hi = (held.column(c).to_numpy() for c in ("n", "m", "lo", "hi"))
    size = np.array([len(w) for w in words], np.int64)
    order = np.lexsort((size, hi, lo, m))
    kind = np.stack([m, lo, hi], axis=1)[order]
    edge = np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1
    for part in np.split(order, edge):
        at = part[0]
        lexicon = lambda rows: Lexicon(np.frombuffer(b"".join(words[rows]), np.uint8).reshape(len(rows), -1), n[rows])
        short, long = part[size[part] == m[at]], part[size[part] > m[at]]
        if not len(short):
            continue
        shorter = lexicon(short)
        results = [(shorter, shorter, *replaced(shorter, lo[at], hi[at]))]
        if len(long):
            longer = lexicon(long)
            one, other = deleted(longer, shorter, lo[at], hi[at])
            results += [(longer, shorter, one, other), (shorter, longer, other, one)]
        for mine, theirs, one, other in results:
            word, count, best = _best(one, other, theirs.n)
            if len(word):
                text = lambda lexicon, rows: [lexicon.letters[i].tobytes().decode("latin-1") for i in rows.tolist()]
                columns = [pa.array(text(mine, word)), pa.array(count), pa.array(text(theirs, best)), pa.array(theirs.n[best])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best", "best_n"])


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("word", "n", "m", F.explode(both).alias("places")).select("word", "n", "m", "places.lo", "places.hi")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key: the first lo and the last m - hi code points."""
    after = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return rows.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.char_length("word") - after + 1, after)))


def dealt(words: DataFrame, least: int, group: int) -> DataFrame:
    """The words' rows in groups of at most ``group`` words, or of one place."""
    length = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least)
    rows, settled = start.select("*", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi")), []
    names = ["m", "lo", "hi", "key"]
    while True:
        rows = _keyed(_halves(rows))
        large = materialise(rows.groupBy(*names).count().where((F.col("count") > group) & (F.col("hi") - F.col("lo") > 1)).select(*names), "large-groups")
        if large.isEmpty():
            settled.append(rows)
            break
        large = bounded_broadcast(large, BROADCAST_GROUPS)
        settled.append(rows.join(large, names, "left_anti"))
        rows = rows.join(large, names, "left_semi")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, *, least: int = LEAST, group: int = GROUP, task: int = TASK) -> DataFrame:
    """n_near, best and best_n of each of the distinct ``words`` (word, n) that has near words."""
    tasks = words.count() * 4 // task + 1
    found = dealt(words, least, group).repartition(tasks, "m", "lo", "hi", "key").mapInArrow(tk.freeing(_near), "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """The last of the forms of each ``word`` with a ``form``: each round doubles the steps that are taken."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = materialise(state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(docs: DataFrame, *, least: int = LEAST, occurrences: int = OCCURRENCES, times: int = TIMES, group: int = GROUP, task: int = TASK) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary of ``docs``."""
    with Scratch(docs.sparkSession) as scratch:
        words = materialise(vocabulary(docs, least, occurrences), "vocabulary")
        near = near_words(words, least=max(least, LEAST), group=group, task=task)
        is_form = F.col("best_n") >= times * F.col("n")
        known = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
        last = materialise(roots(known.where(F.col("form").isNotNull())), "last-forms")
        scratch.keep(known, last)
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
