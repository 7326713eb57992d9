"""Quality rules: per-document statistics, then robust multivariate outlier rejection.

Each language and source forms a cell, whatever its size. A cell's centre and scatter are minimum-
covariance-determinant (MCD) estimates of its documents' transformed statistics: from several starts,
concentration steps go on until the determinant of the nearest three quarters falls no further; the
least determinant wins and is reweighted. Estimates are shrunk towards those of the language and
these towards those of all documents, each worth PRIOR documents: a small cell leans on its language,
a large one stands for itself.

Before the estimates a cell's documents are summed by level of each statistic, map-side: a group has
at most LEVELS rows (their product, 333,000) however many documents it holds, and its sums of values
and products are exact, since statistics are fixed-point integers. So reruns agree whatever the order
of rows, and no cell is gathered. Steps choose among these sums, by their means.

A document's distance is Mahalanobis', with its own sampling variance added to the scatter: shares of
repeated lines or words and symbols a word are counts over few trials in a short document, and cells
in which most documents have none have no scatter of their own. Beyond the 99.9 % point of chi-square
with 4 degrees of freedom a document is rejected.

Defined results: a null or empty text has no words and fails the base rules (fewer than 50 words);
a null language or source is a value of its own; repeated rows count and are judged as often as they
occur; an empty table gives no rows; columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, bounded_broadcast, materialise, null_key, skewed_left_join

#: Words and share of repeated words beyond which a text fails without being compared.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Units of the fixed-point statistics: 1 is UNIT. It is also the least standard deviation, 1 / UNIT.
UNIT = 256
STATS = ("x_length", "x_symbols", "x_lines", "x_repeats")
#: Levels by which documents are summed: how many of each statistic, and steps in 1 / UNIT.
LEVELS, STEPS = (128, 17, 17, 9), (8, 64, 16, 16)
#: Share of a cell that carries the estimate, random starts, most steps of a start.
SHARE, STARTS, MOST_STEPS = 0.75, 12, 100
#: Documents that the estimate of the next larger group is worth.
PRIOR = 50
#: Squared distances: the 97.5 % point of chi-square with 4 degrees for reweighting, and the 99.9 % point for rejection.
REWEIGHT, REJECT = 11.143, 18.467
#: Words that a repeat takes at least: two windows of three.
CLUMP = 6
#: Squared coefficient of variation of the words' lengths in a text: a standard deviation of about half the mean.
WORD_SPREAD = 0.3
#: Most cells for which their estimates are broadcast.
BROADCAST_CELLS = 20_000

_STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_statistics(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Arrays of words, their code points, symbols, repeated lines, repeated words and lines with a word."""
    n = len(offsets) - 1
    starts, ends, owner = tk.word_spans(raw, offsets)
    white = tk.WHITE[raw]
    lead = (raw & 0xC0) != 0x80
    n_words, chars, symbols = tk.counts_of(owner, n), _by_text(lead & ~white, offsets), _by_text(_SYMBOL[raw], offsets)

    cut = np.flatnonzero(raw == 10)
    line_starts = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], cut + 1)
    line_starts = line_starts[line_starts < len(raw)]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(raw)), offsets[line_owner + 1])
    line_ends = np.where((line_ends > line_starts) & (raw[line_ends - 1] == 10), line_ends - 1, line_ends)
    solid = np.concatenate([[0], np.cumsum(~white, dtype=np.int64)])
    has = solid[line_ends] > solid[line_starts]
    line_starts, line_ends, line_owner = line_starts[has], line_ends[has], line_owner[has]
    lines = tk.counts_of(line_owner, n)
    number, _ = tk.span_numbers(raw, line_starts, line_ends)
    _, first = np.unique(number + line_owner * (len(number) + 1), return_index=True)
    dups = lines - tk.counts_of(line_owner[first], n)

    repeats = np.zeros(n, np.int64)
    m = len(starts)
    if m >= 3:
        word, _ = tk.span_numbers(raw, starts, ends)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        # Windows as numbers of pairs of pairs: exact, as the numbers are.
        pair = np.unique(word[:-1] * m + word[1:], return_inverse=True)[1]
        window = np.unique(pair[:-1] * m + word[2:], return_inverse=True)[1][inside] * n + owner[inside]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        covered = np.zeros(m, bool)
        for k in range(3):
            covered[at + k] = True
        repeats = tk.counts_of(owner[covered], n)
    return [n_words, chars, symbols, dups, repeats, lines]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        raw, offsets = tk.string_buffers(text)
        found = []
        for a, b in tk.pieces(offsets):
            found.append(text_statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        if not found:
            continue
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        names = [f.split()[0] for f in _STAT_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=[*batch.schema.names[:-1], *names])


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` with each document's statistics and ``base_failed``."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    out = kept.mapInArrow(tk.freeing(_measure), f"{schema}, {_STAT_SCHEMA}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _transformed(df: DataFrame) -> DataFrame:
    """Statistics on scales on which clean documents are near elliptical, as whole multiples of 1/UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return df.withColumns({name: F.floor(UNIT * e + 0.5).cast("long") for name, e in zip(STATS, x, strict=True)})


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_M, _S = [f"m{i}" for i in range(4)], [f"s{i}{j}" for i, j in _PAIRS]
_FIT = "level int, lang_key string, source_key string, n long, " + ", ".join(f"{c} double" for c in _M + _S)


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` right for normal data in 4 dimensions."""
    low, high = 0.0, 100.0
    for _ in range(100):
        q = (low + high) / 2
        low, high = (q, high) if 1 - exp(-q / 2) * (1 + q / 2) < share else (low, q)
    return share / (1 - exp(-q / 2) * (1 + q / 2 + q * q / 8))


def _moments(weight: np.ndarray, total: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of documents summed in rows, of each of which a share (weight) counts.

    total: sums of values by row. square: sums of products by row, in the order of _PAIRS.
    """
    n, mean, cov = weight[0], weight[1] @ total / weight[0], np.zeros((4, 4))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = weight[1] @ square[:, k] / n - mean[i] * mean[j]
    return mean, cov


def mcd(count: np.ndarray, total: np.ndarray, square: np.ndarray, share: float = SHARE, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, covariance, determinant) of the nearest ``share`` of the documents: the least that was found.

    Arrays have a row for each group of like documents: their number, sums and sums of products.
    """
    n, point, floor = count.sum(), total / count[:, None], np.eye(4) / UNIT**2
    h = share * n

    def nearest(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """The share of each row that is among the h nearest documents."""
        d = point - mean
        order = np.argsort(np.einsum("ki,ij,kj->k", d, np.linalg.inv(cov + floor), d), kind="stable")
        before = np.cumsum(count[order]) - count[order]
        out = np.empty(len(count))
        out[order] = np.clip((h - before) / count[order], 0, 1)
        return out

    def steps(mean: np.ndarray, cov: np.ndarray, most: int) -> tuple[float, np.ndarray, np.ndarray]:
        best = np.inf
        for _ in range(most):
            mean, cov = _moments((h, nearest(mean, cov)), total, square)
            det = float(np.linalg.det(cov + floor))
            if det >= best * (1 - 1e-9):
                break
            best = det
        return min(best, det), mean, cov

    def quantile(q: float) -> np.ndarray:
        order = np.argsort(point, axis=0, kind="stable")
        held = np.cumsum(count[order], axis=0)
        return np.array([point[order[np.searchsorted(held[:, k], q * n), k], k] for k in range(4)])

    low, mid, high = (quantile(q) for q in (0.25, 0.5, 0.75))
    begin = [(mid, np.diag(((high - low) / 1.349) ** 2)), _moments((n, np.ones(len(count))), total, square)]
    rng = np.random.Generator(np.random.PCG64(len(count)))
    for _ in range(starts):
        some = rng.choice(len(count), 5, p=count / n)
        spread = point[some] - point[some].mean(axis=0)
        begin.append((point[some].mean(axis=0), spread.T @ spread / 5))
    # Two steps of every start, all steps of the best ones and of the first two, as in the fast algorithm.
    tried = [steps(*b, 2) for b in begin]
    order = sorted(range(len(tried)), key=lambda i: tried[i][0])
    final = [steps(*tried[i][1:], MOST_STEPS) for i in sorted({0, 1, *order[:5]})]
    det, mean, cov = min(final, key=lambda f: f[0])
    return mean, cov, det


def reweighted(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MCD estimate, made consistent, and from it that of all documents within the 97.5 % point."""
    mean, cov, _ = mcd(count, total, square)
    d = total / count[:, None] - mean
    near = np.einsum("ki,ij,kj->k", d, np.linalg.inv(_consistency(SHARE) * cov + np.eye(4) / UNIT**2), d) <= REWEIGHT
    mean, cov = _moments((count[near].sum(), near * 1.0), total, square)
    return mean, _consistency(0.975) * cov


def _fit(group: tuple, sums: pd.DataFrame) -> pd.DataFrame:
    """A group's estimate from its sums by level."""
    sums = sums.sort_values([f"g{i}" for i in range(4)])
    total, square = sums[_M].to_numpy(np.float64) / UNIT, sums[_S].to_numpy(np.float64) / UNIT**2
    mean, cov = reweighted(sums["n"].to_numpy(np.float64), total, square)
    return pd.DataFrame([[*group, int(sums["n"].sum()), *mean, *(cov[p] for p in _PAIRS)]], columns=[f.split()[0] for f in _FIT.split(", ")])


def _shrunk(own: DataFrame, to: dict[str, object]) -> DataFrame:
    """Estimates ``own`` drawn towards others, given as columns by name: PRIOR documents stand beside the n.

    What the centres are apart is not added to the scatter: a lone outlier would cover itself by it.
    """
    n, both = F.col("n"), F.col("n") + PRIOR
    return own.withColumns({c: (n * F.col(c) + PRIOR * to[c]) / both for c in _M + _S})


def estimates(judged: DataFrame) -> DataFrame:
    """lang_key, source_key, n, centre (m0 to m3) and scatter (s00 to s33) of every cell of transformed rows."""
    level = [F.least(F.greatest(F.ceil(F.col(x) / step), F.lit(0)), F.lit(most - 1)).alias(f"g{i}") for i, (x, step, most) in enumerate(zip(STATS, STEPS, LEVELS, strict=True))]
    value = {c: F.sum(x) for c, x in zip(_M, STATS, strict=True)} | {c: F.sum(F.col(STATS[i]) * F.col(STATS[j])) for c, (i, j) in zip(_S, _PAIRS, strict=True)}
    keys = ["lang_key", "source_key", *(f"g{i}" for i in range(4))]
    cells = judged.select("lang_key", "source_key", *level, *STATS).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(e.alias(c) for c, e in value.items()))
    cells = materialise(cells, "quality-levels")
    none = F.lit(None).cast("string")
    groups = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), x.alias("l"), y.alias("s")) for k, (x, y) in enumerate(((F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), none), (none, none))))))
    summed = cells.withColumn("group", groups).groupBy("group.level", F.col("group.l").alias("lang_key"), F.col("group.s").alias("source_key"), *keys[2:]).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _M + _S))
    fits = materialise(summed.groupBy("level", "lang_key", "source_key").applyInPandas(_fit, _FIT), "quality-fits")
    own, lang = fits.where("level = 0").drop("level"), fits.where("level = 1").drop("level", "source_key")
    whole = fits.where("level = 2").first()
    if whole is None:
        return own
    lang = _shrunk(lang, {c: F.lit(whole[c]) for c in _M + _S}).drop("n")
    lang = lang.select(F.col("lang_key").alias("of"), *(F.col(c).alias(f"to_{c}") for c in _M + _S))
    joined = own.join(bounded_broadcast(lang, BROADCAST_CELLS), F.col("lang_key") == F.col("of"))
    return _shrunk(joined, {c: F.col(f"to_{c}") for c in _M + _S}).select("lang_key", "source_key", "n", *_M, *_S)


def sampling_variance(words: np.ndarray, symbols: np.ndarray, lines: np.ndarray, dups: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Variances (a row of 4 for each document) that its statistics have by being counts over few words or lines.

    Shares are binomial, with one success and one failure added; repeated words come CLUMP at a time;
    symbols are Poisson, by the slope of their transformation; word lengths scatter by WORD_SPREAD.
    """
    out = np.zeros((len(words), 4))
    out[:, 0] = WORD_SPREAD / words
    rate = symbols / words
    out[:, 1] = (10 / (1 + 10 * rate)) ** 2 * (symbols + 1) / words**2
    for k, (found, trials) in ((2, (dups, np.maximum(lines, 1))), (3, (repeats / CLUMP, words / CLUMP))):
        share = (found + 1) / (trials + 2)
        out[:, k] = share * (1 - share) / trials
    return out


_COUNTS = ("n_words", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the squared distance in place of a row's counts, statistics and estimate, which come last."""
    width = len(_COUNTS) + 4 + 4 + len(_S)
    for batch in batches:
        own, rest = batch.columns[:-width], [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[-width:]]
        known = ~np.isnan(rest[-1])
        words, symbols, lines, dups, repeats, *rest = (c[known] for c in rest)
        d = np.stack(rest[:4], 1) / UNIT - np.stack(rest[4:8], 1)
        cov = np.zeros((len(d), 4, 4))
        for value, (i, j) in zip(rest[8:], _PAIRS, strict=True):
            cov[:, i, j] = cov[:, j, i] = value
        cov[:, range(4), range(4)] += sampling_variance(words, symbols, lines, dups, repeats) + 1 / UNIT**2
        found = np.full(len(known), np.nan)
        if len(d):
            found[known] = np.einsum("ki,ki->k", d, np.linalg.solve(cov, d[:, :, None])[:, :, 0])
        yield pa.RecordBatch.from_arrays([*own, pa.array(found, mask=~known)], names=[*batch.schema.names[:-width], "distance"])


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` (see :func:`measure`) with ``distance`` (null if it failed the base rules) and ``kept``."""
    own = measured.columns
    table = _transformed(measured).withColumns({"lang_key": null_key("lang"), "source_key": null_key("source")})
    table = materialise(table, "quality")
    with Scratch(table.sparkSession) as scratch:
        fits = materialise(estimates(table.where(~F.col("base_failed"))), "quality-cells")
        scratch.keep(fits)
    placed = skewed_left_join(table, fits.withColumnRenamed("n", "__rows"), ["lang_key", "source_key"], broadcast_rows=BROADCAST_CELLS)
    last = F.when(~F.col("base_failed"), F.col(_S[-1])).alias(_S[-1])  # null: not compared
    placed = placed.select(*own, *(F.col(c).alias(f"__{c}") for c in (*_COUNTS, *STATS, *_M, *_S[:-1])), last)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields)
    found = placed.mapInArrow(tk.freeing(_distances), f"{schema}, distance double")
    return found.select(*own, "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= REJECT, F.lit(True))).alias("kept"))


def score(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` and ``kept`` of every document."""
    return judge(measure(docs))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with all their columns) that :func:`judge` keeps."""
    wide = [c for c in docs.columns if c not in ("lang", "source")]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in wide)).alias("__row"), "lang", "source", "text")
    kept = judge(measure(held, ("__row", "lang", "source"))).where("kept")
    return kept.select(*(F.col(f"__row.`{c}`") if c in wide else F.col(c) for c in docs.columns))
