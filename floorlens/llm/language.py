"""Language identification: words first, backing off to shorter character n-grams.

A word is a run of letters and the marks that combine with them, lower-cased. A word of the model scores its log frequency in each
language. A word the model lacks is cut into the longest n-grams that it knows (4 down to 1
characters of the word with a blank at both ends) and scores their mean log frequency, less a
penalty for each step down. A text's score is the sum over its words; the language with the best
score wins, and ``score`` is its share of the tempered likelihoods.

The model is fitted on a bounded sample of the labelled rows: about SAMPLE documents of each language
(chosen by a hash of doc_id, whole texts): of them it holds every word and n-gram that occurs at least SEEN
times in a language. Its size is so bounded by the sample, and it is sent to all tasks. Every document is scored over its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
there are no labelled rows; ties go to the language first in code point order; null languages are
not learned from; a null doc_id counts as the empty string in the fold; repeated rows are scored
alike; an empty table gives no rows; other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise
from .textkernel import freeing

SAMPLE, LONGEST = 3000, 4
#: Occurrences in the sample of one language from which on a word or n-gram is learned; rarer words back off.
SEEN = 3
#: Log penalty of each step from words to 4-, 3-, 2- and 1-grams.
STEP = log(2.0)
#: Words beyond which a text's likelihoods are tempered, so that the score stays a graded one.
SURE = 20
FOLDS, HELD_OUT = 4, 2
#: Texts whose words are looked up together.
ROWS = 1000
#: Letters with the marks that combine with them; numbers that are no digits are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UND = "und"


class Model:
    """Scores per word: a row of log frequencies, one for each language."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: dict[str, list[float]], totals: tuple[list[float], list[list[float]]]) -> None:
        self.langs, self.place, self.gram_place = langs, {}, {}
        if not langs:
            return
        k = len(langs)
        word_total, gram_totals = np.array(totals[0]), np.array(totals[1]).reshape(-1, k)
        self.rows = np.log((np.array(list(words.values()), np.float64).reshape(-1, k) + 0.01) / (word_total + 1))
        self.place = {w: i for i, w in enumerate(words)}
        lengths = np.array([len(g) for g in grams], np.int64)
        counts = np.array(list(grams.values()), np.float64).reshape(-1, k)
        self.grams = np.log((counts + 0.5) / (gram_totals[lengths - 1] + 1)) if len(grams) else counts
        self.gram_place = {g: i for i, g in enumerate(grams)}

    def unseen(self, word: str) -> np.ndarray:
        """Backs off: the longest known n-gram at each place, left to right."""
        padded, at, total, n = f" {word} ", 0, np.zeros(len(self.langs)), 0
        while at < len(padded):
            for size in range(LONGEST, 0, -1):
                i = self.gram_place.get(padded[at : at + size]) if at + size <= len(padded) else None
                if i is not None:
                    total += self.grams[i] - (LONGEST + 1 - size) * STEP
                    n += 1
                    at += max(1, size - 1)
                    break
            else:
                at += 1
        return total / n if n else total

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: its own, or those of its n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        places = np.array([self.place.get(w, -1) for w in words], np.int64)
        known = places >= 0
        out[known] = self.rows[places[known]]
        for i in np.flatnonzero(~known).tolist():
            out[i] = self.unseen(words[i])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text; every distinct word of them is looked up once."""
        langs, score = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, score
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(w) for w in found], np.int64)
        coded = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
        rows, number = self.scores(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        at = np.concatenate([[0], np.cumsum(n)])
        for i in np.flatnonzero(n).tolist():
            # by number of occurrences of each word, so that a long text needs no row for every word
            times = np.bincount(number[at[i] : at[i + 1]]) if n[i] > 5000 else None
            total = times @ rows[: len(times)] if times is not None else rows[number[at[i] : at[i + 1]]].sum(axis=0)
            best = int(np.argmax(total))
            share = np.exp((total - total[best]) * min(1.0, SURE / n[i]))
            langs[i], score[i] = self.langs[best], float(1 / share.sum())
        return langs, score


def held_out(doc_id):
    """Whether a row is held out of fitting: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch of sampled documents."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for w in LETTERS.findall((text.as_py() or "").lower()):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, *, sample: int = SAMPLE, seen: int = SEEN) -> Model:
    """A model of the rows of ``docs`` that have a language. The caller leaves out what must not be learned."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in counts.collect()}
    langs = sorted(share)
    if not langs:
        return Model([], {}, {}, ([], []))
    spark = docs.sparkSession
    shares = spark.createDataFrame(list(share.items()), "lang string, share double")
    labelled = labelled.join(F.broadcast(shares), "lang")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)
    word = labelled.where(drawn).select("lang", "text").mapInArrow(_tokens, "lang string, word string, n long")
    word = materialise(word.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def cuts(size: int):
        places = F.sequence(F.lit(1), F.greatest(F.length("word") + 3 - size, F.lit(1)))
        found = F.transform(places, lambda i: F.substring(padded, i, F.lit(size)))
        return F.when(F.length("word") + 2 >= size, found).otherwise(F.array().cast("array<string>"))

    gram = word.select("lang", "n", F.explode(F.concat(*map(cuts, range(1, LONGEST + 1)))).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    gram = materialise(gram, "lang-grams")

    place = {lang: i for i, lang in enumerate(langs)}

    def counts_of(table: DataFrame) -> tuple[dict[str, list[float]], DataFrame]:
        """Counts by language of the strings that some language has often enough, and the sums over all by length."""
        often = table.where(F.col("n") >= seen).select("word").distinct()
        out: dict[str, list[float]] = {}
        for r in table.join(often, "word").groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by")).orderBy("word").toLocalIterator():
            row = out.setdefault(r["word"], [0.0] * len(langs))
            for lang, n in r["by"]:
                row[place[lang]] = float(n)
        return out, table.groupBy("lang", F.least(F.length("word"), F.lit(LONGEST)).alias("size")).agg(F.sum("n").alias("n"))

    word_counts, _ = counts_of(word)
    gram_counts, sizes = counts_of(gram)
    word_total, gram_total = [0.0] * len(langs), [[0.0] * len(langs) for _ in range(LONGEST)]
    for r in word.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        word_total[place[r["lang"]]] = float(r["n"])
    for r in sizes.collect():
        gram_total[r["size"] - 1][place[r["lang"]]] += float(r["n"])
    return Model(langs, word_counts, gram_counts, (word_total, gram_total))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            langs, scores, texts = [], [], batch.columns[-1]
            for a in range(0, len(texts), ROWS):
                found = own.predict(texts[a : a + ROWS].to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(freeing(run), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the rows that are not held out."""
    with Scratch(docs.sparkSession):
        model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
