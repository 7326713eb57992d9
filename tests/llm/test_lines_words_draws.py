"""Line dedup, spelling variants and importance resampling against brute force and odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlens.llm import linededup, resampling, spelling
from floorlens.llm import textkernel as tk

from .conftest import sentence

UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = "doc_id long, text string, key string, rank long, n long, dropped string, __row long, text_id string"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def clash(spark):
    """Extra columns with the names of the operators' own ones; nulls, repeats and many rows without an id."""
    rows = [(i, f"shared line\nown {i} {sentence(i, 25)}\nÉTÉ Shared", "x", 1, 2, "y", 3, "z") for i in range(12)]
    rows += [(None, "  SHARED line \r\n\nshared line", None, None, None, None, None, None)] * 30
    rows += [(50, None, "x", 1, 2, "y", 3, "z"), (51, "", "x", 1, 2, "y", 3, "z"), (52, "été shared", "x", 1, 2, "y", 3, "z"), (53, "\n\n", "x", 1, 2, "y", 3, "z")]
    return spark.createDataFrame(rows, ODD_TEXTS)


# ------------------------------------------------------------------ 11


def brute_lines(rows, least=1, documents=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER_LOWER)
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    gone = {k for k, docs in held.items() if len(k) >= least and len(docs) >= documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [linededup.BROADCAST_KEYS, 0])
def test_lines_of_many_documents_go(spark, clash, odd, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", broadcast)
    for docs in (clash, odd):
        for least, documents in ((1, 10), (1, 2), (12, 2), (0, 3), (1, 1)):
            found = linededup.without_frequent_lines(docs, least, documents)
            assert rows_of(found, "doc_id", "n_lines", "n_dropped", "text") == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()], least, documents)


def test_line_dedup_of_random_texts_and_its_digest(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(["a", " A", "b\t", "", "c c", "É", "é", "x" * 5000, str(i)]) for _ in range(rng.choice([0, 1, 3, 40, 3000])))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in brute_lines(rows)]
    got = linededup.digest(linededup.without_frequent_lines(docs))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_only_capitals_of_ascii_are_folded(spark):
    texts = ["İstanbul K", "ΑΒΓ abc", "ẞ", "plain ASCII", "\xa0kept\xa0", " x"]
    got = spark.createDataFrame([(t,) for t in texts], "line string").select(linededup.line_key(F.col("line")).alias("k")).collect()
    assert [r["k"] for r in got] == [t.translate(UPPER_LOWER) for t in texts]


def test_line_dedup_of_no_rows(spark, empty):
    assert linededup.without_frequent_lines(empty).collect() == []


def test_line_dedup_runs_without_python_workers(clash):
    plan = linededup.without_frequent_lines(clash)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ 12


def brute_counts(rows):
    found = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=5):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def crowd(seed, words, letters="abé"):
    """Words of few letters, so that many are near each other, in texts with counts over a wide range."""
    rng = random.Random(seed)
    made = {"".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 7, 8, 12]))) for _ in range(words)}
    return [w for w in sorted(made) for _ in range(rng.choice([1, 5, 6, 30, 31, 170, 900]))]


def test_occurrences_are_counted_as_runs(spark):
    rng = random.Random(5)
    letters = "abcXYZéÉ×÷ÿœ_1 -\n"
    rows = [(i if i % 7 else None, "".join(rng.choice(letters) for _ in range(9000)) if i % 5 else None) for i in range(30)]
    rows += [(100 + i, "Straße Élégant NAÏVETÉ Österreich " * 50 + "q" * 100_000) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == brute_counts(rows)
    found = brute_counts([(i, "elephant " * 3) for i in range(3000)])  # some of these runs lose a letter
    assert len(found) > 1
    got = spelling.vocabulary(spark.createDataFrame([(i, "elephant " * 3) for i in range(3000)], "doc_id long, text string"))
    assert {r["word"]: r["n"] for r in got.collect()} == found


@pytest.mark.parametrize(("group", "task"), [(spelling.GROUP, spelling.TASK), (1, 50), (7, 300)])
def test_variants_in_a_crowd(spark, group, task):
    rows = [(i, " ".join(part)) for i, part in enumerate(itertools.batched(crowd(3, 260), 500))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), group=group, task=task)
    assert rows_of(got, *VARIANT) == brute_variants(brute_counts(rows))


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    words = [(w, 5 * 6**i) for i, w in enumerate(chain)] + [("zzzzzz", 5)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in itertools.pairwise(words[:-1])], "word string, form string")
    assert dict(rows_of(spelling.roots(forms), "word", "root")) == dict.fromkeys(chain[:-1], chain[-1])
    assert spelling.roots(forms.where("false")).collect() == []


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        first, low = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        last, high = np.minimum(n, first + rng.integers(0, n + 1, 200)), np.minimum(n, low + rng.integers(0, n + 1, 200))
        query, value = tree.report(first, last, low, high)
        want = [(q, v) for q in range(200) for v in values[first[q] : last[q]] if low[q] <= v < high[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(want)


def test_variants_of_odd_rows(spark, odd, empty, clash):
    for docs in (odd, clash):
        assert rows_of(spelling.variants(docs), *VARIANT) == brute_variants(brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert spelling.variants(empty).collect() == []
    long = [(1, " ".join(["x" * 5000 + "a"] * 40 + ["x" * 5000] * 6 + ["x" * 5000 + "b"] * 5))]
    assert rows_of(spelling.variants(spark.createDataFrame(long, "doc_id long, text string")), *VARIANT) == brute_variants(brute_counts(long))


# ------------------------------------------------------------------ 13


def brute_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER_LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in brute_features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in brute_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        words, found = brute_features(text)
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(long[: 5 * len(long) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


DRAWN = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def test_registers_advance_to_the_crc():
    rng = random.Random(2)
    texts = [rng.randbytes(n) for n in (0, 1, 2, 63, 64, 65, 66, 300, 5000)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    got = tk.crc_spans(raw, np.cumsum(length) - length, length, np.full(len(texts), tk.CRC_START)) ^ tk.CRC_START
    assert got.tolist() == [zlib.crc32(t) for t in texts]


def test_features_of_bytes():
    texts = ["", "One", "two  words", "A b C d", "naïve—“quotes” 漢字 x\x00y z9", "q" * 70 + " " + "r" * 200]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    bucket, owner, words = resampling.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, t in enumerate(texts):
        want_words, want = brute_features(t)
        assert words[i] == len(want_words) and sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in want)


def test_draw_is_that_of_brute_force(spark):
    rng = random.Random(9)
    lexicon = sentence(8, 300).split()
    rows = [(i, " ".join(rng.choices(lexicon, k=rng.choice([3, 19, 20, 21, 200])))) for i in range(300)]
    rows += [(None, rows[5][1])] * 3 + [(7, rows[7][1])] * 40 + [(900, None), (901, "")]
    target = [" ".join(rng.choices(lexicon[:80], k=60)) for _ in range(20)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(got, *DRAWN) == brute_draw(rows, [t for t in target if t])


def test_draw_of_odd_rows(spark, odd, empty, clash):
    for docs in (odd, clash):
        assert rows_of(resampling.resampled(docs, empty), *DRAWN) == brute_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    assert resampling.resampled(empty, odd).collect() == []


def test_the_draw_follows_the_target(spark):
    rng = random.Random(3)
    here, there = sentence(1, 200).split(), sentence(2, 200).split()
    rows = [(i, " ".join(rng.choices(here if i % 10 == 0 else there, k=50))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choices(here, k=500)),)], "text string")
    got = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 20 and all(r["doc_id"] % 10 == 0 for r in got) and sorted(r["rank"] for r in got) == list(range(1, 21))
