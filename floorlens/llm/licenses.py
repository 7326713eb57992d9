"""License scans: MinHash bands over overlapping windows, verified by exact shingle containment.

Only DataFrame and SQL functions run on the executors. Words are runs of letters and digits,
lower-cased; shingles are SHINGLE consecutive words. A template is cut into overlapping windows, as
long as the largest power of two that its number of shingles (or LONGEST) allows. A text's windows of
each such length, an eighth of it apart, and the templates' windows get 2 * BANDS MinHash values in
bands of two; windows with a Jaccard similarity of 0.6 share a band with probability
1 - (1 - 0.36)**16 = 0.9992, and most matches have several such windows. Retrieved templates are
verified: the share of the template's distinct shingles that stand in the window, widened by the
template's length on both sides, must be at least CONTAINED.

Before that, texts and places without an anchor word are set aside, which loses nothing: the
anchors are words chosen so that more than 1 - CONTAINED of each template's shingles hold one, and so
any match holds one. Windows are taken from the first anchor less the longest template to the last
anchor plus that.

Templates are the caller's or TEMPLATES; their bands are broadcast if they are at most BROADCAST_BANDS.

Defined results: null or empty texts and texts of fewer than SHINGLE words match nothing; a template
of fewer words is refused, as it has no shingle; each of repeated rows is reported; a null doc_id is passed on; an empty
table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

SHINGLE, CONTAINED, BANDS, LONGEST = 5, 0.75, 16, 64
#: Most bands of templates that are broadcast (some kilobytes each, with the template's shingles).
BROADCAST_BANDS = 20_000

# Public license notices.
TEMPLATES = {
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-line": "Released under the MIT License.",
    "apache-2-line": "Licensed under the Apache License, Version 2.0.",
    "mpl-2-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}

_SPLIT = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that more than 1 - CONTAINED of each template's distinct shingles hold one.

    Long words are taken first, which are rare in other texts.
    """
    out: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        held = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        share = lambda: sum(any(w in out for w in s) for s in held) / len(held)  # noqa: E731, B023
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if share() > 1 - CONTAINED:
                break
            out.add(w)
    return sorted(out)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """A hash of each run of SHINGLE words; none if there are fewer."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    hashes = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))
    return F.when(F.size(words) >= SHINGLE, hashes).otherwise(F.array().cast("array<long>"))


def permuted(hashes: Column) -> Column:
    """2 * BANDS arrays of the shingles' values, one for each MinHash function."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 * BANDS - 1)), lambda k: F.transform(hashes, lambda x: F.xxhash64(x, k)))


def band_keys(values: Column, at: Column, length: int) -> Column:
    """A key for each band of two MinHash values of a window; a window of one shingle needs one only."""
    least = lambda k: F.array_min(F.slice(values[k], at, F.lit(length)))
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1 if length > 1 else 0))
    return F.transform(bands, lambda b: F.xxhash64(b, least(2 * b), least(2 * b + 1)))


def window_length(shingles: int) -> int:
    return 1 << min(shingles, LONGEST).bit_length() - 1


def windows(length: int, step: int) -> Column:
    """The windows of a length over the columns ``hashes`` and ``values``, the last one at the end."""
    last = F.greatest(F.size("hashes") - length + 1, F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(max(1, step))), F.array(last)))
    return F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), band_keys(F.col("values"), i, length).alias("bands")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, shingles (distinct hashes), n (shingles in a row), length of its windows, and their bands."""
    rows = [(k, template_words(t)) for k, t in templates.items()]
    lengths = sorted({window_length(len(w) - SHINGLE + 1) for _, w in rows})
    table = spark.createDataFrame(rows, "name string, words array<string>").withColumn("hashes", shingle_hashes(F.col("words")))
    table = table.withColumn("values", permuted(F.col("hashes")))
    own = F.lit(None)
    for length in lengths:
        own = F.when(F.size("hashes") >= length, windows(length, length // 2)).otherwise(own)
    table = table.select("name", F.array_distinct("hashes").alias("shingles"), F.size("hashes").alias("n"), F.explode(own).alias("w"))
    table = table.select("name", "shingles", "n", "w.length", F.explode("w.bands").alias("band"))
    return table.dropDuplicates(["name", "length", "band"])


def matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_windows (retrieved and verified), shared and n_template (distinct shingles)
    of the best window, for every document and template that match."""
    templates = TEMPLATES if templates is None else templates
    short = [k for k, t in templates.items() if len(template_words(t)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    spark = docs.sparkSession
    lengths = sorted({window_length(len(template_words(t)) - SHINGLE + 1) for t in templates.values()})
    reach = max(len(template_words(t)) for t in templates.values())
    marks = anchors(templates)

    low = F.lower(F.col("text").cast("string"))
    has_anchor = F.lit(False)
    for a in sorted(marks, key=len):
        if not any(b != a and b in a for b in marks):
            has_anchor = has_anchor | low.contains(a)
    listed = F.array(*(F.lit(a) for a in marks))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(has_anchor)
    # Written out, or the optimizer would repeat the splitting in each expression that uses the words.
    held = materialise(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words")), "license-words")
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(listed, w), i)), lambda i: i.isNotNull())
    held = held.withColumn("at", at).where(F.size("at") > 0)
    first = F.greatest(F.array_min("at") - reach, F.lit(0))
    held = held.withColumn("words", F.slice("words", first + 1, F.array_max("at") + reach + 1 - first))
    held = materialise(held.select("doc_id", "row", shingle_hashes(F.col("words")).alias("hashes")), "license-hashes").where(F.size("hashes") > 0)
    # What is left of the texts may stand in a few small files; the windows are worth all tasks.
    held = held.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))

    held = held.withColumn("values", permuted(F.col("hashes")))
    # A text shorter than a length has one window of it, the whole text: it may hold enough of a template.
    fitting = [windows(n, n // 8) for n in lengths]
    spread = held.select("doc_id", "row", "hashes", F.explode(F.flatten(F.array(*fitting))).alias("w"))
    spread = spread.select("doc_id", "row", "hashes", "w.length", "w.at", F.explode("w.bands").alias("band"))
    known = template_table(spark, templates)
    found = spread.join(bounded_broadcast(known, BROADCAST_BANDS), ["length", "band"])
    start = F.greatest(F.col("at") - F.col("n"), F.lit(1))
    wide = F.slice("hashes", start, F.col("at") + F.col("length") + F.col("n") - start)
    found = found.select("doc_id", "row", "name", "length", "at", F.size(F.array_intersect("shingles", wide)).alias("shared"), F.size("shingles").alias("n_template"))
    found = found.where(F.col("shared") >= F.ceil(F.lit(CONTAINED) * F.col("n_template")))
    best = found.groupBy("doc_id", F.col("name").alias("license"), "row").agg(F.count_distinct("at").alias("n_windows"), F.max("shared").cast("long").alias("shared"), F.max("n_template").cast("long").alias("n_template"))
    return best.drop("row")
