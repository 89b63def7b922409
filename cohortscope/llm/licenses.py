"""License scans with column functions only: MinHash bands over overlapping windows, then containment.

Templates and texts are words: runs of letters and digits in small letters. Texts are seen through windows of
8, 16, 32 ... words that overlap by three quarters, so a template of up to ``3/4 * width + 1`` words lies
whole in a window of the smallest width that allows it. Sets of shingles of ``SHINGLE`` words get ``BANDS``
minimum hashes, each a band of its own. A window that holds a template shares at least a quarter of its
shingles with it, so it misses all bands with a probability of at most ``0.75 ** 32``, one in ten thousand,
and several overlapping windows would have to miss it. Windows and templates that share a band are compared
exactly: a license is reported where a window holds at least ``MIN_CONTAINMENT`` of a template's shingles.

A window that holds ``MIN_CONTAINMENT`` of a template's shingles holds one of its key words: long words that
so many of the shingles contain that the rest are too few. Only windows with a key word are looked at, and
texts without one are left after a single pass. This loses nothing. The key words that a text has are found by
hashing first, and its words compared with those few, so time doesn't grow with words times templates.

Nothing but matches is shuffled. One scan takes up to ``MAX_TEMPLATES`` templates of ``MAX_BROADCAST`` bytes of
shingles together, and an error says so beyond: their bands, as numbers, and their shingles are broadcast,
and their key words are part of the plan.

Defined results: null and empty texts, and templates of fewer than ``SHINGLE`` words, match nothing;
templates that share an id are alternatives, of which the best counts; repeated documents are one row for an
id, and a null ``doc_id`` is an id like any; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import query, table

SHINGLE = 5
BANDS = 32
MIN_CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000
MAX_BROADCAST = 32 << 20
#: Notices, titles, and parts of file headers and grants as their licenses word them, long enough to
#: know a license and its version, and short enough that a sibling's wording isn't taken for it.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    (
        "GPL-3.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    (
        "LGPL-3.0",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 3 of the License",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column) -> Column:
    """Distinct runs of ``SHINGLE`` words, none where there are fewer."""
    starts = F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once per row.

    The optimizer would copy a plain expression into every later use, lambdas included, where it runs
    for each element again; it doesn't look behind an explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def bands(hashes: Column, width: Column) -> Column:
    """The minimum of each of ``BANDS`` hash functions over hashed shingles, as one number with the band's."""
    numbers = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(numbers, lambda j: F.xxhash64(width, j, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j)))))


def key_words(parts: list[str]) -> list[str]:
    """Long words one of which is in any choice of ``MIN_CONTAINMENT`` of a template's shingles."""
    cut = [set(p.split(" ")) for p in parts]
    needed = math.ceil(MIN_CONTAINMENT * len(parts) - 1e-9)
    keys, without = [], cut
    for word in sorted(set().union(*cut), key=lambda w: (-len(w), w)):
        if len(without) < needed:
            break
        keys.append(word)
        without = [c for c in without if word not in c]
    return keys


def window_width(n: Column, widths: list[int]) -> Column:
    """The narrowest window in which ``n`` words lie whole wherever they are."""
    fit = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        fit = F.when(n <= w * 3 // 4 + 1, w).otherwise(fit)
    return fit


def _window_starts(at: Column, width: int) -> Column:
    """The windows of one width that the words at the places ``at`` lie in."""
    step = width // 4
    near = F.transform(
        at,
        lambda p: F.sequence(
            F.greatest(F.lit(0), F.floor((p - width) / step).cast("int") + 1), F.floor(p / step).cast("int")
        ),
    )
    numbers = F.array_distinct(F.flatten(near))
    return F.transform(numbers, lambda s: F.struct(F.lit(width).alias("width"), (s * step).alias("start")))


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license_id, containment and n_windows for each license found in ``docs`` (doc_id, text).

    ``templates`` has license_id and text.
    """
    listed = templates.select(
        F.col("license_id").cast("string").alias("license_id"), split_words(F.col("text").cast("string")).alias("words")
    ).filter(F.size("words") >= SHINGLE)
    known = listed.select(
        F.xxhash64("license_id", "words").alias("number"),
        "license_id",
        F.size("words").alias("n"),
        shingles(F.col("words")).alias("parts"),
    ).distinct()
    n_templates, longest, volume = known.agg(
        F.count("*"), F.max("n"), F.sum(F.octet_length(F.concat_ws(" ", "parts")))
    ).first()
    if n_templates > MAX_TEMPLATES or (volume or 0) > MAX_BROADCAST:
        raise ValueError("too many templates for one scan")
    widths = [8]
    while longest is not None and widths[-1] * 3 // 4 + 1 < longest:
        widths.append(widths[-1] * 2)
    keys = F.lit(sorted({w for r in known.select("parts").collect() for w in key_words(r.parts)})).cast("array<string>")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = computed(texts, "words", split_words(F.col("text"))).filter(F.arrays_overlap("words", keys))
    texts = computed(texts, "own", F.array_intersect("words", keys))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("own", w), i)), lambda i: i.isNotNull())
    # Windows start at multiples of a quarter of their width; these are the ones that a key word lies in.
    starts = F.concat(*[_window_starts(F.col("at"), w) for w in widths])
    windows = computed(texts.select("doc_id", "words", "own"), "at", at).select(
        "doc_id", "words", F.explode(starts).alias("window")
    )
    windows = computed(windows, "seen", F.slice("words", F.col("window.start") + 1, F.col("window.width"))).select(
        "doc_id", F.col("window.width").alias("width"), F.col("window.start").alias("start"), "seen"
    )
    hashed = F.transform("held", lambda s: F.xxhash64(s))
    windows = computed(windows, "held", shingles(F.col("seen"))).filter(F.size("held") > 0).drop("seen")
    asked = computed(windows, "hashes", hashed)
    width = window_width(F.col("n"), widths)
    offered = computed(known.withColumnRenamed("parts", "held"), "hashes", hashed).select(
        "number", F.explode(bands(F.col("hashes"), width)).alias("band")
    )
    parts = F.broadcast(known.select("number", "license_id", "parts"))
    share = F.size(F.array_intersect("held", "parts")) / F.size("parts")
    return (
        asked.select("doc_id", "width", "start", "held", F.explode(bands(F.col("hashes"), F.col("width"))).alias("band"))
        .join(F.broadcast(offered), "band")
        .join(parts, "number")
        .select("doc_id", "license_id", "width", "start", share.alias("containment"))
        .filter(F.col("containment") >= MIN_CONTAINMENT)
        .groupBy("doc_id", "license_id", "width", "start")
        .agg(F.max("containment").alias("containment"))
        .groupBy("doc_id", "license_id")
        .agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))
    )


_TEMPLATES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in NOTICES)
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES = (
    "list_distinct(list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string({w}[i:i + {k} - 1], ' ')))"
)
#: The same by looking at every window of every text, without bands.
ORACLE = f"""
WITH t AS (
  SELECT license_id, {_WORDS} AS words FROM (VALUES {_TEMPLATES}) AS v(license_id, text)
), templates AS (
  SELECT license_id, {_SHINGLES.format(w="words", k=SHINGLE)} AS parts,
         CASE WHEN len(words) <= 7 THEN 8 WHEN len(words) <= 13 THEN 16 WHEN len(words) <= 25 THEN 32
              WHEN len(words) <= 49 THEN 64 ELSE 128 END AS width
  FROM t WHERE len(words) >= {SHINGLE}
), d AS (SELECT doc_id, {_WORDS} AS words FROM documents
), starts AS (
  SELECT doc_id, words, width, unnest(range(0, len(words), width // 4)) AS start
  FROM d, (SELECT DISTINCT width FROM templates)
), windows AS (
  SELECT doc_id, width, start, words[start + 1:start + width] AS words FROM starts
), held AS (
  SELECT doc_id, width, start, {_SHINGLES.format(w="words", k=SHINGLE)} AS held FROM windows WHERE len(words) >= {SHINGLE}
), found AS (
  SELECT doc_id, license_id, width, start, max(len(list_intersect(held, parts)) / len(parts)) AS containment
  FROM held JOIN templates USING (width)
  WHERE len(list_intersect(held, parts)) / len(parts) >= {MIN_CONTAINMENT}
  GROUP BY ALL
)
SELECT doc_id, license_id, max(containment) AS containment, count(*) AS n_windows FROM found GROUP BY ALL
"""


@query("op6_licenses", ORACLE)
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), notices(spark))
