"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of letters and digits, lower-cased. A text is covered by overlapping windows of six words,
which are two shingles of five, moved on by two words; every shingle lies in a window. Each window has `bands`
MinHash values, the smallest of its shingles' hashes after an exclusive-or with the band's constant, and each
value is a band of its own. A template gives the values of its windows at every start and of
its single shingles. A shingle of a template that stands in a text meets the template's window of that
shingle alone with a similarity of at least 1/2, so one of the bands agrees with probability
1 - 2 ** -bands: 99.98 % for 12 bands, and more for every further shingle. What the bands find is verified: the
share of the template's distinct shingles that the text holds, compared as strings, is 0.8 or more.

The templates are a bounded parameter; their values stand in the plan as a literal, so no row is shuffled
or joined, and no group of copies can pile up. Texts are scanned whole.

Defined cases: NULL, empty and blank texts, and texts of fewer than five words, match nothing. Repeated
rows match alike, each its own. A template named twice counts as one name. No rows give no rows. Other
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.expr import let

SHINGLE = 5
LEAST_CONTAINMENT = 0.8
BANDS = 12

# --- fixed values: license notices as they are published -------------------
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# --- end of fixed values ----------------------------------------------------


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return sorted({" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def _words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    """One hash per start of five words: pairs, pairs of pairs, and a fifth word."""
    pair = lambda h, apart: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + apart)))
    fives = lambda h: let(pair(h, 1), lambda twos: let(pair(twos, 2), lambda fours: F.transform(
        fours, lambda x, i: F.xxhash64(x, F.get(h, i + 4)))))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), fives)
    return F.slice(found, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))


def _constants(bands: int) -> list[int]:
    """Spread 64-bit constants, one a band."""
    return [(0x9E3779B97F4A7C15 * (j + 1)) % (1 << 63) for j in range(bands)]


def _band_values(hashes: Column, bands: int) -> Column:
    """All windows' MinHash values; the last, single shingle of an odd number is a window too."""
    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - 1, F.lit(2))

        def values(i: Column) -> Column:
            one, two = F.get(h, i), F.get(h, i + 1)
            return F.array(*[F.coalesce(F.least(one.bitwiseXOR(F.lit(c)), two.bitwiseXOR(F.lit(c))), one.bitwiseXOR(F.lit(c)))
                             for c in _constants(bands)])
        return F.flatten(F.transform(starts, values))
    return F.when(F.size(hashes) > 0, let(hashes, of)).otherwise(F.array().cast("array<bigint>"))


def template_values(spark: SparkSession, templates: dict[str, list[str]], bands: int) -> list[int]:
    """The values of every pair of neighbouring shingles and of every single one, made by the same expressions."""
    rows = [(template_words(t),) for texts in templates.values() for t in texts]
    hashed = spark.createDataFrame(rows, "words array<string>").select(_shingle_hashes(F.col("words")).alias("h")).collect()
    out = set()
    for (h,) in hashed:
        for c in _constants(bands):
            moved = [x ^ c for x in h]
            out |= set(moved) | {min(a, b) for a, b in zip(moved, moved[1:])}
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, bands: int = BANDS) -> DataFrame:
    """doc_id, license and containment of each verified match, the best of a license's notices."""
    templates = templates or TEMPLATES
    values = F.array(*[F.lit(v) for v in template_values(docs.sparkSession, templates, bands)])
    words = docs.select("doc_id", _words(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "words", _shingle_hashes(F.col("words")).alias("hashes"))
    found = hashed.select("doc_id", "words", _band_values(F.col("hashes"), bands).alias("values")) \
        .filter(F.arrays_overlap("values", values))
    shingles = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)),
                           lambda i: F.array_join(F.slice("words", i, SHINGLE), " "))
    held = found.select("doc_id", F.array_distinct(shingles).alias("shingles"))
    notices = [(name, template_shingles(t)) for name, texts in templates.items() for t in texts]
    notices = [(name, parts) for name, parts in notices if parts]
    matches = F.array(*[F.struct(
        F.lit(name).alias("license"),
        (F.size(F.array_intersect(F.array(*[F.lit(p) for p in parts]), F.col("shingles"))) / F.lit(float(len(parts))))
        .alias("containment")) for name, parts in notices])
    best = lambda found: F.transform(F.array_distinct(F.transform(found, lambda m: m["license"])), lambda name: F.struct(
        name.alias("license"), F.array_max(F.transform(F.filter(found, lambda m: m["license"] == name), lambda m: m["containment"]))
        .alias("containment")))
    kept = held.select("doc_id", F.filter(matches, lambda m: m["containment"] >= LEAST_CONTAINMENT).alias("found"))
    return kept.select("doc_id", F.inline(best(F.col("found"))))
