"""Operator 7: licence scans with MinHash bands (DataFrame functions only).

A text's words are hashed and every run of SHINGLE words is a shingle; every
WINDOW neighbouring shingles are a window (SHINGLE + WINDOW - 1 words, each
overlapping the next).  A window's signature has BANDS minima of its shingles,
each under a hash of its own, and each is a band.  Templates are cut into
windows the same way, so a verbatim window meets its twin in all bands, and a
window of similarity J meets it with probability 1 - (1 - J) ** BANDS.  A
template of a single shingle has no window of its own in a longer text, so it
is looked for among windows of one shingle, in a band more: a verbatim one
always meets its twin.  A template with edits keeps some verbatim windows.

A template that a band retrieves is verified exactly: the share of its
distinct shingles that the whole document holds is at least MIN_CONTAINED.

Templates shorter than SHINGLE words are one shingle of all their words; the
lengths that occur are read from the templates, and shingles of each length
are windowed.  Band keys are literals of the plan in blocks of at most
BLOCK_SHINGLES template shingles; more templates take more blocks.

Defined cases: null and empty texts and texts shorter than every shingle
match nothing; templates without words never match; documents with equal texts
are reported each; repeated rows too; an empty table gives an empty result;
extra columns aren't read.  Ties, several templates in one document, are all
reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 2
BANDS = 6
MIN_CONTAINED = 0.8
#: Template shingles that one plan holds.
BLOCK_SHINGLES = 20_000

#: Notices by which licences are declared, and opening clauses of licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word: runs of letters and digits, lower-cased."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, size: int) -> Column:
    """The hash of each run of ``size`` words, in text order."""
    many = F.size(words) - F.lit(size - 1)
    runs = F.transform(F.sequence(F.lit(1), many), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))
    return F.when(many > 0, runs).otherwise(F.array().cast("array<bigint>"))


def band_keys(runs: Column, band: int) -> Column:
    """The band's key of each window: the least of its shingles' hashes.  The
    band after the last has the shingles themselves, windows of one."""
    if band == BANDS:
        return runs
    hashed = F.transform(runs, lambda x: F.xxhash64(x, F.lit(band)))

    def least(own: Column) -> Column:
        low = own
        for step in range(1, WINDOW):
            low = F.zip_with(low, F.slice(own, step + 1, F.greatest(F.size(own) - step, F.lit(0))), lambda x, y: F.least(x, y))
        return low

    return F.transform(F.array(hashed), least)[0]


Template = tuple[str, int, list[int], list[list[int]]]


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[Template]:
    """(name, shingle size, distinct shingles, keys of each band) of each
    template with words."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").withColumn("w", word_hashes(F.col("text")))
    out = []
    for size in range(1, SHINGLE + 1):
        sized = rows.where(F.least(F.size("w"), F.lit(SHINGLE)) == size).select("name", shingles(F.col("w"), size).alias("s"))
        cut = sized.select("name", F.array_distinct("s").alias("own"), *[band_keys(F.col("s"), b).alias(f"b{b}") for b in range(BANDS + 1)])
        for r in cut.collect():
            used = [BANDS] if len(r[1]) == 1 else range(BANDS)
            out.append((r[0], size, sorted(r[1]), [sorted(set(r[2 + b])) if b in used else [] for b in range(BANDS + 1)]))
    return sorted(out)


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _scan(docs: DataFrame, size: int, block: list[Template], key: str, text: str) -> DataFrame:
    """Matches with the templates of one block, whose shingles have ``size`` words."""
    owners: dict[tuple[int, int], list[str]] = {}
    for name, _, _, keys in block:
        for b, own in enumerate(keys):
            for k in own:
                owners.setdefault((b, k), []).append(name)
    spark = docs.sparkSession
    rows = [(b, k, n) for (b, k), names in owners.items() for n in names]
    retrieve = spark.createDataFrame(rows, "band int, band_key bigint, template string")
    verify = spark.createDataFrame([(n, own) for n, _, own, _ in block], "template string, own array<bigint>")
    runs = docs.select(
        F.monotonically_increasing_id().alias("doc_row"),
        F.col(key).alias("doc_id"),
        word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("w"),
    ).select("doc_row", "doc_id", shingles(F.col("w"), size).alias("s"))

    def met(band: int) -> Column:
        keys = _longs(sorted(k for b, k in owners if b == band))
        shared = F.array_intersect(band_keys(F.col("s"), band), keys)
        return F.transform(shared, lambda k: F.struct(F.lit(band).alias("band"), k.alias("band_key")))

    hits = runs.select("doc_row", "doc_id", "s", F.inline(F.concat(*map(met, sorted({b for b, _ in owners})))))
    named = hits.join(F.broadcast(retrieve), ["band", "band_key"])
    share = F.size(F.array_intersect("own", "s")) / F.size("own")
    found = named.join(F.broadcast(verify), "template").withColumn("contained", share)
    first = F.array_min(F.transform(F.array_intersect("own", "s"), lambda x: F.array_position("s", x)))
    return (
        found.where(F.col("contained") >= MIN_CONTAINED)
        .groupBy("doc_row", "doc_id", "template")
        .agg(
            F.max("contained").alias("contained"),
            F.count_distinct("band", "band_key").alias("n_keys"),
            (F.min(first) - 1).alias("first_word"),
        )
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, template, contained (share of the template's shingles), n_keys
    (that retrieved it) and first_word (of its first shingle, from 0), a row for
    each document and template that match."""
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    parts = []
    for size in sorted({t[1] for t in table}):
        block: list[Template] = []
        for t in [t for t in table if t[1] == size]:
            if block and sum(len(x[2]) for x in [*block, t]) > BLOCK_SHINGLES:
                parts.append(_scan(docs, size, block, key, text))
                block = []
            block.append(t)
        parts.append(_scan(docs, size, block, key, text))
    if not parts:
        return _scan(docs.limit(0), SHINGLE, [("", SHINGLE, [0], [[0]] * BANDS)], key, text).drop("doc_row")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("doc_row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document declares or holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "template", F.round("contained", 6).alias("contained"), "first_word")
