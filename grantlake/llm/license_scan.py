"""License scans (native): MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, let, quoted

SHINGLE, BANDS = 5, 48
#: Templates, and shingles of them, that are sent to all executors and stand in a plan at once, at most (5 MB or so); more go in blocks.
BLOCK, BLOCK_SHINGLES = 1_000, 200_000
#: What public licences and notices say; more come as a table (name, text).
TEMPLATES = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 grant", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause condition", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0 notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0 notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0 notice", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT notice", "Released under the MIT License."),
    ("MIT grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0 notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def masks(bands: int) -> list[int]:
    """A number for each band; xor with it reorders hashes, so the least differs by band."""
    rng = random.Random(bands)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(bands)]


def license_words(text: Column) -> Column:
    """Words of ASCII letters and digits and of characters beyond ASCII, lower-cased in A-Z: punctuation does not count."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(ws: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n words from each place on; a shorter, not empty row of words is one shingle."""

    def made(x: Column) -> Column:
        row = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(n)]))
        return F.when(F.size(x) >= n, row).when(F.size(x) > 0, F.array(F.xxhash64(F.concat_ws(" ", x)))).otherwise(F.array().cast("array<bigint>"))

    return let(ws, made)


def signature(row: Column, bands: int) -> list[Column]:
    """The least shingle under each band's reordering."""

    def least(mask: Column) -> Column:
        return F.array_min(F.transform(row, lambda h: h.bitwiseXOR(mask))).bitwiseXOR(mask)

    return [least(F.lit(m)) for m in masks(bands)]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "name string, text string")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """A row a document and template that it holds: doc_id, license, n_shingles, containment, first_word, last_word.

    A template of s shingles is sought in windows of twice its class (s rounded up to a power of two) that
    start every class, so one window holds any occurrence whole. A window with `least` of the template has
    a Jaccard similarity of 0.19 or more with it; of 48 one-row bands all miss with probability below 1e-4,
    and below 1e-10 for most sizes. A band can only meet if the window holds that band's least shingle
    of some template, so windows without one are passed over before signatures are made: nothing is lost.
    Every candidate is verified by exact containment of shingles; the window that holds most, the
    earliest of equals, gives containment and the first and last word (places from 0, within the window).

    Templates come in blocks of bounded size, so what is sent to executors or held on the driver is bounded; where there are several, each block's
    rows are written to the shared folder. A template longer than a block's shingles is one alone. Templates without words never
    match; null or empty texts match nothing; very long texts are scanned whole; of windows that hold equally many the earliest
    counts; repeated document rows give a row each; a template name that occurs twice is two templates with one name; an
    empty table gives no rows. Columns other than key and text are not read, whatever their names.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    templates = default_templates(spark) if templates is None else templates
    known = templates.select(F.col("name"), F.array_distinct(shingles(license_words(F.col("text")))).alias("t")).where(F.size("t") > 0)
    known = known.withColumn("half", F.pow(F.lit(2), F.ceil(F.log2(F.size("t")))).cast("int")).withColumn("sig", F.array(*signature(F.col("t"), bands)))
    out, scratch = spark.createDataFrame([], f"doc_id {kind}, license string, n_shingles long, containment double, first_word long, last_word long"), None
    todo = blocks(known.toLocalIterator())
    rows = next(todo, None)
    while rows is not None:
        found, after = _scan(docs, rows, key, text, least, bands), next(todo, None)
        if after is not None or scratch:
            scratch = scratch or Scratch(spark)
            found = scratch.save(found, f"block-{uuid.uuid4().hex}")
        out, rows = out.unionByName(found), after
    return out


def blocks(rows: Iterator[Row]) -> Iterator[list[Row]]:
    block: list[Row] = []
    size = 0
    for r in rows:
        if block and (len(block) == BLOCK or size + len(r["t"]) > BLOCK_SHINGLES):
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r["t"])
    if block:
        yield block


def _scan(docs: DataFrame, rows: list, key: str, text: str, least: float, bands: int) -> DataFrame:
    spark = docs.sparkSession
    halves = sorted({r["half"] for r in rows})
    marks = {h: sorted({s for r in rows if r["half"] == h for s in r["sig"]}) for h in halves}
    every = sorted({s for m in marks.values() for s in m})
    at = docs.select(docs[quoted(key)].alias("doc_id"), F.monotonically_increasing_id().alias("row"), shingles(license_words(docs[quoted(text)].cast("string"))).alias("h"))
    # the places of shingles that some band of some template has as its least; most texts have none
    places = let(F.col("h"), lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull()))
    at = at.withColumn("places", places).where(F.size("places") > 0)

    def windows(half: int) -> Column:
        """Starts of the windows of a class that hold a marked place: the one that begins before it and the one before that."""
        starts = F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(F.floor(i / half) * half, F.floor(i / half) * half - half))))
        return F.transform(F.filter(starts, lambda s: s >= 0), lambda s: F.struct(F.lit(half).alias("half"), s.cast("long").alias("start")))

    cut = at.select("doc_id", "row", "h", F.explode(F.flatten(F.array(*[windows(h) for h in halves]))).alias("w"))
    cut = cut.select("doc_id", "row", F.col("w.half").alias("half"), F.col("w.start").alias("start"), F.slice("h", F.col("w.start").cast("int") + 1, F.col("w.half") * 2).alias("h"))
    # signatures meet in bands
    signed = cut.select("*", F.array(*signature(F.col("h"), bands)).alias("sig"))
    keys = spark.createDataFrame([(r["half"], b, s, i) for i, r in enumerate(rows) for b, s in enumerate(r["sig"])], "half int, band int, least long, template int")
    meet = signed.select("doc_id", "row", "half", "start", "h", F.posexplode("sig").alias("band", "least")).join(F.broadcast(keys), ["half", "band", "least"])
    candidates = meet.groupBy("row", "doc_id", "half", "start", "template").agg(F.first("h").alias("h"))
    full = spark.createDataFrame([(i, r["name"], r["t"]) for i, r in enumerate(rows)], "template int, license string, t array<bigint>")
    checked = candidates.join(F.broadcast(full), "template").select("*", F.size(F.array_intersect("t", "h")).alias("hits"), F.size("t").alias("n"))
    checked = checked.where(F.col("hits") >= F.col("n") * least)
    held = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("t", x), i)), lambda i: i.isNotNull())
    checked = checked.select("row", "doc_id", "license", "template", "n", "start", "hits", held.alias("held"))
    best = checked.groupBy("row", "doc_id", "template", "license", "n").agg(F.max(F.struct("hits", (-F.col("start")).alias("before"), "held")).alias("b"))
    first = -F.col("b.before") + F.array_min("b.held")
    last = -F.col("b.before") + F.array_max("b.held") + (SHINGLE - 1)
    return best.select("doc_id", "license", F.col("n").cast("long").alias("n_shingles"), (F.col("b.hits") / F.col("n")).alias("containment"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"))
