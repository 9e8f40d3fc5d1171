"""Licence scan by diagonal voting.

Rolling word k-grams of every text meet, by their hashes, the places of the same k-grams in templates of licence phrases. A
match at word p of the text and word j of the template votes for the diagonal p - j. Neighbouring diagonals are merged, so
a few words put in or left out don't break a span, and a span is verified by the share of the template that it holds
in order and by its length. Only DataFrame functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 64  # words of a template at most: its matched places are the bits of a long
SLACK = 4  # words by which neighbouring diagonals of one span may differ
SHARE = 0.8  # of a template's words that a span must hold
ROOM = 1.5  # times a template's length that a span may have
PHRASE, NOTICE = 2, 3  # words of a gram of base phrases and of templates

# fixed values: base phrases and labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# public licence notices; one of more than 64 words is given in parts
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "is licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "may not be reproduced or distributed without the prior written permission of the publisher"),
]


def template_rows(templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> list[tuple[int, str, bool, int, list[str]]]:
    """Number, label, whether it is a base phrase, words of a gram, and words of every phrase and template."""
    rows = [(label, True, PHRASE, phrase) for phrase, label in base.items()] + [(label, False, NOTICE, text) for label, text in templates]
    out = []
    for number, (label, is_base, size, text) in enumerate(rows):
        words = re.findall("[0-9a-z]+", text.lower())
        if not size <= len(words) <= LENGTH:
            raise ValueError(f"a template has {size} to {LENGTH} words: {text}")
        out.append((number, label, is_base, size, words))
    return out


def gram_table(spark: SparkSession, rows: list[tuple[int, str, bool, int, list[str]]], size: int) -> DataFrame:
    """Every gram of ``size`` words with its hash and its places: gram, hash, hits (template, place)."""
    places = [(" ".join(words[j : j + size]), number, j) for number, _, _, k, words in rows if k == size for j in range(len(words) - size + 1)]
    table = spark.createDataFrame(places, "gram string, template int, place int")
    hits = table.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("template", "place"))).alias(f"hits{size}"))
    return hits.select(F.col("gram").alias(f"gram{size}"), F.xxhash64(*[F.get(F.split("gram", " "), F.lit(i)) for i in range(size)]).alias(f"hash{size}"), f"hits{size}")


def lowered(text: Column) -> Column:
    """The text with A to Z in lower case. What lower() does to other letters can't make one of these words: the Kelvin sign,
    the only one whose lower case is a plain letter, is replaced before."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("å")))


def votes(docs: DataFrame, rows: list[tuple[int, str, bool, int, list[str]]]) -> DataFrame:
    """Matches of all grams: row (a number of the input row), doc_id, n_words, template, place and diagonal; one line of null
    template for every document.

    The gram tables depend on the templates alone (some 200 grams), so they are sent to every task and no text moves.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(lowered(text_of()), F.lit(WORD), F.lit(0))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    # one place more than words: its first word is null, and it stands for the document
    ended = F.concat("words", F.array(F.lit(None).cast("string")))
    follow = [F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(1, NOTICE)]
    grams = own.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.arrays_zip(ended.alias("w0"), *follow)).alias("at", "w"))
    grams = grams.select("row", "doc_id", "n_words", "at", *[F.col(f"w.w{i}").alias(f"w{i}") for i in range(NOTICE)])
    for size in (PHRASE, NOTICE):
        known = gram_table(spark, rows, size)
        gram = [f"w{i}" for i in range(size)]
        same = (F.xxhash64(*gram) == known[f"hash{size}"]) & (F.concat_ws(" ", *gram) == known[f"gram{size}"])
        grams = grams.join(F.broadcast(known), same, "left")  # a row per gram of the templates, whatever the data
    grams = grams.where(f"w0 IS NULL OR hits{PHRASE} IS NOT NULL OR hits{NOTICE} IS NOT NULL")
    none = F.array().cast("array<struct<template:int,place:int>>")
    found = grams.select("row", "doc_id", "n_words", "at", F.explode_outer(F.concat(*[F.coalesce(f"hits{k}", none) for k in (PHRASE, NOTICE)])).alias("hit"))
    return found.select("row", "doc_id", "n_words", F.col("hit.template").alias("template"), F.col("hit.place").alias("place"), (F.col("at") - F.col("hit.place")).cast("long").alias("diagonal"))


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Spans of every document, one line of null template for a document without any: row, doc_id, n_words, template, label,
    base, first_word, last_word (of the span) and share (of the template's words)."""
    rows = template_rows(templates, base)
    about = docs.sparkSession.createDataFrame([(n, label, is_base, k, len(words)) for n, label, is_base, k, words in rows], "template int, label string, base boolean, size int, length int")
    met = votes(docs, rows).repartition("row")  # matches of one document, never its words
    bit = F.expr("shiftleft(1L, place)")
    lines = met.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(
        F.bit_or(bit).alias("bits"), F.min(F.col("diagonal") + F.col("place")).alias("first"), F.max(F.col("diagonal") + F.col("place")).alias("last")
    )
    lines = lines.join(F.broadcast(about), "template", "left")  # a row per template
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(SLACK)
    lines = lines.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    merged = lines.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "length", "span").agg(
        F.bit_or("bits").alias("bits"), F.min("first").alias("first_word"), (F.max("last") + F.col("size") - 1).alias("last_word")
    )
    covered = F.expr(f"bit_count(bits | shiftleft(bits, 1) | if(size = {NOTICE}, shiftleft(bits, 2), 0L))")
    merged = merged.withColumn("share", covered / F.col("length"))
    long = F.col("last_word") - F.col("first_word") + 1 > F.ceil(F.col("length") * ROOM)
    holds = F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= SHARE) & ~long)
    good = F.coalesce(holds, F.lit(False))
    kept = merged.select("row", "doc_id", "n_words", *[F.when(good, F.col(c)).alias(c) for c in ("template", "label", "base", "first_word", "last_word", "share")])
    return kept


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Score is the largest share of a template's words that a verified span holds, 0 without one; a base phrase has 1. Null
    and empty texts have no words, no labels ('') and score 0. Ids are kept as they are, null and repeated ones too. A place
    of a phrase counts once however places overlap, a span of a template once a run of near diagonals. Columns other than
    doc_id and text are not read. An empty table gives no rows.
    """
    is_base = F.coalesce("base", F.lit(False))
    labels = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("label")))), ",")
    return spans(docs, templates, base).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(F.lit(True)).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def _oracle() -> str:
    rows = template_rows()
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ",\n    ".join(f"({n}, '{label}', {str(is_base).lower()}, {k}, {len(words)}, {quoted(words)})" for n, label, is_base, k, words in rows)
    return rf"""
WITH t(template, label, base, size, length, words) AS (VALUES
    {values}),
g AS (SELECT template, label, base, size, length, j, words[j + 1:j + size] AS gram FROM t, unnest(range(length - size + 1)) AS u(j)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (SELECT r, p, w[p + 1] AS w0, w[p + 2] AS w1, w[p + 3] AS w2 FROM d, unnest(range(len(w))) AS u(p)),
m AS (SELECT r, template, label, base, size, length, j, p, p - j AS diagonal FROM p JOIN g ON w0 = gram[1] AND w1 = gram[2] AND (size = 2 OR w2 = gram[3])),
c AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > CASE WHEN base THEN 0 ELSE {SLACK} END AS apart FROM m),
s AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM c),
e AS (SELECT DISTINCT r, template, span, j + u AS word FROM s, unnest(range(size)) AS x(u)),
n AS (SELECT r, template, span, count(*) AS covered FROM e GROUP BY ALL),
v AS (SELECT r, template, span, any_value(label) AS label, any_value(base) AS base, any_value(length) AS length,
        min(p) AS first_word, max(p) + any_value(size) - 1 AS last_word FROM s GROUP BY ALL),
k AS (SELECT v.*, covered / length AS share FROM v JOIN n USING (r, template, span)
      WHERE CASE WHEN base THEN covered = length ELSE covered / length >= {SHARE} AND last_word - first_word + 1 <= ceil(length * {ROOM}) END)
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  CAST(min(first_word) FILTER (base) AS BIGINT) AS first_word, CAST(max(first_word) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
