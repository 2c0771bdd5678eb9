"""License scans as an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

Tokens are ordered by how many documents hold them (rarest first, over all documents). A template T is contained in a block B if
|T and B| >= c = ceil(threshold * |T|). Then B holds one of the first |T| - c + 1 tokens of T in that order (prefix filter), at least
c tokens of the templates' vocabulary (length filter), and after the first shared token both sides still have enough tokens left
(positional filter). Blocks are windows of ``BLOCK`` words that overlap by ``STRIDE``, so every passage of up to ``STRIDE`` words
lies whole in one of them. Candidates are confirmed on the full token sets; the filters lose nothing.

Token counts and candidates come from all documents. Only the templates' vocabulary (a few hundred constant words) is collected or
broadcast; texts are never shuffled, candidates are joined and confirmed inside the scan's tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm.registry import query, table

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of widely used notices (public licence texts), by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8
BLOCK, STRIDE = 96, 48

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _SEPARATORS), lambda w: w != "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(line: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase in a line of words (a space before and after each), first and last word position."""
    needle = f" {phrase} "
    first = F.instr(line, needle)
    last = F.instr(F.reverse(line), needle[::-1])  # characters after the last place, and one
    # neighbouring places share a space, so the last space is only looked at
    count = F.when(first > 0, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(0)
    at_first = F.when(first > 0, _spaces(F.substring(line, F.lit(1), first)) - 1)
    at_last = F.when(first > 0, _spaces(F.substring(line, F.lit(1), F.length(line) - last - F.lit(len(needle) - 2))) - 1)
    return count, at_first, at_last


def vocabulary(templates: Iterable[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def token_order(words: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' vocabulary, rarest first by the number of documents that hold a token; ties by the token."""
    tokens = vocabulary(templates)
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, tokens)))).alias("token"))
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def contained_templates(words: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, block, label, template, containment) of every block that contains at least `threshold` of a template's token set.

    words: the key columns and `words`, an array of strings. block is the position of the block's first word. Repeated rows are each
    reported; no rows give none.
    """
    spark = words.sparkSession
    order = token_order(words, templates)
    rank = {t: i for i, t in enumerate(order)}
    index, sets = [], []
    for number, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        sets.append((number, label, own, need))
        index += [(own[i], number, i, len(own), need) for i in range(len(own) - need + 1)]
    prefix_words = F.array(*map(F.lit, sorted({t for t, *_ in index}, key=rank.__getitem__)))
    in_order = F.array(*map(F.lit, order))
    prefixes = spark.createDataFrame(index, "token string, template int, position int, template_size int, need int")
    full = spark.createDataFrame(sets, "template int, label string, tokens array<string>, need int").drop("need")

    smallest = min(need for *_, need in sets)
    starts = F.expr(f"sequence(0, greatest(0, size(words) - {BLOCK - STRIDE} - 1), {STRIDE})")
    blocks = (
        # documents without any prefix token cannot hold a candidate
        words.filter(F.arrays_overlap("words", prefix_words))
        .select(*keys, "words", F.explode(starts).alias("block"))
        .select(*keys, "block", F.slice("words", F.col("block") + 1, BLOCK).alias("block_words"))
        .filter(F.arrays_overlap("block_words", prefix_words))
        .select(*keys, "block", F.array_intersect(in_order, "block_words").alias("held"))  # distinct, in the global order
        .filter(F.size("held") >= smallest)
    )
    probes = blocks.select(*keys, "block", "held", F.size("held").alias("size"), F.posexplode("held").alias("at", "token"))
    found = (
        probes.join(F.broadcast(prefixes), "token")  # constant: the templates' prefixes
        # at the first shared token, neither side may have too few tokens left
        .filter(F.least(F.col("size") - F.col("at"), F.col("template_size") - F.col("position")) >= F.col("need"))
        .join(F.broadcast(full), "template")  # constant: the templates
        .withColumn("shared", F.array_intersect("tokens", "held"))
        # each pair is confirmed once, at its first shared token
        .filter((F.size("shared") >= F.col("need")) & (F.col("shared")[0] == F.col("token")))
    )
    return found.select(*keys, "block", "label", "template", (F.size("shared") / F.col("template_size")).alias("containment"))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row per document: word count, places of the phrases, labels of phrases and of contained templates, and a score.

    documents: doc_id, text; other columns are ignored. score is 1 with a phrase, else the greatest containment that met the threshold,
    else 0. Null text is empty; repeated rows are scanned alike; no rows give no rows.
    """
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    places = {p: phrase_places(F.col("line"), p) for p in PHRASES}
    base = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).select(
        "doc_id",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        sum((c for c, _, _ in places.values()), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.array(*[a for _, a, _ in places.values()])).cast("long").alias("first_word"),
        F.array_max(F.array(*[b for _, _, b in places.values()])).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(a.isNotNull(), F.lit(PHRASES[p])) for p, (_, a, _) in places.items()])).alias("phrase_labels"),
    )
    found = (
        contained_templates(rows, ["doc_id", "text_key"])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("label").alias("block_labels"), F.max("containment").alias("best"))  # at most one label per template
        .select(F.col("doc_id").alias("found_doc"), F.col("text_key").alias("found_key"), "block_labels", "best")
    )
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("found_doc")) & (F.col("text_key") == F.col("found_key")), "left")
    no_labels = F.array().cast("array<string>")
    listed = F.array_union("phrase_labels", F.coalesce("block_labels", no_labels))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("phrase_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(listed), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _places_sql(phrase: str) -> str:
    own = phrase.split()
    return f"list_transform(list_filter(range(1, len(w) - {len(own) - 2}), lambda i: w[i:i + {len(own) - 1}] = {own!r}), lambda i: i - 1)"


_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT *, {", ".join(f"{_places_sql(p)} AS at_{i}" for i, p in enumerate(PHRASES))} FROM d
), t AS (
    SELECT label, list_distinct(string_split(template, ' ')) AS tokens FROM (VALUES {", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)}) AS v(label, template)
), k AS (
    SELECT doc_id, list_distinct(w[s + 1:s + {BLOCK}]) AS block FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {BLOCK - STRIDE + 1}) + 1, {STRIDE})) AS s FROM d)
), c AS (
    SELECT doc_id, label, len(list_intersect(block, tokens)) AS n, len(tokens) AS size FROM k, t
), f AS (
    SELECT doc_id, list_distinct(list(label)) AS found, max(n / size) AS best FROM c WHERE 100 * n >= {round(100 * THRESHOLD)} * size GROUP BY doc_id
), r AS (
    SELECT *, list_concat(at_0, at_1, at_2) AS places,
        list_filter([{", ".join(f"CASE WHEN len(at_{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS own
    FROM b LEFT JOIN f USING (doc_id)
)
SELECT doc_id, len(w) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(list_sort(own), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(own, coalesce(found, [])))), ',') AS labels,
    CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM r
"""


@query("op8_license_scan", _SQL)
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
