"""Licence notices by an exact set-similarity join of text blocks with templates, in DataFrame operations alone."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words: runs of lower-cased ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Wording of common licence notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def step_of(n_words: int) -> int:
    """Blocks for a template of n words begin at every such word and are twice as long: each run of n words lies whole in a block."""
    return 1 << max(0, math.ceil(math.log2(max(1, n_words))))


def _rows(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """A small table of constants (the templates' words), written into the plan."""
    made = F.array(*[F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in r.items()]) for r in rows])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def phrase_places(words: str, phrase: str) -> Column:
    """Starts (words from 0) of the places where the phrase's words stand one after the other."""
    parts = _words(phrase)
    last = F.size(words) - len(parts)
    here = lambda i: reduce(and_, [F.get(F.col(words), i + j) == F.lit(p) for j, p in enumerate(parts)])
    fits = (last >= 0) & F.array_contains(words, parts[-1])
    return F.when(fits, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def matching_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block of every text that holds at least ``threshold`` of a template's distinct words: (doc_id, text_hash, template, label, first_word, end_word, containment).

    ``docs``: doc_id (any type), words (array of the whole text's words), text_hash. Blocks begin at every S-th word and are 2 S long, S being the smallest power of
    two not below the template's number of words; templates of one S share their blocks. Equal rows give their matches once.

    Words are ordered by the number of documents that hold them, rarest first. A template that needs a of its t words shares one of its first
    t - a + 1 with every block that matches (prefix filter), and so does a block of b template words with its first b - a + 1; blocks of fewer than a
    template words go (length filter), and so do pairs whose places leave too few words behind them (positional filter). What is left is intersected.
    Documents without any prefix word are never cut into blocks. The driver holds the templates' words and their counts only.
    """
    spark = docs.sparkSession
    parsed = [(n, label, len(_words(text)), sorted(set(_words(text)))) for n, (label, text) in enumerate(templates)]
    parsed = [x for x in parsed if x[3]]
    if not parsed:
        return docs.select("doc_id", "text_hash", *[F.lit(v).alias(c) for c, v in (("template", 0), ("label", ""), ("first_word", 0), ("end_word", 0), ("containment", 0.0))]).limit(0)
    vocabulary = sorted({w for x in parsed for w in x[3]})
    known = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in counts.collect()}  # at most the templates' words
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    made, prefix, by_step = [], [], {}
    for n, label, length, words in parsed:
        order, need, step = sorted(rank[w] for w in words), max(1, math.ceil(threshold * len(words) - 1e-9)), step_of(length)
        made.append({"template": n, "label": label, "t_step": step, "need": need, "order": order})
        prefix += [{"p_step": step, "p_rank": r, "p_place": i, "p_template": n} for i, r in enumerate(order[: len(order) - need + 1])]
        least, members = by_step.get(step, (need, set()))
        by_step[step] = (min(least, need), members | set(order))
    rare = sorted({x["p_rank"] for x in prefix})
    word_at = {r: w for w, r in rank.items()}
    spots = _rows(spark, [{"v_word": word_at[r], "rank": r, "step": step, "least": least} for step, (least, members) in sorted(by_step.items()) for r in sorted(members)])
    candidates = docs.filter(F.arrays_overlap("words", F.array(*[F.lit(word_at[r]) for r in rare])))
    placed = candidates.select("doc_id", "text_hash", F.posexplode("words").alias("at", "word")).join(F.broadcast(spots), F.col("word") == F.col("v_word"))
    at = F.expr("at div step").cast("int")
    blocks = placed.select("doc_id", "text_hash", "step", "least", "rank", F.explode(F.when(at > 0, F.array(at - 1, at)).otherwise(F.array(at))).alias("block"))
    # A group is one block of one text: at most 2 S words.
    blocks = blocks.groupBy("doc_id", "text_hash", "step", "least", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    blocks = blocks.withColumn("size", F.size("ranks")).filter("size >= least")
    heads = blocks.select("*", F.posexplode(F.expr("slice(ranks, 1, size - least + 1)")).alias("place", "head"))
    pairs = heads.join(F.broadcast(_rows(spark, prefix)), (F.col("step") == F.col("p_step")) & (F.col("head") == F.col("p_rank")))
    pairs = pairs.join(F.broadcast(_rows(spark, made)), F.col("p_template") == F.col("template"))
    pairs = pairs.filter((F.col("place") <= F.col("size") - F.col("need")) & (F.least(F.size("order") - F.col("p_place"), F.col("size") - F.col("place")) >= F.col("need")))
    held = F.size(F.array_intersect("ranks", "order"))
    pairs = pairs.withColumn("held", held).filter("held >= need")
    first = (F.col("block").cast("long") * F.col("step")).alias("first_word")
    return pairs.select("doc_id", "text_hash", "template", "label", first, (first + 2 * F.col("step")).alias("end_word"), (F.col("held") / F.size("order")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs`` (doc_id, text; further columns are ignored).

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (words from 0; null without any), base_labels their
    labels. labels has those and the labels of all templates that a block of the text holds; both are distinct, sorted and comma-joined, empty if there
    are none. score is 1 with a phrase, else the largest containment that was found, else 0. A null text is empty; rows that repeat, also with one
    id and several texts or a null id, each have a result of their own. Matches are joined back by id and hash of the text.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("words"))
    places = [phrase_places("words", phrase) for phrase, _ in phrases]
    base = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.array(*places).alias("places"))
    found = [F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    starts = F.flatten("places")
    base = base.select(
        "doc_id", "text_hash", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*found))).alias("own"),
    )
    hits = matching_blocks(rows, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    hits = hits.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "more", "best")
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    every = F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The same over the table ``documents``, every block compared with every template of its length."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parsed = [(label, step_of(len(_words(text))), sorted(set(_words(text)))) for label, text in templates]
    listed = ", ".join(f"({quote(label)}, {step}, [{', '.join(map(quote, words))}], {max(1, math.ceil(threshold * len(words) - 1e-9))})" for label, step, words in parsed)
    phrased = ", ".join(f"([{', '.join(map(quote, _words(p)))}], {quote(label)})" for p, label in phrases)
    return rf"""
    WITH w AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    t(label, step, words, need) AS (VALUES {listed}),
    p(phrase, label) AS (VALUES {phrased}),
    places AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM w WHERE list_contains(w, 'license')) JOIN p ON w[i + 1 : i + len(phrase)] = phrase),
    base AS (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, list(DISTINCT label) AS labels FROM places GROUP BY r),
    steps AS (SELECT step, list_distinct(flatten(list(words))) AS v FROM t GROUP BY step),
    b AS (SELECT r, s.step, list_intersect(w[k * s.step + 1 : (k + 2) * s.step], s.v) AS x FROM w, steps s, unnest(range(len(w) // s.step + 1)) AS u(k)),
    m AS (SELECT r, label, len(list_intersect(x, words)) AS held, need, len(words) AS n FROM b JOIN t ON t.step = b.step WHERE len(x) >= need),
    hits AS (SELECT r, list(DISTINCT label) AS labels, max(held / n) AS best FROM m WHERE held >= need GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, base.low AS first_word, base.high AS last_word,
      coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hits.labels, [])))), ','), '') AS labels,
      CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(hits.best, 0) END AS score
    FROM w LEFT JOIN base ON base.r = w.r LEFT JOIN hits ON hits.r = w.r
    """
