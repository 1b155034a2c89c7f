"""License scan: exact set-similarity join of text blocks with license templates.

A template is the words of a known license notice, a block a window of words twice as long
as the template; windows move by the template's length over the whole text, so a notice lies
whole in one of them however it is wrapped, and words further apart do not add up. A
template is found in a block when the block holds at least ``ceil(threshold * n)`` of the
template's ``n`` distinct words. The join is exact and uses the filters of prefix-filter joins:

* one global word order, rarest first, from the document counts of the
  template words over the whole table;
* prefix filter: a block must share a word with the first ``n - need + 1``
  words of the template within its own first ``m - need + 1`` words, where ``m``
  is the number of its words that occur in any template;
* length filter: ``m >= need``, first for the whole text (no block of it has more), then for
  the block;
* positional filter: the first shared word, at place ``i`` of the template and
  ``j`` of the block, leaves room for ``1 + min(n - i - 1, m - j - 1)`` shared words.

What passes is verified by its full overlap. The template side is a table of
stated size (``MAX_TEMPLATE_WORDS``), so it stands in the plan as literals and
the join runs in the scan stage: no shuffle, no row id, no Python.

Besides the templates, phrases of consecutive words give the base labels.
Null texts count as empty; repeated rows and ids, null ids and further columns
pass through unharmed: every input row gives one output row.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_WORDS = 2000

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Label, containment threshold, words of a public license notice.
TEMPLATES = [
    ("apache", 0.8, "licensed under the apache license version 2 0 the license you may not use this file except in "
                    "compliance with the license you may obtain a copy of the license at"),
    ("bsd", 0.8, "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met"),
    ("cc-by", 0.8, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", 1.0, "licensed under cc by nc"),
    ("cc-by-sa", 1.0, "licensed under cc by sa"),
    ("gpl", 0.8, "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                 "general public license as published by the free software foundation"),
    ("gpl-3", 1.0, "licensed under the gnu general public license version 3"),
    ("isc", 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee "
                 "is hereby granted"),
    ("mit", 0.8, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction"),
    ("mpl", 0.8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def words_of(text: Column) -> Column:
    """Words of a lower-cased text, in order."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, text_col: str, templates=TEMPLATES) -> list[str]:
    """All template words by ascending document count over the whole table (ties
    by word). The result is bounded by the templates."""
    vocabulary = sorted({w for _, _, t in templates for w in t.split()})
    check_broadcast(len(vocabulary), MAX_TEMPLATE_WORDS, "template words")
    seen = docs.select(F.explode(F.array_intersect(_strings(vocabulary), words_of(lowered(F.col(text_col))))).alias("w"))
    count = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _template_rows(order: list[str], templates) -> list[dict]:
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, threshold, text in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(round(threshold * len(words), 9))
        rows.append({"label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1], "length": len(text.split())})
    return rows


def _match(row: dict, block: Column) -> Column:
    """Containment of one template in a block (words in the global order); null if not found."""
    n, need = len(row["words"]), row["need"]
    words, prefix = _strings(row["words"]), _strings(row["prefix"])
    m = F.size(block)
    shared = F.array_intersect(F.slice(block, 1, F.greatest(m - need + 1, F.lit(0))), prefix)
    first = F.get(shared, F.lit(0))
    room = 1 + F.least(n - F.array_position(words, first), m - F.array_position(block, first))
    overlap = F.size(F.array_intersect(block, words))
    return F.when((m >= need) & (F.size(shared) > 0) & (room >= need) & (overlap >= need), overlap / F.lit(float(n)))


def containment_join(words: Column, known: Column, order: list[str], templates=TEMPLATES) -> Column:
    """Array of (block, label, containment) of all templates found in the blocks of a text:
    ``words`` are its words, ``known`` the template words among them, ``block`` is the first
    word of a block."""
    vocabulary = _strings(order)

    def found(row: dict) -> Column:
        n, prefix = row["length"], _strings(row["prefix"])
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(n))
        near = F.filter(F.transform(starts, lambda s: F.struct(s.cast("long").alias("block"), F.slice(words, s + 1, F.lit(2 * n)).alias("w"))),
                        lambda b: F.arrays_overlap(b["w"], prefix))
        # array_intersect keeps the order of its first argument: the global one
        blocks = F.transform(near, lambda b: F.struct(b["block"].alias("block"), F.array_intersect(vocabulary, b["w"]).alias("w")))
        hits = F.filter(F.transform(blocks, lambda b: F.struct(b["block"].alias("block"), F.lit(row["label"]).alias("label"), _match(row, b["w"]).alias("containment"))),
                        lambda x: x["containment"].isNotNull())
        enough = F.size(F.array_intersect(known, _strings(row["words"]))) >= row["need"]
        return F.when(enough, hits).otherwise(F.array().cast("array<struct<block:bigint,label:string,containment:double>>"))

    return F.concat(*[found(r) for r in _template_rows(order, templates)])


def phrase_places(words: Column, joined: Column, phrases=PHRASES) -> Column:
    """Array of (start, label) of every place where a phrase's words stand consecutively."""
    return F.concat(*[_places_of(words, joined, phrase, label) for phrase, label in phrases])


def _places_of(words: Column, joined: Column, phrase: str, label: str) -> Column:
    p = phrase.split()

    def stands_at(i):
        found = F.get(words, i) == p[0]
        for k, w in enumerate(p[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    places = F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(len(p))), stands_at),
                         lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
    # a text with the phrase has at least as many words as the phrase
    return F.when(joined.contains(f" {phrase} "), places).otherwise(
        F.array().cast("array<struct<start:bigint,label:string>>"))


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
         order: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its other columns, and ``n_words``,
    ``places`` (phrases), ``matches`` (templates: block, label, containment).

    Column names that clash with these are replaced by the scan's.
    """
    order = word_order(docs, text_col, templates) if order is None else order
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "places", "matches", "_low", "_words", "_joined", "_known")]
    low = docs.select(*[F.col(f"`{c}`") for c in kept], lowered(F.col(f"`{text_col}`")).alias("_low"))
    words = low.select(*kept_cols(kept), "_low", words_of(F.col("_low")).alias("_words"))
    joined = words.select(*kept_cols(kept), "_words", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_joined"),
                          F.array_intersect(_strings(order), "_words").alias("_known"))
    return joined.select(
        *kept_cols(kept), F.size("_words").cast("long").alias("n_words"),
        phrase_places(F.col("_words"), F.col("_joined"), phrases).alias("places"),
        containment_join(F.col("_words"), F.col("_known"), order, templates).alias("matches"))


def kept_cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    more = F.transform("matches", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda x: x["label"]), more))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle(templates=TEMPLATES, phrases=PHRASES) -> str:
    """DuckDB SQL for ``digest(scan(documents))``, by plain overlap counts."""
    rows = ",\n    ".join(f"('{label}', {threshold}, {len(text.split())}, {_quoted(sorted(set(text.split())))})" for label, threshold, text in templates)
    lists = ",\n    ".join(f"('{label}', {_quoted(p.split())})" for p, label in phrases)
    return f"""
WITH templates(label, threshold, n, words) AS (VALUES
    {rows}),
phrases(label, words) AS (VALUES
    {lists}),
docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
worded AS (SELECT r, doc_id, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs),
places AS (
  SELECT r, i AS start, label FROM (
    SELECT r, label, w, words, unnest(range(0, len(w) - len(words) + 1)) AS i FROM worded, phrases)
  WHERE w[i + 1 : i + len(words)] = words),
blocks AS (SELECT r, label, threshold, words, list_distinct(list_slice(w, s + 1, s + 2 * n)) AS w
  FROM (SELECT r, label, threshold, n, words, w, unnest(range(0, len(w), n)) AS s FROM worded, templates)),
matches AS (
  SELECT r, label, len(list_intersect(w, words))::DOUBLE / len(words) AS containment
  FROM blocks WHERE len(list_intersect(w, words)) >= ceil(round(threshold * len(words), 9))),
p AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS base FROM places GROUP BY r),
m AS (SELECT r, max(containment) AS best FROM matches GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM matches) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN p USING (r) LEFT JOIN m USING (r) LEFT JOIN a USING (r)
"""
