"""License scans by an exact set-similarity join.

Text blocks are windows of ``block`` words, one every ``stride`` words, so
any run of ``block - stride`` words lies whole in one of them.  A template is
a set of words; a block matches it when it holds at least ``threshold`` of
the template's words, among them all that tell the license: what two licenses'
notices have in common labels neither.

Words are ranked by their count over all documents, rarest first.  A template
that needs ``need`` of its ``size`` words shares, with every block that
matches it, one of its ``size - need + 1`` rarest words, and that word is
among the block's own first words up to the same bound (prefix filter); the
block holds ``need`` template words (length filter); and beyond the first
shared word enough words are left on both sides (positional filter).  Pairs
that pass are verified by their whole intersection.  Only DataFrame functions
are used.  The templates are a fixed, small parameter, so their index is a
bounded broadcast.

Defined results: null text counts as empty (no words, score 0, empty labels).
A text of any length is scanned whole.  Repeated rows each get their row.  An
empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import ascii_lower, row_key, whole_text

# Fixed values of the contract: word pattern (after lower-casing A-Z), phrases
# and labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]

# Notices by which licenses are declared, in their usual words,
# and the words that tell the license, all of which a match must hold.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "you may not use this file except in compliance with the License", "use file compliance license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission granted charge copy software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "redistribute general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License", "affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution source binary permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", "permission copy modify distribute software purpose"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited", "unauthorized copying prohibited"),
]

# The same words in text of either case.  The class lists its characters one
# by one: Java looks those up in a table, but walks ranges for every character.
NO_WORD = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD_ANY_CASE = f"[^{NO_WORD}]++"


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order (templates are ASCII)."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(words))


def word_ranks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, rank) of the vocabulary, rarest over all documents first."""
    spark = docs.sparkSession
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    seen = docs.select(F.explode(F.regexp_extract_all(whole_text(), F.lit(WORD_ANY_CASE), F.lit(0))).alias("any")).select(F.lower("any").alias("word"))
    counts = seen.join(F.broadcast(words), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = {r["word"]: r["n"] for r in counts.collect()}  # at most the templates' words
    order = sorted(vocabulary, key=lambda w: (ranked.get(w, 0), w))
    return spark.createDataFrame([(w, i) for i, w in enumerate(order)], "word string, rank int")


def phrase_starts(words: Column) -> Column:
    """Places of every phrase as structs (at, label), from an array of words."""
    def at(i):
        hit = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            hit = F.when(sum((F.get(words, i + k).eqNullSafe(F.lit(w)).cast("int") for k, w in enumerate(phrase)), F.lit(0)) == len(phrase), label).otherwise(hit)
        return F.struct(i.alias("at"), hit.alias("label"))
    n = F.size(words)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, at), lambda p: p["label"].isNotNull())


def matched_labels(docs: DataFrame, threshold_pct: int, block: int, stride: int) -> DataFrame:
    """(doc_id, rk, method_labels, containment) of the rows with a block that matches."""
    spark = docs.sparkSession
    sets = [(label, template_words(text), template_words(must)) for label, text, must in TEMPLATES]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    ranks = {r["word"]: r["rank"] for r in word_ranks(docs, vocabulary).collect()}
    index, needs = [], []
    for label, ws, must in sets:
        ids, need = sorted(ranks[w] for w in ws), -(-threshold_pct * len(ws) // 100)
        needs.append(need)
        index += [(ids[p], p, label, need, ids, [ranks[w] for w in must]) for p in range(len(ids) - need + 1)]
    by_rank = sorted(ranks, key=ranks.get)
    prefix_words = [by_rank[w] for w in sorted({row[0] for row in index})]
    table = spark.createDataFrame(index, "word int, t_at int, label string, need int, t_words array<int>, must array<int>")
    # the prefix filter over whole texts: no block matches without such a word
    gate = f"(?i)(?<![^{NO_WORD}])(?:{'|'.join(prefix_words)})(?![^{NO_WORD}])"
    words = docs.filter(whole_text().rlike(gate)).select("doc_id", row_key().alias("rk"), F.regexp_extract_all(ascii_lower(whole_text()), F.lit(WORD_ANY_CASE), F.lit(0)).alias("words"))
    last = F.greatest(F.ceil((F.size("words") - (block - stride)) / stride), F.lit(1)).cast("int") - 1
    blocks = words.select("doc_id", "rk", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k * stride + 1, block))).alias("block"))
    # a block's template words as ranks, ascending: words of no template share nothing
    known = F.array(*[F.lit(w) for w in vocabulary])
    to_rank = F.array(*[F.lit(ranks[w]) for w in vocabulary])
    ids = F.array_sort(F.transform(F.array_intersect("block", known), lambda w: F.get(to_rank, F.array_position(known, w).cast("int") - 1)))
    held = blocks.select("doc_id", "rk", ids.alias("b_words")).filter(F.size("b_words") >= min(needs))
    prefix = F.slice("b_words", F.lit(1), F.size("b_words") - min(needs) + 1)
    shared = held.select("doc_id", "rk", "b_words", F.posexplode(prefix).alias("b_at", "word")).join(F.broadcast(table), "word")
    left = F.least(F.size("t_words") - F.col("t_at"), F.size("b_words") - F.col("b_at"))
    passed = shared.filter((F.size("b_words") >= F.col("need")) & (F.col("b_at") <= F.size("b_words") - F.col("need")) & (left >= F.col("need")))
    both = F.size(F.array_intersect("b_words", "t_words"))
    verified = passed.withColumn("both", both).filter((F.col("both") >= F.col("need")) & (F.size(F.array_except("must", "b_words")) == 0))
    return verified.groupBy("doc_id", "rk").agg(F.collect_set("label").alias("method_labels"), F.max(F.col("both") / F.size("t_words")).alias("containment"))


def license_scan(docs: DataFrame, threshold_pct: int = 80, block: int = 48, stride: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, containment."""
    text = whole_text()
    lowered = F.when(text.rlike("(?i)license"), ascii_lower(text)).otherwise(F.lit(""))  # every phrase ends in that word
    words = F.regexp_extract_all(lowered, F.lit(WORD_ANY_CASE), F.lit(0))
    per_row = docs.select("doc_id", row_key().alias("rk"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
                          F.transform(F.array(words), phrase_starts)[0].alias("places"))
    method = matched_labels(docs, threshold_pct, block, stride).withColumnsRenamed({"doc_id": "m_doc_id", "rk": "m_rk"})
    joined = per_row.join(method, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("rk") == F.col("m_rk")), "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_union(base, F.coalesce("method_labels", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"))
