"""License scan with DataFrame functions only: phrase places, and an exact set-similarity join of text
blocks with license templates.

A block is a line of the text, or a window of words that spans several lines; a template is the token set
of a known license notice. A block matches a template when it holds at least ``threshold`` of the
template's distinct tokens (containment); a window does so only where none of its lines does it alone.
The windows are SLACK words longer than the longest template and overlap, so a notice wrapped over any
number of lines lies in one. A text whose tokens, all together, meet no template has no block that does,
and is not cut into blocks. The join is the prefix-filtered one: the templates' tokens are put in order of their frequency over all
blocks, rarest first; with a required overlap of a = ceil(threshold * |T|), a matching block must hold
one of the first |T| - a + 1 tokens of T, and have one of its own first |B| - a + 1 tokens in common,
so only these prefixes are joined; the length filter asks |B| >= a, the positional filter bounds the
overlap still possible behind the meeting token, and what is left is verified exactly. Tokens that no
template holds can never add to an overlap, so B is the block's tokens among the templates' ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import write_stage

SLACK = 8                   # words among a wrapped notice's own, such as the signs of comment lines
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public license notices.
TEMPLATES = {
    "agpl-notice": "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "Released under the MIT License",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def template_tokens(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Distinct tokens of each template, by the rule that splits the texts."""
    return {k: sorted({w for w in re.split(NOT_WORD, v.lower()) if w}) for k, v in templates.items()}


def normal_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def phrase_places(words: Column, phrases: Mapping[str, str]) -> Column:
    """Array of (at, label): every word position where a phrase's words stand in a row."""
    firsts = {p.split(" ")[0] for p in phrases}
    start = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*firsts), i)), lambda i: i.isNotNull())
    def of(phrase: str, label: str) -> Column:
        wanted = F.array(*[F.lit(w) for w in phrase.split(" ")])
        found = F.filter(start, lambda i: F.slice(words, i + 1, phrase.count(" ") + 1) == wanted)
        return F.transform(found, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(p, label) for p, label in phrases.items()])


def template_span(templates: Mapping[str, str]) -> int:
    """Words that a wrapped notice takes at most: those of the longest template, and SLACK."""
    return max(len([w for w in re.split(NOT_WORD, v.lower()) if w]) for v in templates.values()) + SLACK


def candidates_of(docs: DataFrame, key: str, text_col: str, tokens: Mapping[str, list[str]], need: Mapping[str, int]) -> DataFrame:
    """(key, text) of the texts that hold enough tokens of some template, wherever they stand; one row of a key."""
    vocabulary = sorted({w for t in tokens.values() for w in t})
    held = docs.select(F.col(key), F.col(text_col).alias("text"), F.array_intersect(normal_words(F.col(text_col)), F.array(*map(F.lit, vocabulary))).alias("held"))
    enough = F.lit(False)
    for k, t in tokens.items():
        enough |= F.size(F.array_intersect("held", F.array(*map(F.lit, t)))) >= need[k]
    return held.where(F.size("held") >= min(need.values())).where(enough).select(key, "text").dropDuplicates([key])


def blocks_of(docs: DataFrame, key: str, text_col: str, vocabulary: list[str], span: int) -> DataFrame:
    """(key, block, window, toks, parts): the distinct tokens among ``vocabulary`` of each line, and of each
    window of words on several lines, with those of its lines (whole ones) as ``parts``. ``span`` + 1 words
    in a row, or fewer, always lie in one window, or on one line. Blocks without a token are left out."""
    step = max(1, span // 2)
    known = F.array(*map(F.lit, vocabulary))
    lines = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), r"[\n\r]+")
    rows = docs.select(key, F.transform(lines, lambda x: F.filter(F.split(x, NOT_WORD), lambda w: w != "")).alias("lines"))
    rows = rows.select(key, F.transform("lines", lambda x: F.array_intersect(x, known)).alias("of_line"),
                       F.flatten(F.transform("lines", lambda x, i: F.transform(x, lambda w: F.struct(w.alias("w"), i.alias("line"))))).alias("words"))
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    windows = F.transform(at, lambda i: F.slice("words", i + 1, span + step))
    blocks = F.concat(
        F.transform("of_line", lambda t, i: F.struct(i.alias("block"), F.lit(False).alias("window"), t.alias("toks"),
                                                     F.array().cast("array<array<string>>").alias("parts"))),
        F.transform(F.filter(F.transform(windows, lambda v, i: F.struct(i.alias("block"), v.alias("v"))),
                             lambda x: (F.size(x["v"]) > 0) & (F.element_at(x["v"], 1)["line"] < F.element_at(x["v"], -1)["line"])),
                    lambda x: F.struct(x["block"].alias("block"), F.lit(True).alias("window"), F.array_intersect(x["v"]["w"], known).alias("toks"),
                                       F.transform(F.array_distinct(x["v"]["line"]), lambda i: F.get("of_line", i)).alias("parts"))))
    return rows.select(key, F.explode(blocks).alias("b")).select(key, "b.*").where(F.size("toks") > 0)


def template_matches(docs: DataFrame, key: str, text_col: str, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(key, block, window, template, containment) of every block and template meeting ``threshold``. Rows
    of one key have one text."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    tokens = template_tokens(templates)
    vocabulary = sorted({w for t in tokens.values() for w in t})
    need = {k: math.ceil(threshold * len(t) - 1e-9) for k, t in tokens.items()}
    least = min(need.values())
    texts = write_stage(candidates_of(docs, key, text_col, tokens, need), "license-texts")
    blocks = blocks_of(texts, key, "text", vocabulary, template_span(templates)).where(F.size("toks") >= least)     # length filter
    # one row per template token, counted over all blocks
    seen = {r["tok"]: r["n"] for r in blocks.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefix = []
    for name, toks in tokens.items():
        by = sorted(toks, key=place.get)
        prefix += [(w, name, i, len(by), need[name], by) for i, w in enumerate(by[:len(by) - need[name] + 1])]
    table = docs.sparkSession.createDataFrame(prefix, "tok string, template string, i int, size int, need int, tokens array<string>")
    in_order = blocks.select(key, "block", "window", "parts", F.array_intersect(F.array(*map(F.lit, order)), "toks").alias("toks"))
    # the block's own prefix, for the least overlap that any template asks
    entry = in_order.select(key, "block", "window", "parts", "toks", F.posexplode(F.slice("toks", F.lit(1), F.size("toks") - least + 1)).alias("j", "tok"))
    held = F.size("toks")
    # at most one row per template and prefix token: bounded by the templates, whatever the documents
    met = entry.join(F.broadcast(table), "tok").where(
        (held >= F.col("need")) & (F.col("j") <= held - F.col("need"))
        & (F.col("need") <= F.least(F.col("size") - F.col("i"), held - F.col("j")) + F.least(F.col("i"), F.col("j"))))
    overlap = F.size(F.array_intersect("toks", "tokens"))
    alone = F.exists("parts", lambda t: F.size(F.array_intersect(t, F.col("tokens"))) >= F.col("need"))
    return (met.withColumn("overlap", overlap).where("overlap >= need").where(~alone)
            .select(key, "block", "window", "template", (F.col("overlap") / F.col("size")).alias("containment")).distinct())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
                 templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_blocks (lines that match a template, and runs of neighbouring windows that do).

    score is 1 where a phrase stands, else the best containment that meets the threshold, else 0. A
    null text is empty; repeated rows, also of one id, each return a row with its own text's labels;
    an empty table returns none; other columns are not read.
    """
    words = normal_words(F.col("text"))
    key = F.xxhash64("text")                             # matches are gathered by text, so copies are looked up once
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hint = "|".join(p.replace(" ", NOT_WORD) for p in phrases)
    places = F.when(F.translate("text", UPPER, LOWER).rlike(hint), phrase_places(F.col("words"), phrases))
    base = (rows.withColumn("words", words).withColumn("places", places)
            .select("doc_id", key.alias("k"), F.length("text").alias("k2"), F.size("words").cast("long").alias("n_words"), "places"))
    found = template_matches(rows.select("text", F.struct(key.alias("k"), F.length("text").alias("k2")).alias("key")), "key", "text", templates, threshold)
    by_text = found.groupBy("key").agg(F.collect_set("template").alias("more"), F.max("containment").alias("best"),
                                       F.collect_set(F.when(~F.col("window"), F.col("block"))).alias("lines"),
                                       F.collect_set(F.when(F.col("window"), F.col("block"))).alias("windows"))
    # a wrapped notice lies in neighbouring windows too: they count once
    by_text = by_text.withColumn("n_blocks", F.size("lines") + F.size(F.array_except("windows", F.transform("windows", lambda i: i + 1))))
    out = base.join(by_text.select("key.k", "key.k2", "more", "best", "n_blocks"), ["k", "k2"], "left")
    at, labels = F.transform("places", lambda p: p["at"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    none = F.array().cast("array<string>")
    n = F.coalesce(F.size("places"), F.lit(0))
    n = F.when(F.col("places").isNull(), F.lit(0)).otherwise(n).cast("long")
    own = F.coalesce(labels, none)
    return out.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
