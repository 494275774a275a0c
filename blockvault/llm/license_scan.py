"""License scans in DataFrame operations alone: an exact set-similarity join with templates of licenses.

Base labels come from phrases whose words stand consecutively.  Beside them, every block of text (a paragraph,
or, where a text has no blank lines, a line; and each of them together with those that a template which begins in it
may go on over) is joined with the templates: the words of templates are ordered by how many blocks of the whole input that may
match hold them, the rarest first, and a block is compared with a template only
if it has enough words (length filter), shares a word of both prefixes (prefix filter), and enough words can
follow the first one that they share (positional filter).  What passes is verified by its whole overlap, so
all blocks that hold the threshold's share of a template's words are found.  Only words of templates can
count, so blocks keep those alone; templates are constants of a fixed, small size.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: A phrase's words stand consecutively: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by label, from the public texts of the licenses: fixed values.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies""",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
}
#: Templates that stand for another label.
SAME = {"gpl-line": "gpl"}
#: Licenses whose notices share most of their words.
RELATED = ("gpl", "gpl-line", "lgpl", "agpl")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of a text, each followed and preceded by one space; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, _UPPER, _LOWER), F.lit(" ")), _BETWEEN, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _words_of(template: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in template.lower()).split()


def _base(rows: DataFrame) -> DataFrame:
    """Counts, places and labels of the phrases in whole texts (column ``_plain``: as ``plain`` gives it)."""
    text = F.col("_plain")
    number, first, last, labels = [], [], [], []
    some = text.contains(" license ")
    for phrase, label in PHRASES.items():
        n = len(phrase.split())
        # Neighbouring places share a space, so the last one of a match is left for the next.
        times = F.when(some, F.regexp_count(text, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
        head = F.substring_index(text, f" {phrase} ", 1)
        tail = F.substring_index(text, f" {phrase} ", -1)
        number.append(times)
        first.append(F.when(times > 0, _spaces(head)))
        last.append(F.when(times > 0, F.col("n_words") - n - _spaces(tail)))
        labels.append(F.when(times > 0, F.lit(label)))
    return rows.withColumn("n_words", F.greatest(_spaces(text) - 1, F.lit(0).cast("long"))).withColumns(
        {
            "n_base": sum(number[1:], number[0]),
            "first_word": F.least(*first),
            "last_word": F.greatest(*last),
            "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
        }
    )


def _held(plain_text: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(F.split(plain_text, " "), F.array(*[F.lit(w) for w in vocabulary]))


def _blocks(texts: DataFrame, vocabulary: list[str], span: int) -> DataFrame:
    """A row for each block of the texts: key, first and last place of the block, its distinct words of templates.

    The parts of a text are its paragraphs, or its lines if no line is blank.  Each is a block, and another one goes on
    over the parts where ``span`` words from its last one end.
    """
    text, blank = F.col("_text"), r"\n[ \t\r]*\n"
    split = lambda df, by: df.select("_id", "_hash", F.posexplode(F.split(text, by)).alias("_block", "_part"))
    parts = split(texts.filter(text.rlike(blank)), blank).union(split(texts.filter(~text.rlike(blank)), r"\n"))
    parts = parts.withColumn("_plain", plain(F.col("_part"))).withColumn("_words", _held(F.col("_plain"), vocabulary))
    # A part counts as span words at most, so that those after a long one are reached from it.
    number = F.least(F.greatest(_spaces(F.col("_plain")) - 1, F.lit(0).cast("long")), F.lit(span))
    own = Window.partitionBy("_id", "_hash")
    parts = parts.withColumn("_number", number).drop("_plain", "_part").withColumn("_begin", F.sum("_number").over(own.orderBy("_block")) - F.col("_number"))
    after = own.orderBy("_begin").rangeBetween(0, 2 * span)
    parts = parts.withColumns({"_until": F.max("_block").over(after), "_more": F.array_distinct(F.flatten(F.collect_list("_words").over(after)))})
    alone = F.struct(F.col("_block").alias("_until"), F.col("_words"))
    wider = F.struct(F.col("_until"), F.col("_more").alias("_words"))
    found = F.when(F.col("_until") > F.col("_block"), F.array(alone, wider)).otherwise(F.array(alone))
    return parts.select("_id", "_hash", "_block", F.inline(found))


def license_scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    matches, an array of (block, template, overlap, containment); a block of several lines has its first one's place.

    Labels are distinct, sorted and joined by commas; without any they are empty texts.  score is the largest
    containment found, 1 where a phrase stands, else 0.  A null text counts as empty and has no words.  Rows
    that repeat id and text have the same result each; an empty table gives an empty result; other columns
    are not read.
    """
    spark = df.sparkSession
    span = max((len(_words_of(text)) for text in templates.values()), default=1)
    sets = {name: list(dict.fromkeys(_words_of(text))) for name, text in templates.items()}
    need = {name: max(1, math.ceil(threshold * len(words) - 1e-9)) for name, words in sets.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    # One pass over the texts: only those that as a whole hold enough words of a template go on, as no block of a text
    # holds more than it does.
    seen = _base(rows.withColumn("_plain", plain(F.col("_text")))).withColumn("_words", _held(F.col("_plain"), vocabulary))
    able = reduce(or_, [F.size(F.array_intersect("_words", F.array(*map(F.lit, sets[n])))) >= need[n] for n in sets])
    base = cut(seen.withColumn("_text", F.when(able, F.col("_text"))).drop("_plain", "_words"))
    texts = base.filter(F.col("_text").isNotNull()).select("_id", "_hash", "_text").dropDuplicates(["_id", "_hash"])
    blocks = cut(_blocks(texts, vocabulary, span).filter(F.size("_words") >= min(need.values())))
    base = base.drop("_text")

    # One row for each word of a template at most, whatever the size of the input.
    often = {r[0]: r[1] for r in blocks.select(F.explode("_words").alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    ranked = {name: sorted(rank[w] for w in words) for name, words in sets.items()}
    prefix = F.array(
        *[
            F.struct(F.lit(r).alias("rank"), F.lit(name).alias("template"), F.lit(i).alias("at"))
            for name, words in ranked.items()
            for i, r in enumerate(words[: len(words) - need[name] + 1])
        ]
    )
    shape = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(len(w)).alias("size"), F.lit(need[n]).alias("need"), F.array(*map(F.lit, w)).alias("ranks")) for n, w in ranked.items()])
    one = spark.range(1)
    index = F.broadcast(one.select(F.inline(prefix)).join(F.broadcast(one.select(F.inline(shape))), "template"))

    sorted_blocks = blocks.withColumn("_ranks", F.array_sort(F.transform("_words", lambda w: ranks[w]))).drop("_words").withColumn("_size", F.size("_ranks"))
    places = sorted_blocks.select("*", F.posexplode("_ranks").alias("_place", "rank"))
    able = (
        (F.col("_size") >= F.col("need"))  # length
        & (F.col("_place") <= F.col("_size") - F.col("need"))  # prefix of the block
        & (F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_place")) + F.least("at", "_place") >= F.col("need"))  # position
    )
    overlap = F.size(F.array_intersect("_ranks", "ranks"))
    met = places.join(index, "rank").filter(able).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    match = F.struct(F.col("_block").alias("block"), F.col("template"), F.col("overlap"), (F.col("overlap") / F.col("size")).alias("containment"), F.col("_until").alias("until"), F.array_intersect("_ranks", "ranks").alias("held"))
    matched = met.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set(match)).alias("matches"))
    # Lines together count for a template that none of them holds alone.
    alone = lambda m, o: (o["until"] == o["block"]) & (o["template"] == m["template"]) & o["block"].between(m["block"], m["until"])
    matched = matched.withColumn("matches", F.filter("matches", lambda m: (m["until"] == m["block"]) | ~F.exists("matches", lambda o: alone(m, o))))

    whole = base.join(matched.withColumnRenamed("_id", "_other"), F.col("_id").eqNullSafe(F.col("_other")) & (base["_hash"] == matched["_hash"]), "left")
    matches = F.coalesce("matches", F.array().cast(matched.schema["matches"].dataType))
    # Of related licenses, one whose words in a block all belong to a fuller one there is no label of its own.
    related = lambda m: m["template"].isin(*RELATED)
    fuller = lambda m, o: related(o) & (o["block"] == m["block"]) & (o["until"] == m["until"]) & (o["containment"] > m["containment"]) & (F.size(F.array_except(m["held"], o["held"])) == 0)
    fullest = F.filter(matches, lambda m: ~(related(m) & F.exists(matches, lambda o: fuller(m, o))))
    renamed = F.transform(fullest, lambda m: F.coalesce(F.create_map(*[F.lit(x) for kv in SAME.items() for x in kv])[m["template"]], m["template"]))
    return whole.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", renamed)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))).alias("score"),
        F.transform(matches, lambda m: m.dropFields("until", "held")).alias("matches"),
    )
