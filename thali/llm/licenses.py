"""License scans by an exact set-similarity join (native).

A block of a template is a run of consecutive words of the text, at most
``SPAN`` times as many as the template has; line ends, blank lines and comment
signs are gaps like any other.  A template is found where a run holds at least
``THRESHOLD`` of its words.  Every run starts and ends with words of the
template, and a run that holds another with as many of them is not one.

A run that qualifies holds one of any ``|T| - need + 1`` words of the template.
Texts are cut in pieces of as many words as the longest run has, and only
pieces with such a word (the longest ones of each template) are looked at,
with the pieces beside them.  Of what these windows hold, words are ordered by
how many windows hold them, rarest first.  A window with a run holds one of the
first ``|T| - need + 1`` words of the template (prefix filter), has at least
``need`` words (length filter), and has enough words left after the first
shared one (positional filter).  What passes is verified by sliding over every
place of the window.

Only words of templates are kept, with their places; the template side is a
fixed table of this module, so it is broadcast.

Besides, each place of a base phrase is counted: its words one after the other.

Defined results: null and empty texts have no words and no labels; rows that
repeat id and text have equal results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.llm.common import ascii_lower, fenced, literal_rows, stored

# Base phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# License notices with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
#: A run has at most this many times the words of its template, repeats counted:
#: room for a name, a year or a link put into a notice, but not for a second
#: sentence of its length.
SPAN = 1.5
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _all_words(text: str) -> list[str]:
    return [w for w in re.split(_OTHER, text.lower()) if w]


def template_words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_all_words(text)))


def _reach(text: str) -> int:
    """Words of the longest run of a template."""
    return int(SPAN * len(_all_words(text)))


def _phrase(phrase: str) -> str:
    return _GAP.join(phrase.split())


def _place(pattern: str) -> str:
    return rf"(?is)(?<!{_WORD})(?:{pattern})(?!{_WORD})"


def _need(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def _piece(templates) -> int:
    """Words of a piece: those of the longest run."""
    return max((_reach(t) for _, t in templates), default=1)


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: its base counts and, by window (``at``: the first
    word of the piece in its middle), the template words with their places."""
    own = [template_words(t) for _, t in templates]
    known = F.array(*[F.lit(w) for w in sorted({w for t in own for w in t})])
    # one of them is in every run
    signs = {w for t in own for w in sorted(t, key=lambda w: (-len(w), w))[:len(t) - _need(len(t), threshold) + 1]}
    signs, piece = F.array(*[F.lit(w) for w in sorted(signs)]), _piece(templates)
    any_phrase = "|".join(_phrase(p) for p, _ in PHRASES)
    count = lambda c: F.regexp_count(c, F.lit(_WORD + "+"))
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("t"))
    rows = rows.withColumn("n_base", F.regexp_count("t", F.lit(_place(any_phrase))).cast("long"))
    some = F.col("n_base") > 0
    before_first = F.expr("substr(t, 1, _at - 1)")
    before_last = F.regexp_extract("t", rf"(?is)^(.*)(?<!{_WORD})(?:{any_phrase})(?!{_WORD})", 1)
    rows = rows.withColumn("_at", F.when(some, F.regexp_instr("t", F.lit(_place(any_phrase)))))
    labels = F.filter(F.array(*[F.when(F.rlike("t", F.lit(_place(_phrase(p)))), F.lit(name)) for p, name in PHRASES]),
                      lambda x: x.isNotNull())
    rows = rows.select(
        "doc_id", F.xxhash64("t").alias("text_hash"), count("t").cast("long").alias("n_words"), "n_base",
        F.when(some, count(before_first)).cast("long").alias("first_word"),
        F.when(some, count(before_last)).cast("long").alias("last_word"),
        F.when(some, labels).otherwise(F.array().cast("array<string>")).alias("base"),
        fenced(F.array_remove(F.split(ascii_lower(F.col("t")), _OTHER, -1), "")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(piece))
    with_sign = F.filter(starts, lambda i: F.arrays_overlap(F.slice("w", i + 1, F.lit(piece)), signs))

    def window(i: Column) -> Column:
        first = F.greatest(i - piece, F.lit(0))
        around = F.slice("w", first + 1, i + 2 * piece - first)
        held = F.filter(F.transform(around, lambda x, k: F.struct((first + k).alias("place"), x.alias("word"))),
                        lambda x: F.array_contains(known, x["word"]))
        return F.struct(i.alias("at"), held.alias("held"))

    return rows.withColumn("windows", F.transform(with_sign, window)).drop("w")


def matches(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, label, first, last, containment) of every run and
    template at or above the threshold, by the places of the run's first and
    last word; a run within one of a template that has all words of its own and
    more is left to the wider one.  Repeated rows and runs over two pieces
    repeat."""
    spark, piece = rows.sparkSession, _piece(templates)
    windows = rows.select("doc_id", "text_hash", F.inline("windows"))
    words = windows.select(F.explode(F.array_distinct(F.col("held.word"))).alias("word"))
    # at most the words of the templates
    often = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    all_words = {w for _, t in templates for w in template_words(t)}
    order = sorted(all_words, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, sets = [], []
    for number, (label, text) in enumerate(templates):
        own = sorted(template_words(text), key=rank.__getitem__)
        need = _need(len(own), threshold)
        wider = [k for k, (_, other) in enumerate(templates) if set(own) < set(template_words(other))]
        sets.append((number, label, own, _reach(text), wider))
        prefixes += [(w, number, i, len(own), need) for i, w in enumerate(own[:len(own) - need + 1])]
    prefix = literal_rows(spark, "word string, template int, at_t int, size_t int, need int", prefixes)
    whole = literal_rows(spark, "template int, label string, own array<string>, reach int, wider array<int>", sets)

    in_order = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("held.word"))
    windows = windows.withColumn("set", fenced(in_order))
    met = (windows.select("*", F.posexplode("set").alias("at_b", "word"))
           .join(F.broadcast(prefix), "word").where(F.size("set") >= F.col("need"))
           .groupBy("doc_id", "text_hash", "at", "held", "set", "template", "size_t", "need")
           .agg(F.min("at_t").alias("at_t"), F.min("at_b").alias("at_b")))
    left = F.least(F.col("size_t") - F.col("at_t"), F.size("set") - F.col("at_b"))
    near = met.where(left >= F.col("need")).join(F.broadcast(whole), "template")
    near = near.where(F.size(F.array_intersect("set", "own")) >= F.col("need"))
    near = near.withColumn("mine", fenced(F.filter("held", lambda h: F.array_contains("own", h["word"]))))

    def run(h: Column) -> Column:
        """From a template word to the last new one within reach."""
        near_by = F.filter("mine", lambda o: (o["place"] >= h["place"]) & (o["place"] < h["place"] + F.col("reach")))
        new = F.aggregate(near_by, F.struct(F.array().cast("array<string>").alias("seen"), h["place"].alias("last")), lambda acc, o: F.when(
            F.array_contains(acc["seen"], o["word"]), acc).otherwise(
            F.struct(F.array_append(acc["seen"], o["word"]).alias("seen"), o["place"].alias("last"))))
        return F.transform(F.array(new), lambda a: F.struct(h["place"].alias("first"), a["last"].alias("last"), F.size(a["seen"]).alias("n")))[0]

    near = near.withColumn("runs", fenced(F.transform("mine", run)))
    near = near.withColumn("runs", fenced(F.filter("runs", lambda r: r["n"] >= F.col("need"))))
    least = F.filter("runs", lambda r: ~F.exists("runs", lambda o: (o["first"] > r["first"]) & (o["last"] <= r["last"]) & (o["n"] >= r["n"])))
    near = near.withColumn("runs", fenced(least)).where(F.size("runs") > 0)
    found = near.groupBy("doc_id", "text_hash", "at", "held").agg(  # as many as templates at most
        F.collect_list(F.struct("template", "label", "wider", "size_t", "runs")).alias("of"))
    each = found.select("doc_id", "text_hash", "at", "of", F.inline("of")).select("doc_id", "text_hash", "at", "of", "label", "wider", "size_t", F.inline("runs"))
    # a run that does not reach the middle piece is whole in another window
    each = each.where((F.col("last") >= F.col("at")) & (F.col("first") < F.col("at") + piece))
    within = F.exists("of", lambda x: F.array_contains("wider", x["template"]) & F.exists(
        x["runs"], lambda o: (o["first"] <= F.col("first")) & (o["last"] >= F.col("last"))))
    return each.where(~within).select("doc_id", "text_hash", "label", "first", "last", (F.col("n") / F.col("size_t")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: counts, base labels, all labels, best containment."""
    rows = stored(scanned(docs, templates, threshold), "license-windows")
    found = matches(rows, templates, threshold).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"))  # as many labels as templates at most
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    both = rows.drop("windows").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"))
